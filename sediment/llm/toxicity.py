"""Toxicity scores from class-conditional Kneser-Ney models.

Method: one bigram model of toxic and one of ordinary text, both with
interpolated Kneser-Ney smoothing. A word's continuation count in its class is
discounted, and what the discount frees goes to a distribution that both classes
share: in how many documents of the whole corpus the word stands. So a word that
neither class has seen favours neither, and a rare one is held near what all
documents say of it. A text is scored by the difference of its log-likelihoods
under the two models, normalised by length: over the whole text, over its best
stretch of 16 words, and, by the lower order alone, over its best one and two
words (an expression in a long text moves the whole text's mean by almost nothing). A logistic fit on
labelled rows that the models haven't seen turns these into a score.

What is bounded, and by what: the models and the fit take at most
``ROWS_PER_CLASS`` labelled rows of each class, those with the smallest hashes of
their doc_id, half for the models and half for the fit. A model keeps every word,
every bigram and every context of its rows, also those that stand in one class
alone, so its size is bounded by the rows' words (about ten bytes for each different
bigram) and it can be sent to every task. The shared counts cover all documents.

Defined results
* null and empty texts: scored like a text of no words, so far below the threshold.
* no labelled row of one of the classes: every score is 0.
* several labels of a document: it is toxic if one of them says so.
* rows that repeat a doc_id are scored each; a null doc_id is scored, never held
  out and never learnt from.
* an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm import common, words

ROWS_PER_CLASS = 8000
#: Absolute discounts of bigrams and of continuation counts.
DISCOUNT_PAIR, DISCOUNT_WORD = 0.75, 1.0
STRETCH = 16
#: Stands before the first word of a text.
START = np.uint64(0)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mixed(v * np.uint64(3) + w)


@dataclass
class Model:
    """Sorted hashes and what goes with them; classes in the order ordinary, toxic."""

    word: np.ndarray
    word_p: np.ndarray
    unseen: np.ndarray
    before: np.ndarray
    before_share: np.ndarray
    before_count: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray
    weights: np.ndarray | None = None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def differences(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | toxic) - log p(word | ordinary) of every word: after the word before it, and by itself."""
        if not len(h):
            return np.empty(0), np.empty(0)
        at, known = _find(self.word, h)
        # a word that no class knows has the shared part alone, which is a factor of both
        p = np.where(known[:, None], self.word_p[at] if len(self.word) else 0.0, self.unseen)
        alone = np.log(p[:, 1]) - np.log(p[:, 0])
        v = np.concatenate(([START], h[:-1]))
        v[first[:-1][first[:-1] < len(h)]] = START
        context, known = _find(self.before, v)
        p = p * np.where(known[:, None], self.before_share[context] if len(self.before) else 0.0, 1.0)
        at, seen = _find(self.pair, _pair_key(v, h))
        both = seen & known
        if both.any():
            rest = np.maximum(self.pair_count[at[both]] - DISCOUNT_PAIR, 0)
            p[both] += rest / np.maximum(self.before_count[context[both]], 1)
        return np.log(p[:, 1]) - np.log(p[:, 0]), alone

    def features(self, column: pa.Array) -> np.ndarray:
        data, begins = words.bytes_of(column)
        starts, ends, first = words.spans(data, begins, words.LETTERS)
        h = words.hashes(data, starts, ends)
        d, alone = self.differences(h, first)
        total = np.concatenate(([0.0], np.cumsum(d)))
        out = np.zeros((len(column), 5))
        n = np.diff(first)
        out[:, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        out[:, 4] = np.log1p(n)
        for i in np.flatnonzero(n):
            a, b = first[i], first[i + 1]
            k = min(STRETCH, b - a)
            out[i, 1] = (total[a + k : b + 1] - total[a : b + 1 - k]).max() / STRETCH
            if b - a > 1:
                best = np.partition(alone[a:b], b - a - 2)[-2:]
                out[i, 2], out[i, 3] = best[1], best[0]
            else:
                out[i, 2] = alone[a]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(column))
        z = (self.features(column) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, fit, v, w, key): the pairs of neighbouring words, and the hash that a model finds a pair by."""
    for batch in batches:
        data, begins = words.bytes_of(batch.column("_tox_text"))
        starts, ends, first = words.spans(data, begins, words.LETTERS)
        h = words.hashes(data, starts, ends)
        if not len(h):
            continue
        v = np.concatenate(([START], h[:-1]))
        v[first[:-1][first[:-1] < len(h)]] = START
        doc = pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first)))
        hashes = (pa.array(_signed(x)) for x in (v, h, _pair_key(v, h)))
        yield pa.RecordBatch.from_arrays([batch.column("toxic").take(doc), batch.column("fit").take(doc), *hashes], names=["toxic", "fit", "v", "w", "key"])


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): in how many documents of a batch a word stands."""
    for batch in batches:
        data, begins = words.bytes_of(batch.column("_tox_text"))
        starts, ends, first = words.spans(data, begins, words.LETTERS)
        h = words.hashes(data, starts, ends)
        if not len(h):
            continue
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        w, n = np.unique(h[new], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(w)), pa.array(n.astype(np.int64))], names=["w", "n"])


def shared_counts(docs: DataFrame) -> DataFrame:
    """(w, n): document counts of every word, over all of ``docs``."""
    return docs.select(_text()).mapInArrow(_documents_with, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _text() -> Column:
    return F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("_tox_text")


def labelled(labels: DataFrame, usable: Column | None) -> DataFrame:
    """(doc_id, toxic): a row for each document whose labels may be learnt from."""
    each = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if usable is not None:
        each = each.where(usable)
    return each.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def chosen(each: DataFrame) -> DataFrame:
    """(doc_id, toxic, fit): the rows that are learnt from, at most ROWS_PER_CLASS of each class."""
    each = each.withColumn("_order", F.xxhash64("doc_id"))
    parts = [each.where(F.col("toxic") == t).orderBy("_order", "doc_id").limit(ROWS_PER_CLASS) for t in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic", (F.col("_order") % 2 == 0).alias("fit"))


#: The bigrams come to the driver in this many pieces (by the highest bits of their key), so that no more than one piece is held beside the result.
PIECES_BITS = 2


def _sorted(df: DataFrame, key: str, **columns: type) -> list[np.ndarray]:
    """The unsigned keys of a table in rising order, and the other columns beside them."""
    t = df.toArrow()
    h = t[key].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return [h[order], *(t[c].to_numpy()[order].astype(kind) for c, kind in columns.items())]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Models and logistic fit from ``labels`` (doc_id, toxic), only from its rows where ``usable`` holds."""
    common.tune(docs.sparkSession)
    each = labelled(labels, usable)
    picked = common.materialise(chosen(each), "toxicity-rows")
    # at most 2 * ROWS_PER_CLASS rows
    rows = docs.select("doc_id", _text()).join(F.broadcast(picked), "doc_id")
    counted = rows.select("toxic", "fit", "_tox_text").mapInArrow(_pairs, "toxic int, fit boolean, v long, w long, key long")
    of = lambda t, *more: F.count_if(F.expr(" AND ".join((f"toxic = {t}", *more))))
    counts = {"all0": of(0), "all1": of(1), "fit0": of(0, "fit"), "fit1": of(1, "fit")}
    pairs = common.materialise(counted.groupBy("v", "w", "key").agg(*(c.cast("int").alias(n) for n, c in counts.items())), "toxicity-pairs")
    shared = common.materialise(shared_counts(docs), "toxicity-shared")
    n_shared = shared.agg(F.sum("n")).first()[0]
    # the logistic fit looks at rows that its models haven't seen; the models that score have seen all chosen rows
    half = _models(pairs, "fit", shared, n_shared)
    seen = _seen(half, rows.where("NOT fit")) if half else None
    del half
    whole = _models(pairs, "all", shared, n_shared) if seen else None
    for done in (pairs, shared, picked):
        common.forget(done)
    return _calibrated(whole, *seen, each.agg(F.avg("toxic")).first()[0]) if whole else _nothing()


def _nothing() -> Model:
    none = np.empty(0, np.uint64)
    return Model(none, np.empty((0, 2)), np.ones(2), none, np.empty((0, 2)), np.empty((0, 2)), none, np.empty((0, 2)))


def _models(pairs: DataFrame, which: str, shared: DataFrame, n_shared: int) -> Model | None:
    """Both models from the counts ``which`` of the bigrams; None if a class has none."""
    pairs = pairs.select("v", "w", "key", F.col(f"{which}0").alias("c0"), F.col(f"{which}1").alias("c1")).where("c0 > 0 OR c1 > 0")
    kinds = [F.count_if(F.col(c) > 0).alias(k) for c, k in (("c0", "k0"), ("c1", "k1"))]
    # every word of the labelled rows stands in a document
    word, *counts, shared_n = _sorted(pairs.groupBy("w").agg(*kinds).join(shared, "w"), "w", k0=np.float64, k1=np.float64, n=np.float64)
    counts = np.stack(counts, 1)
    n = counts.sum(axis=0)
    if not n.all():
        return None
    freed = np.minimum(DISCOUNT_WORD * np.count_nonzero(counts, axis=0) / n, 1.0)
    word_p = np.maximum(counts - DISCOUNT_WORD, 0) / n + freed * (shared_n / n_shared)[:, None]

    before, c0, c1, k0, k1 = _sorted(pairs.groupBy("v").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), *kinds), "v", c0=np.float64, c1=np.float64, k0=np.float64, k1=np.float64)
    c_before = np.stack([c0, c1], 1)
    # a class that hasn't seen a context backs off as a whole
    share = np.where(c_before > 0, DISCOUNT_PAIR * np.stack([k0, k1], 1) / np.maximum(c_before, 1), 1.0)

    size, most = pairs.agg(F.count(F.lit(1)), F.greatest(F.max("c0"), F.max("c1"))).first()
    kind = np.min_scalar_type(most)
    pair, pair_count, at = np.empty(size, np.uint64), np.empty((size, 2), kind), 0
    for piece in range(1 << PIECES_BITS):
        h, *c = _sorted(pairs.where(F.shiftrightunsigned("key", 64 - PIECES_BITS) == piece).select("key", "c0", "c1"), "key", c0=kind, c1=kind)
        pair[at : at + len(h)], pair_count[at : at + len(h)] = h, np.stack(c, 1)
        at += len(h)
    return Model(word, word_p, freed, before, share, c_before, pair, pair_count)


def _seen(model: Model, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What the model says of each row: its features, and the row's label."""
    send = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = send.value.features(batch.column("_tox_text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(f[:, k]) for k in range(f.shape[1]))], names=["toxic", *(f"f{k}" for k in range(f.shape[1]))])

    got = rows.select("toxic", "_tox_text").mapInArrow(run, "toxic int, " + ", ".join(f"f{k} double" for k in range(5))).toArrow()
    send.destroy()
    return np.stack([got[f"f{k}"].to_numpy() for k in range(5)], 1), got["toxic"].to_numpy().astype(float)


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """``model`` with a logistic fit of the labels ``y`` to the features ``x``."""
    if len(set(y)) < 2:
        return model
    model.mean, model.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - model.mean) / model.spread, np.ones((len(x), 1))])
    # the classes weigh as in all labelled rows, since their shares of the bounded sample may be others
    weight = len(y) * np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    w, ridge = np.zeros(z.shape[1]), 1e-3 * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        w = w - np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
    model.weights = w
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) added, replacing a column of this name.

    Texts alone go to Python, and scores alone come back.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of ROWS_PER_CLASS rows

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = send.value
        for column in texts:
            yield pa.array(held.scores(column), pa.float64())

    # so that a predicate on the score doesn't score each text again
    score = F.arrow_udf(run, "double").asNondeterministic()
    return docs.withColumn("toxicity", score(_text()))
