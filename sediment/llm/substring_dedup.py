"""Incremental substring dedup over a log-structured index of window fingerprints.

A window is 50 consecutive words of one document; every word goes that is covered
by a window whose word sequence also starts in a document with a smaller doc_id.

Method. Of the 8-word grams of a window the one with the smallest hash is its
anchor; equal windows have equal anchors at equal places. Neighbouring windows
with one anchor form a group, and a group's words (its context) are hashed in
full. The index is a log of sorted immutable runs, bucketed by anchor, with one
entry for each different context: its anchor, its hash, and where it stands first.
Each new batch of documents is merge-joined with the runs on the anchor:

* a context that stands in a smaller document settles all its windows at once
  (exact copies end here);
* of an anchor with several contexts, the windows themselves are verified: their
  text is fetched at the first place of each context, every window's words are
  hashed (128 bits), and the smallest document of each window decides.

The batch's new contexts become a run; ``FAN_IN`` runs of one tier are compacted into
one of the next (smallest document of each context). So the index holds about one
entry for 22 words, and only contested windows are ever listed one by one. An index
in a folder can be opened again by a later job: :func:`dedup_batch`.

Words are runs of other than the bytes 32 and 9 to 13. Windows are judged on the
texts as they come, not on what is left of them.

Defined results
* null text: stays null, no words; empty texts and those under 50 words: unchanged.
* a repeat within one document isn't one (no smaller doc_id), nor is one between
  rows that share a doc_id; places belong to a doc_id and a hash of the text, so rows
  that share a doc_id but not the text each lose only what repeats in their own.
* a null doc_id orders before all others; doc_ids are whole numbers, others raise TypeError.
* documents that come in a later batch never change what was decided before, so
  batches have to come in order of doc_id for the rule above to hold in full.
* an empty table gives an empty table; other columns pass through unchanged.

Scale: contexts and windows meet by aggregates with map-side combining and by
shuffled joins that adaptive execution splits, so a passage in a third of all
documents is one row where rows are gathered. Each step is written to the shared
folder and frees its shuffle files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm import common, words
from sediment.sources.files import Files
from sediment.sources.log import CommitLog, FileEntry

WINDOW, GRAM = 50, 8
#: Runs of a tier that are merged into one, and batches into which one call cuts a table.
FAN_IN, BATCHES = 4, 3
#: Tasks over which the places of one contested anchor are spread.
SALTS = 8

_KEY = ["anchor", "c1", "c2"]
_ENTRY = "anchor long, c1 long, c2 long, d long, h long, start int, n int"
_GROUPS = "d long, h long, anchor long, c1 long, c2 long, start int, n int"


def _id(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def _hash() -> Column:
    """Tells texts apart that share a doc_id."""
    return F.xxhash64("text")


def _least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For each place the first place of the least value among the next ``width``."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        have += step
    return place


class Texts:
    """The words of a column of texts: their bytes joined by single spaces, and where each word begins and ends in these."""

    def __init__(self, column: pa.Array):
        data, begins = words.bytes_of(column)
        self.raw, self.begins = data, begins
        self.raw_starts, self.raw_ends, self.first = words.spans(data, begins, words.PLAIN)
        starts, ends = self.raw_starts, self.raw_ends
        self.starts = np.cumsum(ends - starts + 1) - (ends - starts + 1)
        self.ends = self.starts + (ends - starts)
        joined = np.full(int(self.ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        if len(ends):
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            taken = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
            joined[taken + np.repeat(self.starts - starts, ends - starts)] = data[taken]
        self.joined = joined.tobytes()
        self.hash = words.hashes(data, starts, ends)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group of neighbouring windows with one anchor."""
    grams = WINDOW - GRAM + 1
    for batch in batches:
        t = Texts(batch.column("_sub_text"))
        if len(t.hash) < WINDOW:
            continue
        g = words.runs(t.hash, GRAM)
        place = _least_places(g, grams)  # one for each place where a window may begin
        doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))[: len(place)]
        valid = np.arange(len(place)) + WINDOW <= t.first[doc + 1]
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        a = np.flatnonzero(begin)
        if not len(a):
            continue
        number = np.cumsum(begin)[valid]
        n = np.bincount(number - 1, minlength=len(a))
        low, high = t.starts[a].tolist(), t.ends[a + n - 1 + WINDOW - 1].tolist()
        digest = xxhash.xxh3_128_digest
        c = np.frombuffer(b"".join([digest(t.joined[i:j]) for i, j in zip(low, high, strict=True)]), "<i8").reshape(-1, 2)
        d, h = (np.asarray(batch.column(c))[doc[a]] for c in ("d", "h"))
        columns = [d, h, g[place[a]].view(np.int64), c[:, 0], c[:, 1], (a - t.first[doc[a]]).astype(np.int32), n.astype(np.int32)]
        rows = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["d", "h", "anchor", "c1", "c2", "start", "n"])
        for i in range(0, rows.num_rows, 20_000):
            yield rows.slice(i, 20_000)


def _listed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the wanted groups, with the hash of its words."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        t = Texts(batch.column("_sub_text"))
        for i, (d, h, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "h", "wanted")), strict=True)):
            first, count = int(t.first[i]), int(t.first[i + 1] - t.first[i])
            mark = np.zeros(count + 1, np.int64)
            for w in wanted:
                mark[min(w["start"], count)] += 1
                mark[min(w["start"] + w["n"], count)] -= 1
            at = np.flatnonzero(np.cumsum(mark)[: max(0, count - WINDOW + 1)] > 0)
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                low, high = t.starts[first + part].tolist(), t.ends[first + part + WINDOW - 1].tolist()
                f = np.frombuffer(b"".join([digest(t.joined[i:j]) for i, j in zip(low, high, strict=True)]), "<i8").reshape(-1, 2)
                columns = [f[:, 0], f[:, 1], np.full(len(part), d, np.int64), np.full(len(part), h, np.int64), part.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["f1", "f2", "d", "h", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the covered words. The white space before a removed stretch stays, that within and after it goes."""
    for batch in batches:
        column = batch.column("_sub_text")
        t = Texts(column)
        kept, n_words, n_removed = [], [], []
        for i, gone in enumerate(batch.column("_sub_gone").to_pylist()):
            first, last = int(t.first[i]), int(t.first[i + 1])
            count = last - first
            n_words.append(count)
            low, high = int(t.begins[i]), int(t.begins[i + 1])
            if not gone:
                kept.append(t.raw[low:high].tobytes() if column[i].is_valid else None)
                n_removed.append(0)
                continue
            mark = np.zeros(count + 1, np.int64)
            for w in gone:
                mark[min(w["start"], count)] += 1
                mark[min(w["start"] + w["n"] + WINDOW - 1, count)] -= 1
            covered = np.cumsum(mark)[:count] > 0
            n_removed.append(int(covered.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
            parts = []
            for a, b in edge.reshape(-1, 2):
                parts.append(t.raw[low : t.raw_starts[first + a]])
                low = int(t.raw_starts[first + b]) if b < count else int(t.raw_ends[last - 1])
            parts.append(t.raw[low:high])
            kept.append(b"".join(p.tobytes() for p in parts))
        out = batch.drop_columns(["_sub_text", "_sub_gone"])
        for name, values, kind in (("text", pa.array(kept, pa.binary()).cast(pa.string()), None), ("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64())):
            out = out.append_column(name, values if kind is None else pa.array(values, kind))
        yield out


class FingerprintIndex:
    """Sorted immutable runs of (anchor, c1, c2, d, h, start, n), an entry for each different context, bucketed by anchor.

    The runs lie in a folder with a commit log that names them, so an index is opened
    again by its folder, in any later application. Runs are kept in tiers: ``fan_in``
    runs of one tier are merged into one of the next, so an entry is rewritten once a
    tier, as often as the logarithm of the index's size says. A merge that dies leaves
    the log as it was. Without a folder the index is a scratch one, which ``drop`` removes.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.folder = folder or f"{common.shared_folder(spark)}/substring-index-{uuid.uuid4().hex}"
        self.log = CommitLog(Files(spark, self.folder))
        # a bucket is one sorted file, so the merge join needs no sort of its own
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def runs(self, tier: int | None = None) -> list[str]:
        """Names of the runs, oldest first."""
        found = sorted(self.log.snapshot().files.values(), key=lambda f: (f.seq_num, f.path))
        return [f.path for f in found if tier is None or f.level == tier]

    def run(self, name: str) -> DataFrame:
        """The table of a run; one that another application wrote is made known here first."""
        if not self.spark.catalog.tableExists(name):
            buckets = int(name.split("_")[2])
            self.spark.sql(f"CREATE TABLE {name} ({_ENTRY}) USING parquet OPTIONS (path '{self._path(name)}') CLUSTERED BY (anchor) SORTED BY (anchor) INTO {buckets} BUCKETS")
        return self.spark.table(name)

    def _path(self, name: str) -> str:
        return self.log.files.uri(name)

    def _write(self, contexts: DataFrame) -> FileEntry:
        buckets = common.partitions(self.spark)
        name = f"substring_run_{buckets}_{uuid.uuid4().hex}"
        (
            contexts.select(*_KEY, "d", "h", "start", "n").repartition(buckets, "anchor")
            .write.option("compression", "zstd").option("path", self._path(name)).bucketBy(buckets, "anchor").sortBy("anchor").saveAsTable(name)
        )
        return FileEntry(name, 0, "", "", 0, 0)

    def append(self, contexts: DataFrame) -> None:
        made = self._write(contexts)
        self.log.commit(lambda now: {"added": [replace(made, seq_num=now.next_seq)]})

    def matching(self, contexts: DataFrame) -> DataFrame | None:
        """Entries of all runs whose anchor stands in ``contexts``: a merge join with each run, which isn't moved."""
        anchors = contexts.select(F.col("anchor").alias("a")).distinct()
        hits = [self.run(name).join(anchors.hint("merge"), F.col("anchor") == F.col("a"), "left_semi").select(*_KEY, "d", "h", "start", "n") for name in self.runs()]
        return reduce(DataFrame.unionByName, hits) if hits else None

    def compact(self) -> None:
        """Merge each tier that has enough runs; of a context that stands in several, the smallest place stays."""
        tier = 0
        while any(f.level >= tier for f in self.log.snapshot().files.values()):
            old = self.runs(tier)
            if len(old) >= self.fan_in:
                made = self._write(_first_places(reduce(DataFrame.unionByName, map(self.run, old))))
                self.log.commit(lambda now, made=made, old=old, tier=tier: {"added": [replace(made, level=tier + 1, seq_num=now.next_seq)], "removed": old})
                self._forget(old)
            tier += 1

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.log.files.delete(name)

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.delete_folder(self.spark, self.folder)


def _first_places(contexts: DataFrame, *more: Column) -> DataFrame:
    return contexts.groupBy(*_KEY).agg(F.min(F.struct("d", "h", "start", "n")).alias("first"), *more).select(*_KEY, "first.*", *(m for m in ("old",) if more))


def ingest(index: FingerprintIndex, batch: DataFrame, store: DataFrame) -> DataFrame:
    """Windows of ``batch`` that start in a smaller document: (d, h, start, n), n windows from word ``start`` of the text with hash ``h`` on.

    ``store`` has the text of every document in the index and in the batch. The
    batch's contexts are added to the index.
    """
    text = F.col("text").cast("binary").alias("_sub_text")
    groups = common.materialise(batch.where("text IS NOT NULL").select(_id().alias("d"), _hash().alias("h"), text).mapInArrow(_groups, _GROUPS), "groups")
    contexts = common.materialise(_first_places(groups), "contexts")
    entries = contexts.withColumn("old", F.lit(False))
    if (history := index.matching(contexts)) is not None:
        entries = _first_places(entries.unionByName(history.withColumn("old", F.lit(True))), F.max("old").alias("old"))
        entries = common.materialise(entries, "entries")

    # where else in the batch a context stands: in other documents, or again in the same one
    settled = entries.select(*(F.col(c).alias(f"e_{c}") for c in _KEY), F.col("d").alias("d0"), F.col("h").alias("h0"), F.col("start").alias("start0"))
    same = (F.col("anchor") == F.col("e_anchor")) & (F.col("c1") == F.col("e_c1")) & (F.col("c2") == F.col("e_c2"))
    again = common.materialise(groups.join(settled, same).where("d > d0 OR h <> h0 OR start <> start0").select("anchor", "d", "h", "start", "n", "d0"), "again")

    # anchors with several contexts, in more than one document: their windows are listed one by one
    contested = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("d").alias("d0"), F.max("d").alias("d1")).where("k > 1 AND d0 < d1").select(F.col("anchor").alias("a"))
    places = entries.select("anchor", "d", "h", "start", "n").unionByName(again.where("d = d0").drop("d0"))
    # places of an anchor are dealt to SALTS tasks, and each task has the anchor
    places = places.withColumn("salt", F.pmod(F.xxhash64("d", "h", "start"), F.lit(SALTS)))
    contested = contested.select("a", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("b"))
    wanted = (
        places.join(contested, (F.col("anchor") == F.col("a")) & (F.col("salt") == F.col("b")), "left_semi")
        .groupBy(F.col("d").alias("_sub_d"), F.col("h").alias("_sub_h")).agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
    )
    texts = store.where("text IS NOT NULL").select(_id().alias("d"), _hash().alias("h"), text)
    windows = common.materialise(texts.join(wanted, (F.col("d") == F.col("_sub_d")) & (F.col("h") == F.col("_sub_h"))).select("d", "h", "_sub_text", "wanted").mapInArrow(_listed_windows, "f1 long, f2 long, d long, h long, start int"), "windows")
    least = windows.groupBy("f1", "f2").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 < d1").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "d0")
    verified = windows.join(least, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).where("d > d0").select("d", "h", "start", F.lit(1).alias("n"))

    copied = again.where("d > d0").select("d", "h", "start", "n")
    found = common.materialise(copied.unionByName(verified).distinct(), "covered")
    for done in (windows, again, groups):
        common.forget(done)

    index.append(entries.where("NOT old"))
    index.compact()
    common.forget(entries)
    common.forget(contexts)
    return found


def _checked(docs: DataFrame) -> DataFrame:
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number")
    common.tune(docs.sparkSession)
    return docs.drop("n_words", "n_removed")


def dedup_batch(index: FingerprintIndex, batch: DataFrame, store: DataFrame) -> DataFrame:
    """One batch of an index that goes on: ``batch`` cut as :func:`substring_dedup` does.

    ``store`` (doc_id, text) has all documents that the index has seen, and the batch.
    Batches have to come in order of doc_id.
    """
    batch = _checked(batch)
    return _without(batch, ingest(index, batch, store))


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_words`` and ``n_removed`` added (replacing columns of these names)."""
    docs = _checked(docs)
    id_ = F.col("doc_id").cast("long")
    bounds = sorted(set(docs.select(id_.alias("d")).where("d IS NOT NULL").approxQuantile("d", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    bounds = [int(b) for b in bounds]
    index = FingerprintIndex(docs.sparkSession)
    covered = None
    try:
        for k in range(len(bounds) + 1):
            batch, store = docs, docs
            if k < len(bounds):
                store = store.where(id_.isNull() | (id_ <= bounds[k]))
                batch = batch.where(id_.isNull() | (id_ <= bounds[k])) if k == 0 else batch
            if k:
                batch = batch.where(id_ > bounds[k - 1])
                batch = batch.where(id_ <= bounds[k]) if k < len(bounds) else batch
            found = ingest(index, batch, store)
            covered = found if covered is None else covered.unionByName(found)
    finally:
        index.drop()
    return _without(docs, covered)


def _without(docs: DataFrame, covered: DataFrame) -> DataFrame:
    gone = covered.groupBy(F.col("d").alias("_sub_d"), F.col("h").alias("_sub_h")).agg(F.collect_list(F.struct("start", "n")).alias("_sub_gone"))
    whole = docs.withColumns({"_sub_text": F.col("text").cast("binary"), "_sub_hash": _hash()}).drop("text")
    joined = whole.join(gone, (_id() == F.col("_sub_d")) & (F.col("_sub_hash") == F.col("_sub_h")), "left").drop("_sub_d", "_sub_h", "_sub_hash")
    others = [f for f in joined.schema if f.name not in ("_sub_text", "_sub_gone")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", text string, n_words long, n_removed long"
    return joined.mapInArrow(_cut, schema).select(*docs.columns, "n_words", "n_removed")
