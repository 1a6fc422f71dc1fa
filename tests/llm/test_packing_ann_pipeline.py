"""Packing, neighbours, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import ann, catalog, common, packing


def check_bins(rows, sizes):
    bins = {}
    for b, at, length, size in rows:
        bins.setdefault((b, size), []).append((at, length))
    for (_, size), held in bins.items():
        end = 0
        for at, length in sorted(held):
            assert at == end
            end += length
        assert end <= size and size == min(s for s in sizes if s >= end)
    return sum(s for _, s in bins)


@pytest.mark.parametrize("seed", range(5))
def test_pack_is_valid_and_close_to_full(seed):
    rng, sizes = random.Random(seed), (64, 128, 256)
    lengths = [rng.choice([rng.randint(1, 256), rng.randint(1, 40)]) for _ in range(500)]
    placed = packing.pack(lengths, sizes, 8)
    total = check_bins([(b, at, n, s) for (b, at, s), n in zip(placed, lengths)], sizes)
    assert sum(lengths) <= total <= 1.08 * sum(lengths)


def test_pack_takes_the_bin_with_least_room():
    assert packing.pack([100, 60, 27], (128,), 0)[2][0] == packing.pack([100, 60, 27], (128,), 0)[0][0]
    assert packing.pack([], (8,)) == [] and packing.pack([3], (4, 8)) == [(0, 0, 4)]


def test_packing_covers_every_word(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (None, "a b")], "doc_id long, text string"))
    got = packing.best_fit_packing(docs, shard_pieces=100).collect()
    check_bins([(r.bin_id, r.offset, r.length, r.bin_size) for r in got if r.bin_id], packing.SIZES)
    words, spans = {}, {}
    for d, text in docs.collect():
        words[d] = words.get(d, 0) + len((text or "").encode().split())
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.piece))
    assert {d: sum(n for _, n, _ in s) for d, s in spans.items()} == words
    for d, s in spans.items():
        if d is not None:
            assert [a for a, *_ in sorted(s)] == [sum(n for _, n, _ in sorted(s)[:k]) for k in range(len(s))]
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def brute(x, ids, q, k):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def test_recall(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(3000, 32).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in ann.nearest(vectors(spark, x), F.col("vec_id") % 50 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in range(0, 3000, 50):
        rows = sorted(got[q])
        assert [r for r, *_ in rows] == list(range(1, 21)) and [s for *_, s in rows] == sorted((s for *_, s in rows), reverse=True)
        recall.append(len({v for _, v, _ in rows} & {v for v, _ in brute(x, np.arange(3000), q, 20)}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbour_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.25)]
    assert ann.nearest(df.limit(0), F.lit(True), 5).count() == 0


def test_queries_whose_files_hold_too_few_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(ann, "VISITED", 1)
    monkeypatch.setattr(ann, "POSTED", 1)
    x = np.random.RandomState(1).randn(60, 4).astype(np.float32).astype(float)
    got = ann.nearest(vectors(spark, x), F.col("vec_id") % 20 == 0, 20).collect()
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 20, 40)} == {q: [v for v, _ in brute(x, np.arange(60), q, 20)] for q in (0, 20, 40)}


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, sf, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        assert set(now) <= set(kept) and all(len(r.text) <= len(kept[d]) and r.n_chars == len(r.text) for d, r in now.items())
        kept = {d: r.text for d, r in now.items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert set(catalog.queries()) >= {"op2_bpe", "op8_toxicity"}
