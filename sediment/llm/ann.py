"""Approximate nearest neighbours by a permutation index.

Method: a few hundred vectors are pivots. A vector is represented by the order of
the pivots nearest to it, and posted in the inverted files of its first few
pivots. A query looks into the files of its own nearest pivots, ranks a file's
members by the footrule distance between their pivot orders and its own (a pivot
beyond the first ``LENGTH`` counts as at place ``LENGTH``), and the best two
fifths of each file are ranked again by the inner product of the original vectors, in
double precision.

What is bounded: the pivots are the first ``PIVOTS`` different vectors among the
``SAMPLE`` rows with the smallest hashes of their ids; every row is indexed. Recall
against brute force is about 0.97 on vectors without any structure, and is tested.
A query for which too few are found is answered by a scan of all rows in blocks.

Defined results
* vectors that are null, zero, or hold null or non-finite components take no
  part, and neither do rows with a null id, or vectors of another length than the
  most frequent one (ties to the shorter).
* of rows that share an id the one with the smallest vector counts.
* fewer than ``k`` others: all of them; ties go to the smaller id.
* an empty table gives an empty table; other columns take no part.

Scale: vectors move once, to their files; a file with many members is cut into
blocks of about ``BLOCK``, and its queries go to each block, so that a third of all
rows in one file is many small tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm import common

PIVOTS, SAMPLE = 256, 2048
#: Pivots of a vector's order, files that it is posted in, files that a query looks into, and the share of a file that is ranked again.
LENGTH, POSTED, VISITED, AGAIN = 64, 4, 96, 0.4
BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x): the rows that take part, vectors as doubles."""
    x = F.col(vector).cast("array<double>")
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(ok).where(F.exists("x", lambda v: v != 0))
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).join(F.broadcast(length.select("n")), F.size("x") == F.col("n"), "left_semi")


def pivots(rows: DataFrame) -> np.ndarray:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    seen: dict[bytes, np.ndarray] = {}
    for r in sample:
        v = np.array(r.x)
        v = v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max()
        seen.setdefault(v.round(12).tobytes(), v)
        if len(seen) == PIVOTS:
            break
    return np.array(list(seen.values()))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def orders(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the earlier pivot."""
    return np.argsort(-(x @ pivot.T), axis=1, kind="stable")


_POST = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("vec_id", pa.int64()), ("x", pa.binary()), ("seq", pa.binary())])


def _posted(pivot: np.ndarray, files: int, blocks: dict[int, int] | None):
    """Rows in the files of their first ``files`` pivots; with ``blocks``, queries, which go to each block of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                x = _matrix(batch.column("x"))
                o = orders(x, pivot)
                first = o[:, :LENGTH].astype("<u2")
                for i, id_ in enumerate(batch.column("vec_id").to_pylist()):
                    packed, seq = x[i].astype("<f8").tobytes(), first[i].tobytes()
                    for f in o[i, :files].tolist():
                        for b in range(blocks.get(f, 0)) if blocks is not None else (0,):
                            yield f, b, id_, packed, seq

        yield from common.emit(rows(), _POST, 4096)

    return run


def _places(seq: list[bytes], n: int) -> np.ndarray:
    o = np.frombuffer(b"".join(seq), "<u2").reshape(len(seq), -1)
    places = np.full((len(seq), n), min(LENGTH, 255), np.uint8)
    np.put_along_axis(places, o.astype(np.int64), np.arange(o.shape[1], dtype=np.uint8)[None, :], axis=1)
    return places


def _search(n_pivots: int, k: int, again: float):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if members.num_rows and queries.num_rows:
            members = members.sort_by("vec_id")
            ids = members["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(members["x"].to_pylist()), "<f8").reshape(len(ids), -1)
            places = _places(members["seq"].to_pylist(), n_pivots)
            keep = max(2 * k, int(np.ceil(again * len(ids))))
            for id_, packed, own in zip(queries["vec_id"].to_pylist(), queries["x"].to_pylist(), _places(queries["seq"].to_pylist(), n_pivots), strict=True):
                near = np.arange(len(ids))
                if keep < len(ids):
                    footrule = (np.maximum(places, own) - np.minimum(places, own)).sum(axis=1, dtype=np.uint32)
                    near = np.argsort(footrule, kind="stable")[:keep]
                near = near[ids[near] != id_]
                score = (x[near] * np.frombuffer(packed, "<f8")).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                for column, values in zip(found, (np.full(len(best), id_), ids[near][best], score[best]), strict=True):
                    column.append(values)
        parts = [np.concatenate(c) if c else np.empty(0) for c in found]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(np.float64))})

    return run


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _met(members: DataFrame, queries: DataFrame, n_pivots: int, k: int, again: float) -> DataFrame:
    return members.groupBy("file", "block").cogroup(queries.groupBy("file", "block")).applyInArrow(_search(n_pivots, k, again), _FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the ``k`` other rows with the largest inner products."""
    spark = vectors.sparkSession
    common.tune(spark)
    rows = common.materialise(usable(vectors, id_col, vector), "vectors")
    pivot = pivots(rows)
    if not len(pivot):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(is_query)
    schema = "file int, block int, vec_id long, x binary, seq binary"
    posted = common.materialise(rows.mapInArrow(_posted(pivot, POSTED, None), schema), "postings")
    blocks = {r.file: -(-r["count"] // BLOCK) for r in posted.groupBy("file").count().collect()}  # a row for each pivot
    count = F.create_map(*(F.lit(v) for f in sorted(blocks) for v in (f, blocks[f])))
    members = posted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(count, F.col("file"))).cast("int"))
    found = _best(_met(members, asked.mapInArrow(_posted(pivot, VISITED, blocks), schema), len(pivot), k, AGAIN), k)
    found = common.materialise(found, "neighbours")

    # queries for which the files held too few: all rows, in blocks
    n = rows.count()
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
    short = common.materialise(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if n < 2 or short.isEmpty():
        return found
    parts = -(-n // BLOCK)
    packed = lambda df: df.mapInArrow(_posted(pivot, 1, None), schema)
    everyone = packed(rows).withColumns({"file": F.lit(0), "block": F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")})
    they = packed(short).withColumns({"file": F.lit(0), "block": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    rest = _best(_met(everyone, they.select(everyone.columns), len(pivot), k, 1.0), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
