"""Connected components of an edge table, without ever holding one in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm import common

#: Rounds after which something must be wrong: the number needed grows with the logarithm of a component's size.
MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large-star and small-star over (u, v) with u > v: each vertex is hung below the smallest one it meets."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    small = large.join(lower, F.col("u") == F.col("k"))
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): every node that has an edge, with the smallest node of its component.

    Alternating large and small stars, each round written to the shared folder. A
    hub's edges are found by aggregates with map-side combining and by shuffled
    joins that adaptive execution splits.
    """
    now = common.materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        now = common.materialise(_stars(now), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def row_key() -> Column:
    """A hash of doc_id and text; rows that share it are equal in both."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each label of ``members`` (doc_id, row, label): that of the smallest doc_id, nulls last, and of its texts that of the smallest hash."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    kept = members.groupBy("label").agg(best).select(F.col("best.row").alias("_kept"))
    rows = docs.withColumn("_row", row_key()).join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("_row").orderBy("_row"))).where("_nth = 1").select(*docs.columns)
