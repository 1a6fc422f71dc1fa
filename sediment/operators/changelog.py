"""The changelog view: latest row of each key, and what follows from it.

A changelog has a key, a total order of its rows, and a deletion flag. Deletions
are taken out after the latest row has been found, never before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, window: bool = False) -> DataFrame:
    """Of each key the row that is greatest in ``order``.

    One exchange, with a reduction on the map side in either form; the window form
    takes orders that mix directions (columns such as ``F.asc("level")``, greatest last
    read as: first in the order given).
    """
    if window:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order) if len(order) > 1 else order[0])
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def live(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], tombstone: str = "tombstone", *, window: bool = False) -> DataFrame:
    """The latest row of each key that isn't deleted."""
    return latest_per_key(df, keys, order, window=window).where(~F.col(tombstone)).drop(tombstone)


def merge(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several sources with unique keys, newest source first: the first source that has a key gives its row.

    Deletions are passed on.
    """
    numbered = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    together = reduce(DataFrame.unionByName, numbered)
    return latest_per_key(together, keys, [-F.col("_source")]).drop("_source")


def superseded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the number of rows that its latest one hides."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("superseded"))


def compacted(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, drop_tombstones: bool, window: bool = False) -> DataFrame:
    """What a compaction of these rows writes."""
    kept = latest_per_key(df, keys, order, window=window)
    return kept.where(~F.col("tombstone")) if drop_tombstones else kept


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Physical removal: the rows whose key isn't in ``gone``."""
    return df.join(gone, list(keys), "left_anti")
