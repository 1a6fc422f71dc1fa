"""Level management as functions of the table of files (path, level, min_key, max_key, file_size, seq_num)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.model import CompactionConfig


def level_size(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("file_size").alias("level_size"))


def level_count(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("level_count"))


def level_limit(level: Column, config: CompactionConfig) -> Column:
    """The size from which a level is too large: none for level 0. Exact, in whole numbers."""
    powers = F.create_map(*(F.lit(v).cast("long") for n in range(1, config.max_levels) for v in (n, config.l1_max_bytes * config.multiplier ** (n - 1))))
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(F.element_at(powers, level.cast("long")))


def level_limits(spark: SparkSession, config: CompactionConfig) -> DataFrame:
    return spark.range(config.max_levels).select(F.col("id").alias("level"), level_limit(F.col("id"), config).alias("max_size"))


def needs_compaction(files: DataFrame, config: CompactionConfig) -> DataFrame:
    """One row: the level to compact, or -1. Level 0 goes by its number of files, the last level never."""
    sizes = files.groupBy("level").agg(F.sum("file_size").alias("s"), F.count(F.lit(1)).alias("n"))
    due = sizes.where(
        ((F.col("level") == 0) & (F.col("n") >= config.l0_threshold))
        | (F.col("level").between(1, config.max_levels - 2) & (F.col("s") > level_limit(F.col("level"), config)))
    )
    return due.agg(F.coalesce(F.min("level"), F.lit(-1)).alias("level"))


def pick_input(files: DataFrame, level: int) -> DataFrame:
    """What a compaction of ``level`` takes: all files of level 0, else the oldest file."""
    own = files.where(F.col("level") == level)
    return own if level == 0 else own.orderBy("seq_num").limit(1)


def overlapping(files: DataFrame, low: Column | str, high: Column | str) -> DataFrame:
    """Files whose key range meets [low, high], ends included."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return files.where((F.col("min_key") <= lit(high)) & (F.col("max_key") >= lit(low)))


def overlaps(files: DataFrame) -> DataFrame:
    """(path, other): pairs of files of neighbouring levels whose key ranges meet."""
    a, b = files.alias("a"), files.alias("b")
    met = (F.col("b.level") == F.col("a.level") + 1) & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("a.max_key") >= F.col("b.min_key"))
    return a.join(b, met).select(F.col("a.path").alias("path"), F.col("b.path").alias("other"))


def has_below(files: DataFrame, config: CompactionConfig) -> DataFrame:
    """(level, has_below) for every level: whether a deeper one has files."""
    deepest = files.where(F.col("level") < config.max_levels).agg(F.max("level").alias("deepest"))
    return files.sparkSession.range(config.max_levels).select(F.col("id").alias("level")).crossJoin(F.broadcast(deepest)).select("level", F.coalesce(F.col("deepest") > F.col("level"), F.lit(False)).alias("has_below"))


#: Cells into which the range of keys is cut for a join of keys with files.
CELLS = 64


def files_for_keys(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, files): how many files a lookup of each key may have to read.

    The range of keys is cut into cells at the first keys of some files. A file is listed
    in each cell that it reaches into, and meets the keys of that cell by an
    equality join, so no key is compared with files of other cells. The table of
    files is one that its store's driver holds anyway.
    """
    firsts = [r.min_key for r in files.select("min_key").distinct().orderBy("min_key").collect()]
    bounds = sorted({firsts[len(firsts) * i // CELLS] for i in range(1, CELLS)}) if len(firsts) > 1 else []
    cell = lambda key: reduce(add, (F.when(F.col(key) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    listed = files.select("min_key", "max_key", F.explode(F.sequence(cell("min_key"), cell("max_key"))).alias("_cell"))
    met = keys.select("key", cell("key").alias("_cell")).join(listed, "_cell").where((F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key")))
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("files"))


def add_files(files: DataFrame, added: DataFrame) -> DataFrame:
    return files.unionByName(added)


def remove_files(files: DataFrame, removed: DataFrame) -> DataFrame:
    return files.join(removed.select("level", "path"), ["level", "path"], "left_anti")
