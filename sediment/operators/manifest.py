"""The state of the files as a fold over version edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(edits: DataFrame) -> DataFrame:
    """Files after all edits (edit_no, added array of files, removed array of files).

    Within one edit removals come first. Removing an unknown file does nothing.
    """
    action = lambda c, rank: edits.select("edit_no", F.explode(c).alias("f"), F.lit(rank).alias("rank"))
    each = action("removed", 0).unionByName(action("added", 1))
    last = each.groupBy("f.path").agg(F.max_by(F.struct("rank", "f"), F.struct("edit_no", "rank")).alias("last"))
    return last.where("last.rank = 1").select("last.f.*")


def next_numbers(files: DataFrame) -> DataFrame:
    """One row: the next sequence number, never under one already given."""
    return files.agg((F.coalesce(F.max("seq_num"), F.lit(-1)) + 1).cast("long").alias("next_seq"))
