"""Chat formatting with collapse of cumulative snapshots (DataFrame functions only).

Method: a conversation is logged again and again as it grows, so many logged
conversations are prefixes of longer ones. A rolling hash over the turns gives one
hash for each prefix; a conversation whose whole hash is among the proper-prefix
hashes of others is not maximal and goes by an anti-join. Of conversations with the
same turns the one with the smallest conv_id stays. What stays is rendered.

Rendering: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In role and text
a backslash becomes two and ``<|`` becomes ``<\\|``, so no text can forge a marker
and the rendering can be undone.

Defined results
* turns are ordered by (turn, role, text), nulls first; rows that repeat all four
  columns are one turn.
* null role or text: rendered as empty, and equal to empty for prefixes.
* null conv_id: such rows belong to no conversation that could be told apart, so each
  different one is a conversation of one turn, whose id is null.
* a conversation never goes because of itself; equal ones leave one.
* an empty table gives an empty table; other columns take no part.

Scale: turns move once, to their conversation; a prefix's hash is a running
exclusive or over hashes of (place, role, text), so it takes one step a turn however
long a conversation is. After that only hashes move. The prefix hashes are made
distinct with map-side combining, so a first turn that a third of all conversations
share is one row, and whole hashes are unique before the anti-join, so neither side
of it has a hot key. A rendered conversation is one value, so it has to fit in a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm import common

#: Fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), _escaped(t.role), F.lit("\n"), _escaped(t.text), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


#: What names a conversation: its id as text, and, for rows without one, a digest of the row.
_KEY = ["_conv", "_own"]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(_conv, _own, conv_id, pos, role, text, h1, h2): the different turns with their places from 1 and the hashes of the prefixes that they end."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)).otherwise("")
    rows = rows.withColumns({"_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_own": own})
    w = W.partitionBy(*_KEY).orderBy("turn", "role", "text")
    again = (F.row_number().over(w) > 1) & reduce(and_, (F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")))
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_new", (~again).cast("int")).withColumn("pos", F.sum("_new").over(so_far)).where("_new = 1")
    prefix = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "text")).over(so_far)
    return rows.select(*_KEY, "conv_id", "pos", "role", "text", prefix(1).alias("h1"), prefix(2).alias("h2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_copies): conversations that no longer one starts with; n_copies counts equal ones."""
    rows = common.materialise(hashed_turns(conversations), "turns")
    ends = rows.select(*_KEY, "conv_id", "pos", "h1", "h2").withColumn("n", F.max("pos").over(W.partitionBy(*_KEY)))
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", *_KEY)).alias("first")
    whole = ends.where("pos = n").groupBy("n", "h1", "h2").agg(first, F.count(F.lit(1)).alias("n_copies"))
    prefixes = ends.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select(*(F.col(f"first.{c}").alias(c) for c in _KEY), F.col("n").alias("n_turns"), "n_copies")
    turns = F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")
    return rows.join(kept, _KEY).groupBy(*_KEY, "conv_id", "n_turns", "n_copies").agg(turns).select("conv_id", "turns", "n_turns", "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    return maximal(conversations).select("conv_id", "n_turns", "n_copies", _rendered(F.col("turns")).alias("rendered"))
