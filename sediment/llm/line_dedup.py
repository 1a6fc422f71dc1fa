"""Line dedup over overlapping three-line windows.

Method: the lines of a document (split at ``\\n``, compared exactly) give one
window for every three consecutive lines. Windows are hashed (two 64-bit
hashes), the hashes that occur more than once are found over all documents, and
of each repeated window every occurrence but the first, in order of
(doc_id, position), is removed. Covered positions of several windows merge, since
a position is removed once however many windows cover it.

Defined results
* null text: stays null, has no lines; empty text: one empty line, no window.
* fewer than three lines: no window, unchanged.
* a window of three blank lines isn't text and is never removed.
* a later occurrence that overlaps the first one in the same document keeps the
  lines of the first.
* rows that repeat both doc_id and text are one document and stay as they are;
  a null doc_id is a value of its own that orders first.
* an empty table gives an empty table; other columns pass through unchanged.

Scale: one shuffle of 16-byte hashes with map-side combining finds the repeated
windows; only these meet the windows again. A window that a third of all
documents share is one row on the small side, and the large side of that join is
an ordinary shuffled side that adaptive execution splits. Text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3


def _windows(lines: Column) -> Column:
    """An array of (position, two hashes) for the windows that hold text."""
    starts = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>"))
    at = lambda i, k: F.get(lines, i + k)
    blank = lambda i: F.trim(F.concat_ws("", *(at(i, k) for k in range(WINDOW)))) == ""
    return F.transform(
        F.filter(starts, lambda i: ~blank(i)),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(at(i, k) for k in range(WINDOW))).alias("h1"),
            F.xxhash64(F.lit(WINDOW), *(at(i, k) for k in range(WINDOW))).alias("h2"),
        ),
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """(_doc, _text_hash, _removed): the sorted line positions that go, for each document that loses any."""
    windows = (
        docs.where(F.col("text").isNotNull())
        .select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text_hash"), F.split("text", "\n").alias("_lines"))
        .select("_doc", "_text_hash", F.inline(_windows(F.col("_lines"))))
    )
    place = F.struct("_doc", "_text_hash", "pos")
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    later = windows.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(~F.col("first").eqNullSafe(place))
    same = F.col("first._doc").eqNullSafe(F.col("_doc")) & (F.col("first._text_hash") == F.col("_text_hash"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    return (
        later.select("_doc", "_text_hash", start.alias("a"), (F.col("pos") + WINDOW).alias("b"))
        .where("a < b")
        .groupBy("_doc", "_text_hash")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("a"), F.col("b") - 1))))).alias("_removed"))
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_removed`` added (replacing columns of these names)."""
    removed = removed_lines(docs).select(F.col("_doc").alias("_ld_doc"), F.col("_text_hash").alias("_ld_hash"), F.col("_removed").alias("_ld_removed"))
    joined = docs.join(removed, F.col("doc_id").eqNullSafe(F.col("_ld_doc")) & (F.xxhash64("text") == F.col("_ld_hash")), "left")
    lines = F.col("_ld_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_removed"))
    return (
        joined.withColumn("_ld_lines", F.split("text", "\n"))
        .withColumns(
            {
                "text": F.when(F.col("_ld_removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")),
                "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
                "n_removed": F.coalesce(F.size("_ld_removed"), F.lit(0)).cast("long"),
            }
        )
        .drop("_ld_doc", "_ld_hash", "_ld_removed", "_ld_lines")
    )
