"""Best-fit packing into sequences of several permitted lengths.

Method: variable-capacity best-fit. Pieces come in order of falling length. A
piece goes into the open bin with the least room that still holds it; if none
does, a bin is opened, and its size is the one of the permitted sizes that costs
least per token it may come to hold: ``(size + overhead) / min(size, length +
what is still unplaced and fits beside it)``, ties to the smaller size. So all
sizes are weighed together against the pieces that are left. At the end each bin
shrinks to the smallest permitted size that holds its contents.

A document longer than the largest size is cut into full pieces of that size and
a rest; full pieces are bins of their own, so only one piece for each document
has to be packed.

Defined results
* a document of no tokens (null or empty text) has one row with piece 0, length
  0 and no bin (null bin columns): nothing is dropped, and no bin is spent on it.
* repeated rows and null doc_id are pieces like any other.
* an empty table gives no rows; other columns take no part.

Scale: lengths are packed in shards of about ``SHARD_PIECES`` pieces, whose number
follows from a count of the table, so a task's memory is bounded whatever the
table's size. Pieces are dealt to shards in turn, not by key, so no key can be
hot. Bins don't cross shards, which costs a few part-filled bins a shard. Text
never moves: only document ids and lengths do.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

SIZES = (512, 1024, 2048, 4096)
#: What a bin costs besides its length, in tokens.
OVERHEAD = 48
SHARD_PIECES = 50_000

#: The words that are counted as tokens unless another length is given.
WORDS = r"[^\x20\x09-\x0D]+"

_OUT = pa.schema([("row", pa.int64()), ("bin", pa.int64()), ("size", pa.int64()), ("at", pa.int64())])


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, offset, final bin size) of each length, in the order given. Lengths are from 1 to the largest size."""
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [-lengths[i] for i in order]
    volume = [0] * (len(order) + 1)  # of the pieces from this one on
    for k in range(len(order) - 1, -1, -1):
        volume[k] = volume[k + 1] - falling[k]
    room: list[int] = []  # the different rooms of open bins, rising
    by_room: dict[int, list[int]] = {}
    filled: list[int] = []
    opened: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k, i in enumerate(order):
        length = lengths[i]
        at = bisect_left(room, length)
        if at < len(room):
            bins = by_room[room[at]]
            b = bins.pop()
            if not bins:
                del by_room[room[at]], room[at]
        else:
            def cost(size: int) -> float:
                rest = volume[max(k + 1, bisect_left(falling, length - size))]
                return (size + overhead) / min(size, length + rest)

            opened.append(min((s for s in sizes if s >= length), key=cost))
            filled.append(0)
            b = len(filled) - 1
        place[i] = (b, filled[b])
        filled[b] += length
        if left := opened[b] - filled[b]:
            if left not in by_room:
                insort(room, left)
                by_room[left] = []
            by_room[left].append(b)
    final = [sizes[bisect_left(sizes, f)] for f in filled]
    return [(b, at, final[b]) for b, at in place]


def _shard(sizes: tuple[int, ...], overhead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        # what a shard holds doesn't depend on the order in which its rows arrive
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        placed = pack(rows["length"].to_pylist(), sizes, overhead)
        shard = TaskContext.get().partitionId()
        b, at, size = (pa.array([p[k] for p in placed], pa.int64()) for k in range(3))
        shards = pa.array([shard] * len(placed), pa.int64())
        for name, column in (("shard", shards), ("bin", b), ("offset", at), ("bin_size", size)):
            rows = rows.append_column(name, column)
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def best_fit_packing(docs: DataFrame, length: Column | None = None, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece (from 0), start and length (tokens of the document), bin_id, bin_size, offset.

    ``length`` gives a document's tokens (words, if none is given). A bin_id is
    unique in the result.
    """
    largest = max(sizes)
    tokens = F.greatest(F.coalesce((n_words(F.col("text")) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    # words are counted once; all that follows reads ids and lengths
    lengths = common.materialise(docs.select("doc_id", tokens.alias("tokens")), "lengths")
    full = F.floor(F.col("tokens") / largest).cast("long")
    whole = (
        lengths.where(F.col("tokens") >= largest)
        .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
        .select(
            "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.lit(largest).cast("long").alias("length"),
            F.concat(F.lit("f"), F.hex(F.monotonically_increasing_id())).alias("bin_id"), F.lit(largest).cast("long").alias("bin_size"), F.lit(0).cast("long").alias("offset"),
        )
    )
    empty = lengths.where(F.col("tokens") == 0).select(
        "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("piece", "start", "length")), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_size"), F.lit(None).cast("long").alias("offset")
    )
    rest = lengths.where(F.col("tokens") % largest > 0).select("doc_id", full.alias("piece"), (full * largest).alias("start"), (F.col("tokens") % largest).alias("length"))
    n = lengths.count()
    shards = max(1, -(-n // shard_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = (
        rest.repartition(shards)
        .mapInArrow(_shard(tuple(sizes), overhead), f"doc_id {kind}, piece long, start long, length long, shard long, bin long, offset long, bin_size long")
        .select("doc_id", "piece", "start", "length", F.concat(F.lit("s"), F.col("shard").cast("string"), F.lit("-"), F.col("bin").cast("string")).alias("bin_id"), "bin_size", "offset")
    )
    return whole.unionByName(packed).unionByName(empty)
