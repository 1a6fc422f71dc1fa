"""Order-dependent packing of entries: data blocks, output files, buffer rotations.

A running sum that starts anew at each cut isn't a window function, and where a
cut falls depends on all entries before it, so each of these is one pass over the
sorted entries of one run. A run is a unit of bounded size by its own settings;
many runs are packed side by side, one group each.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 4096


def block_numbers(sizes: list[int], target: int = BLOCK_BYTES) -> list[int]:
    """Cut after the entry with which a block reaches its target."""
    out, block, held = [], 0, 0
    for s in sizes:
        out.append(block)
        held += s
        if held >= target:
            block, held = block + 1, 0
    return out


def file_numbers(sizes: list[int], most: int) -> list[int]:
    """Cut before the entry that would exceed the limit; a file's first entry is always taken; 0: no limit."""
    out, file, held = [], 0, 0
    for s in sizes:
        if most and held and held + s > most:
            file, held = file + 1, 0
        out.append(file)
        held += s
    return out


def rotations(keys: list[str], sizes: list[int], limit: int) -> list[int]:
    """The buffer that takes each write: an update changes a buffer's size in place, and may always shrink it.

    A write that no empty buffer could take has a buffer of its own.
    """
    out, buffer, held, total = [], 0, {}, 0
    for k, s in zip(keys, sizes, strict=True):
        grown = total + s - held.get(k, 0)
        if limit and held and grown > limit and s > held.get(k, -1):
            buffer, held, grown = buffer + 1, {}, s
        held[k], total = s, grown
        out.append(buffer)
    return out


def _by_run(df: DataFrame, run: str, order: list[str], name: str, number: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**{name: pd.Series(number(rows), index=rows.index, dtype="int64")})

    return df.groupBy(run).applyInPandas(pack, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def cut_blocks(df: DataFrame, run: str, order: list[str], size: str, target: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with ``block``: the data block of each entry within its run."""
    return _by_run(df, run, order, "block", lambda r: block_numbers(r[size].tolist(), target))


def split_output(df: DataFrame, run: str, order: list[str], size: str, most: int) -> DataFrame:
    """``df`` with ``file``: the output file of each entry within its run."""
    return _by_run(df, run, order, "file", lambda r: file_numbers(r[size].tolist(), most))


def rotate_buffers(df: DataFrame, run: str, order: list[str], key: str, size: str, limit: int) -> DataFrame:
    """``df`` with ``buffer``: the buffer that takes each write of a stream of writes."""
    return _by_run(df, run, order, "buffer", lambda r: rotations(r[key].tolist(), r[size].tolist(), limit))
