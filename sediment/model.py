"""Schemas, settings and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class StoreError(Exception):
    """Base of the engine's errors."""


class StoreClosed(StoreError):
    """A write to a closed store."""


class NilValue(StoreError):
    """A put without a value; an empty value is one, and deletes are written with ``delete``."""


class BufferFull(StoreError):
    """A write that doesn't fit into a bounded buffer."""


class BufferFrozen(StoreError):
    """A write to a frozen buffer."""


class NothingToWrite(StoreError):
    """A run of no entries."""


class DuplicateKeys(StoreError):
    """A batch that has several rows for a key and no column to order them."""


class CommitConflict(StoreError):
    """Files that a commit removes are gone already."""


class CorruptFooter(StoreError):
    """A file too short for its footer, or one whose footer points outside it."""


class InvalidMagic(StoreError):
    """A file that isn't of the expected format."""


MIB = 1 << 20


@dataclass(frozen=True)
class CompactionConfig:
    l0_threshold: int = 4
    multiplier: int = 10
    l1_max_bytes: int = 10 * MIB
    max_output_bytes: int = 2 * MIB
    max_levels: int = 7

    def __post_init__(self):
        if self.l0_threshold < 1 or self.multiplier < 1 or self.l1_max_bytes < 1 or self.max_levels < 2 or self.max_output_bytes < 0:
            raise ValueError("a compaction setting is out of range")


#: Levels for tables of terabytes: files of 256 MiB, a first level of 64 GiB.
LARGE = CompactionConfig(l1_max_bytes=64 * 1024 * MIB, max_output_bytes=256 * MIB)


@dataclass(frozen=True)
class StoreConfig:
    """``file_bytes`` is the size of a bulk write's files; a put waits while ``max_frozen`` full buffers are still to be written."""

    path: str = ""
    max_mem_bytes: int = 4 * MIB
    compaction: CompactionConfig = field(default_factory=CompactionConfig)
    bloom_fpr: float = 0.01
    file_bytes: int = 256 * MIB
    max_frozen: int = 4
    background: bool = False

    def __post_init__(self):
        if not self.path:
            raise ValueError("path must be set")
        if self.max_mem_bytes < 0:
            raise ValueError("max_mem_bytes must not be negative")
        if self.file_bytes < 1 or self.max_frozen < 1:
            raise ValueError("file_bytes and max_frozen must be positive")


def entry_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("key", key or T.StringType(), False),
            T.StructField("value", value or T.BinaryType()),
            T.StructField("tombstone", T.BooleanType(), False),
            T.StructField("seq", T.LongType(), False),
        ]
    )
