"""Column functions over keys, values and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an encoded entry besides its key and value: two lengths and the flags. A fixed value.
ENTRY_OVERHEAD = 9

#: FNV-1a with 64 bits: the offset basis as a signed number; the prime is 2**40 + LOW. Fixed values.
BASIS, LOW = -3750763034362895579, 435

_M32 = 0xFFFFFFFF


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes that an entry counts for in a buffer; a deletion counts for its key."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def encoded_bytes(key: Column, value: Column) -> Column:
    """Bytes of an entry in a file."""
    return entry_bytes(key, value) + ENTRY_OVERHEAD


def little_endian(n: Column) -> Column:
    """A number under 2**32 as four bytes, the lowest first."""
    bytes_ = [F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]
    return F.unhex(F.concat(*bytes_))


def encoded(key: Column, value: Column, deleted: Column) -> Column:
    """An entry as a file holds it: key length, key, flags, value length, value."""
    v = F.coalesce(value.cast("binary"), F.lit(b""))
    flags = F.when(deleted, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return F.concat(little_endian(F.octet_length(key)), key.cast("binary"), flags, little_endian(F.octet_length(v)), v)


def byte_values(key: Column) -> Column:
    """The bytes of a string or binary as numbers from 0 to 255."""
    h = F.hex(key.cast("binary"))
    places = F.filter(F.sequence(F.lit(1), F.octet_length(key)), lambda i: (i >= 1) & (i <= F.octet_length(key)))
    return F.transform(places, lambda i: F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a(key: Column) -> Column:
    """FNV-1a of the key's bytes, as a signed 64-bit number; no step of it overflows."""

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        low, high = x.bitwiseAND(F.lit(_M32)), F.shiftrightunsigned(x, 32)
        low_product = low * LOW
        carried = high * LOW + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8) + F.shiftrightunsigned(low_product, 32)
        return F.shiftleft(carried.bitwiseAND(F.lit(_M32)), 32).bitwiseOR(low_product.bitwiseAND(F.lit(_M32)))

    return F.aggregate(byte_values(key), F.lit(BASIS).cast("long"), step)


def file_number(path: Column) -> Column:
    """The number in a run's file name, or null."""
    return F.regexp_extract(path, r"(?:^|/)sstable_(\d+)(?:\.sst)?$", 1).try_cast("long")


def file_name(number: Column) -> Column:
    return F.format_string("sstable_%06d.sst", number)
