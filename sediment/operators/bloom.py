"""Bloom filters as relations: sizing, bit positions, building and probing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.entries import fnv1a

WORD = 64


def clamped(bits: int, hashes: int) -> tuple[int, int]:
    """At least one word of bits, in whole words, and at least one hash."""
    return -(-max(bits, WORD) // WORD) * WORD, max(1, hashes)


def optimal(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys at a false-positive rate ``p``."""
    n, p = max(n, 1), p if 0 < p < 1 else 0.01
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return clamped(m, math.ceil(m / n * math.log(2)))


def optimal_size(n: Column, p: Column) -> Column:
    """``optimal`` as a column: a struct of num_bits and num_hash."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    p = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.01))
    m = F.ceil(-n * F.ln(p) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))
    bits = (F.ceil(F.greatest(m, F.lit(WORD)) / WORD) * WORD).cast("long")
    return F.struct(bits.alias("num_bits"), F.greatest(F.ceil(m / n * F.ln(F.lit(2.0))), F.lit(1)).cast("long").alias("num_hash"))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: (h1 + i * h2 mod 2**32) mod bits, from the halves of its 64-bit hash."""
    halves = F.transform(F.array(fnv1a(key)), lambda h: F.struct(h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("a"), F.shiftrightunsigned(h, 32).alias("b")))
    at = lambda x: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: ((x.a + i * x.b) % F.lit(1 << 32)) % bits)
    return F.get(F.transform(halves, at), F.lit(0))


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(bit): the bits that are set, at most ``bits`` rows."""
    return keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def probe(keys: DataFrame, key: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, may_contain) for each different key: whether all its bits are set. Keys and filter meet by an equality join on the bit, so neither has to fit in a task."""
    asked = keys.select(key).distinct().select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("_bit"))
    found = asked.join(filter_bits.select(F.col("bit").alias("_set")), F.col("_bit") == F.col("_set"), "left")
    return found.groupBy(key).agg(F.bool_and(F.col("_set").isNotNull()).alias("may_contain"))
