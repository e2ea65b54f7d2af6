"""Reproducible pseudo-random numbers as column expressions.

Every draw is a function of (key, seed[, position]), so retries, repartitioning and other
engines give the same values.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def hash32(key: Column, seed: int | str = 42) -> Column:
    """First 32 bits of md5(key|seed) as BIGINT."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed: int | str = 42) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(key, seed) / F.lit(float(TWO32))


def mix32(state: Column) -> Column:
    """Two multiply/xor-shift rounds over a 32-bit state; cheap enough to run per character."""
    x = F.pmod(state * F.lit(1103515245) + F.lit(12345), F.lit(TWO32))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = F.pmod(x * F.lit(1664525) + F.lit(1013904223), F.lit(TWO32))
    return x.bitwiseXOR(F.shiftright(x, 13))


def position_hash(seed: Column, position: Column, stream: int = 0) -> Column:
    """32-bit draw for a position of a row whose 32-bit seed is given."""
    start = F.pmod(seed + position.cast("bigint") * F.lit(2654435) + F.lit(stream * 40503), F.lit(TWO32))
    return mix32(start)


def position_uniform(seed: Column, position: Column, stream: int = 0) -> Column:
    return position_hash(seed, position, stream) / F.lit(float(TWO32))
