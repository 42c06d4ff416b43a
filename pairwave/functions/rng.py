"""A counter-based generator: a draw depends on seed, row number and the draw's name, and not on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, idx: Column, slot: str) -> Column:
    """A number in [0, 1), from 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), idx.cast("string"), F.lit(slot)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * u


def pick(u: Column, n: Column | int) -> Column:
    """A position in 0..n-1."""
    return F.floor(u * n).cast("long")
