"""Shoebox rooms: drawn sizes, positions and wall absorption, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.config import BuildConfig
from pairwave.functions.rng import between, uniform

#: Speed of sound in m/s, and the largest order of reflections (fixed values).
SOUND, MOST_ORDER = 343.0, 50
AXES = "xyz"


def absorption(rt60: Column, d: list[Column]) -> Column:
    """Wall absorption that gives a reverberation time by Sabine's formula; over 1, no wall is that absorbent."""
    volume, surface = d[0] * d[1] * d[2], 2 * (d[0] * d[1] + d[0] * d[2] + d[1] * d[2])
    return F.lit(24.0) * F.log(F.lit(10.0)) * volume / (F.lit(SOUND) * surface * rt60)


def full_order(rt60: Column, d: list[Column]) -> Column:
    """Order of reflections that the reverberation time spans."""
    across = [a * b / F.sqrt(a * a + b * b) for a, b in ((d[0], d[1]), (d[0], d[2]), (d[1], d[2]))]
    return F.ceil(F.lit(SOUND) * rt60 / F.least(*across) - 1).cast("long")


def rooms(rows: DataFrame, c: BuildConfig) -> DataFrame:
    """rows (global_idx) with dim_*, rt60, mic_*, absorption, max_order, order_capped, feasible."""
    u = lambda slot: uniform(c.seed, F.col("global_idx"), slot)
    sized = rows.select("*", *(between(u(f"room_{a}"), *r).alias(f"dim_{a}") for a, r in zip(AXES, c.room_dim_range, strict=True)), between(u("rt60"), *c.rt60_range).alias("rt60"))
    d = [F.col(f"dim_{a}") for a in AXES]
    out = sized.select("*", *((F.col(f"dim_{a}") / 2 + between(u(f"mic_{a}"), -0.5, 0.5)).alias(f"mic_{a}") for a in AXES), absorption(F.col("rt60"), d).alias("absorption"), full_order(F.col("rt60"), d).alias("full_order"))
    return out.select("*", F.least("full_order", F.lit(MOST_ORDER)).alias("max_order"), (F.col("full_order") > MOST_ORDER).alias("order_capped"), (F.col("absorption") <= 1).alias("feasible"))


def position(seed: int, name: str, distance: tuple[float, float], rise: float) -> list[Column]:
    """A source around the microphone: drawn distance, angle and height, kept 0.1 m from the walls."""
    u = lambda slot: uniform(seed, F.col("global_idx"), f"{name}_{slot}")
    away, angle = between(u("d"), *distance), between(u("angle"), 0.0, 6.283185307179586)
    free = [F.col("mic_x") + away * F.cos(angle), F.col("mic_y") + away * F.sin(angle), F.col("mic_z") + between(u("z"), -rise, rise)]
    return [F.greatest(F.lit(0.1), F.least(p, F.col(f"dim_{a}") - 0.1)).alias(f"{name}_{a}") for p, a in zip(free, AXES, strict=True)]


def sources(rooms_: DataFrame, c: BuildConfig) -> DataFrame:
    return rooms_.select("*", *position(c.seed, "near", c.nearfield_dist, 0.3), *position(c.seed, "far", c.farfield_dist, 0.5))
