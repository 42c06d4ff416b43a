"""Signals as array<double> columns: level, gain, mixing, convolution, resampling, channels, quantisation.

An expression that a lambda mentions is computed again for each element, so arguments that are used inside one are bound by
``let`` first. A null sample makes sums and what is made of them null, as in SQL. NaN is never the smallest or largest by accident: Spark orders it above all numbers, and rules say what it gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, SILENT_DB, TINY = 1e-12, -120.0, 1e-8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def rms(x: Column) -> Column:
    """Root mean square; silence, an empty signal and NaN give the floor."""
    r = let(x, lambda x: F.sqrt(total(x, lambda v: v * v) / F.nullif(F.size(x), F.lit(0))))
    return let(r, lambda r: F.when((r > 0) & ~F.isnan(r), r).otherwise(F.lit(FLOOR)))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    return F.greatest(20 * F.log10(F.greatest(x, F.lit(FLOOR))), F.lit(SILENT_DB))


def clamp(v: Column, lo: float, hi: float) -> Column:
    """lo..hi; NaN stays."""
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def scaled(x: Column, g: Column) -> Column:
    return let(g, lambda g: F.transform(x, lambda v: v * g))


def clipped(x: Column) -> Column:
    return F.transform(x, lambda v: clamp(v, -1.0, 1.0))


def snr_gain(clean: Column, noise: Column, snr_db: Column) -> Column:
    """What noise is multiplied by to stand snr_db below clean."""
    return rms(clean) / db_to_linear(snr_db) / rms(noise)


def mixed(clean: Column, noise: Column, gain: Column) -> Column:
    return let(gain, lambda g: F.zip_with(clean, noise, lambda a, b: a + b * g))


def normal_gain(peak_value: Column, target: float) -> Column:
    """The gain that brings a peak to target; what is nearly silent stays."""
    return let(peak_value, lambda p: F.when(p < TINY, F.lit(1.0)).otherwise(F.lit(target) / p))


def convolved(x: Column, h: Column) -> Column:
    """The first size(x) samples of the convolution with h: direct, for short arrays; kernels.convolve() is for long ones."""

    def at(x: Column, h: Column) -> Column:
        tap = lambda k: F.aggregate(F.sequence(F.lit(0), F.least(k, F.size(h) - 1)), F.lit(0.0), lambda a, j: a + F.get(x, k - j) * F.get(h, j))
        return F.when((F.size(x) == 0) | (F.size(h) == 0), F.transform(x, lambda v: F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.size(x) - 1), tap))

    return let(F.struct(x.alias("x"), h.alias("h")), lambda s: at(s["x"], s["h"]))


def segment(x: Column, length: int, u: Column) -> Column:
    """length samples of x from a place drawn by u; a shorter signal stands at a place drawn by u among zeros."""

    def cut(x: Column, u: Column) -> Column:
        start = F.floor(u * (F.abs(F.size(x) - length) + 1)).cast("int")
        padded = F.concat(F.array_repeat(F.lit(0.0), start), x, F.array_repeat(F.lit(0.0), F.lit(length) - start - F.size(x)))
        return F.when(F.size(x) >= length, F.slice(x, start + 1, F.lit(length))).otherwise(padded)

    return let(F.struct(x.alias("x"), u.alias("u")), lambda s: cut(s["x"], s["u"]))


def places(n: Column) -> Column:
    """0, 1, ... n - 1; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def downmixed(frames: Column) -> Column:
    return F.transform(frames, lambda f: total(f) / F.size(f))


def frames_of(x: Column, channels: int) -> Column:
    """Interleaved samples as frames; samples short of a frame are left out."""
    return let(x, lambda x: F.transform(places((F.size(x) / channels).cast("int")), lambda i: F.slice(x, i * channels + 1, F.lit(channels))))


def first_channels(frames: Column, channels: int) -> Column:
    """The first so many channels of each frame."""
    return F.transform(frames, lambda f: F.slice(f, 1, channels))


def fanned_out(frames: Column, channels: int) -> Column:
    """Each frame's channels repeated and cut to so many."""
    return F.transform(frames, lambda f: F.slice(F.flatten(F.array_repeat(f, channels)), 1, channels))


def resampled(x: Column, up: int, down: int, taps: list[float]) -> Column:
    """Zeros between samples, a filter around each output sample, every down-th one kept: ceil(n * up / down) samples."""
    h = F.array(*map(F.lit, taps))
    middle = len(taps) // 2

    def run(x: Column) -> Column:
        def at(m: Column) -> Column:
            def add(a: Column, j: Column) -> Column:
                i = m * down + middle - j
                inside = (i >= 0) & (i % up == 0) & (i < F.size(x) * up)
                return a + F.when(inside, F.get(x, (i / up).cast("int")) * F.get(h, j)).otherwise(F.lit(0.0))

            return F.aggregate(F.sequence(F.lit(0), F.lit(len(taps) - 1)), F.lit(0.0), add)

        return F.transform(places(F.ceil(F.size(x) * up / down).cast("int")), at)

    return let(x, run)


def pcm16(x: Column) -> Column:
    return F.transform(x, lambda v: F.round(clamp(v, -1.0, 1.0) * 32767).cast("smallint"))


def blended(dry: Column, wet: Column, strength: Column) -> Column:
    """Dry and wet at a strength of 0..1."""
    return let(clamp(strength, 0.0, 1.0), lambda s: F.zip_with(dry, wet, lambda a, b: (1 - s) * a + s * b))


def checksum(x: Column) -> Column:
    """A weighted sum to six places, for comparing arrays; never minus zero."""
    weighted = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("i")), lambda a, v: F.struct((a["s"] + a["i"] * v).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
    return F.round(weighted, 6) + F.lit(0.0)


def level_label(db: Column) -> Column:
    return F.when(db <= SILENT_DB, F.lit("-∞")).otherwise(F.format_string("%.0f", db))


def gain_label(db: Column) -> Column:
    return F.format_string("%+.1f dB", db)


def percent_label(percent: Column) -> Column:
    return F.format_string("%d %%", percent.cast("long"))


# Fixed value: the wording of the status line.
def status_text(faults: Column) -> Column:
    """What the status line says; faults only if there were any."""
    return F.concat(F.lit("Engine running"), F.when(faults > 0, F.format_string("  |  x-runs: %d", faults)).otherwise(F.lit("")))


def meter_value(db: Column) -> Column:
    return F.greatest(F.lit(-60), F.least(F.lit(0), db.cast("int")))
