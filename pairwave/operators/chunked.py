"""Signals longer than a row: chunks (id, chunk, total, x) of ``size`` samples each, convolved and resampled where they are.

What a chunk owes its neighbours is sent to them: the tails of a convolution, or the samples at the edges that a filter needs. A task holds
batches of chunks, never a signal. An empty signal has no chunk. Results are (id, chunk, start, y), where start is y's place in the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(signals: DataFrame, size: int) -> DataFrame:
    """(id, chunk, total, x) from (id, x)."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / size).cast("int")), lambda i: F.slice("x", i * size + 1, size))
    return signals.where(F.size("x") > 0).select("id", F.size("x").cast("long").alias("total"), F.posexplode(cut).alias("chunk", "x")).select("id", F.col("chunk").cast("long").alias("chunk"), "total", "x")


def convolved(rows: DataFrame, h: np.ndarray, size: int) -> DataFrame:
    """As many samples as came of the convolution with h: a uniformly partitioned overlap-add. h is cut like the signal, each chunk's
    spectrum meets each part's, and pieces that land in the same chunk add up."""
    parts = [h[at : at + size] for at in range(0, len(h), size)]
    spectra = [np.fft.rfft(p, 2 * size) for p in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.zeros((len(b), size))
            for row, v in zip(x, b["x"], strict=True):
                row[: len(v)] = v
            own, y = np.fft.rfft(x, 2 * size, axis=1), np.zeros((len(b), (len(parts) + 1) * size))
            for j, s in enumerate(spectra):
                y[:, j * size : (j + 2) * size] += np.fft.irfft(own * s, 2 * size, axis=1)
            for k in range(len(parts) + 1):
                piece = b[["id", "total"]].assign(chunk=b["chunk"] + k, y=list(y[:, k * size : (k + 1) * size]))
                yield piece[piece["chunk"] * size < piece["total"]][["id", "chunk", "total", "y"]]

    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInPandas(run, f"id {kind}, chunk long, total long, y array<double>")
    none = F.array_repeat(F.lit(0.0), size)
    whole = pieces.groupBy("id", "chunk", "total").agg(F.collect_list("y").alias("ys"))  # one of each part of h and one more at most
    y = F.aggregate("ys", none, lambda a, b: F.zip_with(a, b, lambda v, w: v + w))
    start = F.col("chunk") * size
    return whole.select("id", "chunk", start.alias("start"), F.slice(y, F.lit(1), F.least(F.lit(size), F.col("total") - start).cast("int")).alias("y"))


def resampled(rows: DataFrame, up: int, down: int, taps: np.ndarray, size: int) -> DataFrame:
    """ceil(total * up / down) samples in all: a polyphase filter bank over each chunk with what it needs of its neighbours; the phase
    of an output sample follows from its place."""
    middle, depth = len(taps) // 2, -(-len(taps) // up)
    bank = np.zeros((up, depth))
    bank.T.flat[: len(taps)] = taps  # bank[r, k] is the tap r + up * k
    reach = max(middle // up + 1, depth)
    far = -(-reach // size)
    at = F.col("chunk") * size
    to = rows.select("id", "total", "x", at.alias("at"), F.explode(F.transform(F.sequence(F.lit(-far), F.lit(far)), lambda d: F.col("chunk") + d)).alias("target"))
    low, high = F.greatest(F.col("at"), F.col("target") * size - reach), F.least(F.col("at") + F.size("x"), (F.col("target") + 1) * size + reach)
    sent = to.withColumns({"low": low, "high": high}).where((F.col("target") >= 0) & (F.col("target") * size < F.col("total")) & (F.col("low") < F.col("high")))
    edge = sent.select("id", F.col("target").alias("chunk"), "total", F.struct("low", F.slice("x", (F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("x")).alias("piece"))
    wide = edge.groupBy("id", "chunk", "total").agg(F.sort_array(F.collect_list("piece")).alias("p")).select("id", "chunk", "total", F.get("p.low", F.lit(0)).alias("low"), F.flatten("p.x").alias("x"))

    def one(chunk: int, total: int, low: int, x: np.ndarray) -> tuple[int, np.ndarray]:
        first, end = -(-chunk * size * up // down), min(-(-(chunk + 1) * size * up // down), -(-total * up // down))
        place = np.arange(first, end) * down + middle
        index = (place // up)[:, None] - np.arange(depth) - low
        there = (index >= 0) & (index < len(x))
        return first, (np.where(there, np.asarray(x)[np.clip(index, 0, len(x) - 1)], 0.0) * bank[place % up]).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*r) for r in zip(b["chunk"], b["total"], b["low"], b["x"], strict=True)]
            yield b[["id", "chunk"]].assign(start=[m[0] for m in made], y=[m[1] for m in made])

    kind = rows.schema["id"].dataType.simpleString()
    return wide.mapInPandas(run, f"id {kind}, chunk long, start long, y array<double>").where(F.size("y") > 0)
