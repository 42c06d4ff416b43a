"""Segments of audio files without moving signals: draws go to the file they are from, and what leaves it are the segments asked for.

Draws (global_idx, path, u) are dealt out by path and sorted by it, so a task opens each file once and reads the frames of each draw. A file
that is drawn more than ``most`` times is dealt to several tasks, as many as its count asks for: the counts are an aggregate
over the draws, and no task has more than about so many draws of a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.operators import kernels
from pairwave.sources import wav
from pairwave.sources.shared import file_system


def place(n: int, length: int, u: float) -> int:
    """Where a segment of a signal of n samples begins, or a shorter signal in its segment."""
    return int(u * (abs(n - length) + 1))


class Visitor:
    """One file at a time: its headers, and for another rate than the one wanted the whole of it, resampled once."""

    def __init__(self, root: str, rate: int):
        self.root, self.rate, self.path, self.file, self.whole = root, rate, None, None, None

    def visit(self, path: str) -> None:
        self.close()
        store, where = file_system(f"{self.root}/{path}" if self.root else path)
        self.path, self.file = path, store.open_input_file(where)
        self.of = wav.layout(self.file, path)
        self.whole = None if self.of.rate == self.rate else kernels.resample(wav.frames_in(self.file, self.of).mean(axis=1), self.of.rate, self.rate)

    def segment(self, path: str, length: int, u: float) -> np.ndarray:
        if path != self.path:
            self.visit(path)
        n = self.of.frames if self.whole is None else len(self.whole)
        start = place(n, length, u)
        at, count = (start, length) if n >= length else (0, n)
        x = wav.frames_in(self.file, self.of, at, count).mean(axis=1) if self.whole is None else self.whole[at : at + count]
        return x if n >= length else np.concatenate((np.zeros(start), x, np.zeros(length - start - n)))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def segments(draws: DataFrame, root: str, rate: int, length: int, most: int = 4096) -> DataFrame:
    """(global_idx, path, x, error) for draws (global_idx, path, u) of files below root, or anywhere if it is empty, at the rate; a file that can't be read gives error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor = Visitor(root, rate)
        for b in batches:
            out = []
            for i, path, u in zip(b["global_idx"], b["path"], b["u"], strict=True):
                try:
                    out.append((i, path, visitor.segment(path, length, u), None))
                except (ValueError, EOFError, OSError, struct.error) as e:
                    visitor.close()
                    out.append((i, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["global_idx", "path", "x", "error"])
        visitor.close()

    spark = draws.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # little data, much work
    often = draws.groupBy("path").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")  # as many rows as most goes into the draws, at most
    dealt = draws.join(often, "path", "left").withColumn("part", F.pmod(F.xxhash64("global_idx"), F.coalesce("parts", F.lit(1))))
    return dealt.select("global_idx", "path", "u", "part").repartition(n, "path", "part").sortWithinPartitions("path", "part").drop("part").mapInPandas(run, "global_idx long, path string, x array<double>, error string")
