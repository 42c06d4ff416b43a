"""The denoiser plug-in: a class that a model's author writes, applied to blocks of samples in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pairwave.config import StreamConfig


class Denoiser(Protocol):
    """Made once for each task with (model_path, sample_rate, block_size); ``process`` keeps a block's shape."""

    def process(self, block: np.ndarray) -> np.ndarray: ...


class Passthrough:
    """Gives each block back. Applied by ``denoised``, it never reaches Python."""

    def __init__(self, model_path: str | None, sample_rate: int, block_size: int):
        self.model_path, self.sample_rate, self.block_size = model_path, sample_rate, block_size

    def process(self, block: np.ndarray) -> np.ndarray:
        return block.copy()


class Smoother:
    """Each sample averaged with the one before it: a denoiser small enough to be checked."""

    def __init__(self, model_path: str | None, sample_rate: int, block_size: int):
        self.model_path, self.sample_rate, self.block_size = model_path, sample_rate, block_size

    def process(self, block: np.ndarray) -> np.ndarray:
        return (block + np.concatenate((np.zeros(1), block[:-1]))) / 2 if len(block) else block.copy()


def denoised(rows: DataFrame, make: Callable[..., Denoiser] = Passthrough, config: StreamConfig | None = None, column: str = "x") -> DataFrame:
    """rows with the column (array<double>) denoised and blended with what came in by the config's strength."""
    c = config or StreamConfig()
    if make is Passthrough or not c.enabled:
        return rows
    strength = min(1.0, max(0.0, c.strength))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(c.model_path, c.sample_rate, c.block_size)
        for b in batches:
            out = []
            for x in b[column]:
                dry = np.asarray(x, float)
                wet = model.process(dry)
                if wet.shape != dry.shape:
                    raise ValueError("a denoiser must keep the shape of a block")
                out.append(wet if strength >= 1 else (1 - strength) * dry + strength * wet)
            yield b.assign(**{column: out})

    return rows.mapInPandas(run, rows.schema)
