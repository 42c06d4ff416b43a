"""The device catalogue: which devices can record or play, their labels and the defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "index int, name string, max_input_channels int, max_output_channels int, default_samplerate double"


def default_index(index: Column) -> Column:
    """A default device's index; null where it is negative, which stands for none."""
    return F.when(index >= 0, index)


def catalogued(devices: DataFrame, default_in: int | None, default_out: int | None) -> DataFrame:
    same = lambda i: F.col("index").eqNullSafe(default_index(F.lit(i).cast("int")))
    return devices.withColumns({"is_default_input": same(default_in), "is_default_output": same(default_out)})


def labelled(devices: DataFrame, direction: str) -> DataFrame:
    """Devices with channels in a direction (input or output), with a label."""
    n = F.col(f"max_{direction}_channels")
    return devices.where(n > 0).withColumn("label", F.concat("name", F.lit("  ("), n.cast("string"), F.lit("ch)")))
