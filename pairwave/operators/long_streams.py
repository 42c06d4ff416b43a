"""The live windows for streams of any length: faults, controls, stop and blocks as prefix scans over ranges of time. The rows are those
of operators.blocks, whose windows take a stream whole into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.functions.signal import clamp, linear_to_db
from pairwave.operators.blocks import FAULT, GAIN, STRENGTH, device_of, is_gain, is_number
from pairwave.operators.scan import latest, ranged, scanned, total

STREAM, ORDER = ["stream_id"], ["ts", "seq"]


def in_ranges(rows: DataFrame) -> DataFrame:
    """rows (stream_id, ts, seq, ...) as a table in ranges, for what follows."""
    return ranged(rows, STREAM, ORDER, "stream-ranges")


def faults(ranges: DataFrame) -> DataFrame:
    """ranges with faults, as operators.blocks.faults."""
    return scanned(ranges, STREAM, ORDER, {"faults": total((F.col("kind") == FAULT).cast("long"))})


def controlled(ranges: DataFrame, gain_db: float = 0.0, strength: float = 1.0) -> DataFrame:
    """ranges with gain_db and strength, as operators.blocks.controlled."""
    value = F.col("value") / 100
    folds = {"gain_db": latest(F.when(F.col("kind") == GAIN, value), -1), "strength": latest(F.when(F.col("kind") == STRENGTH, clamp(value, 0.0, 1.0)), -1)}
    return scanned(ranges, STREAM, ORDER, folds).withColumns({"gain_db": F.coalesce("gain_db", F.lit(gain_db)), "strength": F.coalesce("strength", F.lit(strength))})


def running(ranges: DataFrame) -> DataFrame:
    """Rows up to a stream's first SHUTDOWN, that one included."""
    stop = total(F.when(F.col("command") == "SHUTDOWN", 1).otherwise(0), -1)
    return scanned(ranges, STREAM, ORDER, {"__stopped": stop}).where("__stopped = 0").drop("__stopped")


def states(ranges: DataFrame) -> DataFrame:
    """ranges with the controls that operators.blocks.states gives."""
    arg = F.col("arg")
    held = lambda command, value: latest(F.when(F.col("command") == command, value), -1)
    folds = {
        "enabled": held("SET_ENABLED", F.when(is_number(arg), arg != 0).otherwise(False)),
        "strength": held("SET_STRENGTH", F.when(is_number(arg), clamp(arg, 0.0, 1.0))),
        "gain_db": held("SET_GAIN", F.when(is_gain(arg), arg)),
        "input_device": held("SET_INPUT_DEVICE", device_of(arg)),
        "output_device": held("SET_OUTPUT_DEVICE", device_of(arg)),
    }
    first = {"enabled": F.lit(True), "strength": F.lit(1.0), "gain_db": F.lit(0.0), "input_device": F.lit(-1).cast("long"), "output_device": F.lit(-1).cast("long")}
    return scanned(ranges, STREAM, ORDER, folds).withColumns({n: F.coalesce(n, v) for n, v in first.items()})


def blocks(ranges: DataFrame, size: int) -> DataFrame:
    """The blocks of operators.blocks.blocks: rows know their place, and a block's peak is put together from parts."""
    at = scanned(ranges, STREAM, ORDER, {"place": total(F.lit(1), -1)}).withColumn("block_idx", F.floor(F.col("place") / size).cast("long"))
    peaks = at.groupBy("stream_id", "block_idx").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"), F.max("ts").alias("last_ts"))
    return peaks.withColumn("level_db", linear_to_db(F.col("peak")))
