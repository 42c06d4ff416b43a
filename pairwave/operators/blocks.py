"""Live processing as batch tables: count-based blocks, status ticks, fault counts, control values, and the whole chain from samples
and commands to processed blocks and events.

A stream's rows (stream_id, ts, seq, kind, value) stand in order of (ts, seq). For the whole chain rows also have a command, null
for most, with its argument (arg, a double): a row stands for the sample that came when the command was given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.functions import signal
from pairwave.functions.signal import clamp, linear_to_db

#: The kinds of control rows, and of a row that stands for a fault of the device.
GAIN, STRENGTH, FAULT = "signup", "click", "error"
# Commands and events.
COMMANDS = ("SET_ENABLED", "SET_STRENGTH", "SET_GAIN", "SET_INPUT_DEVICE", "SET_OUTPUT_DEVICE", "GET_DEVICES", "SHUTDOWN")
EVENTS = ("STATUS", "DEVICE_LIST", "ERROR", "ENGINE_STOPPED")


def ordered_window():
    return Window.partitionBy("stream_id").orderBy("ts", "seq")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(stream_id, block_idx, n, peak, level_db, last_ts): tumbling blocks of so many rows; the last may be short."""
    at = rows.withColumn("block_idx", F.floor((F.row_number().over(ordered_window()) - 1) / size).cast("long"))
    peaks = at.groupBy("stream_id", "block_idx").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"), F.max("ts").alias("last_ts"))
    return peaks.withColumn("level_db", linear_to_db(F.col("peak")))


def hour_of(ts) -> F.Column:
    """Hours since 1970 of a timestamp without a zone."""
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")


def status(blocks_: DataFrame) -> DataFrame:
    """(stream_id, tick, level_db): at each hourly tick the level of the last block, not the loudest."""
    return blocks_.groupBy("stream_id", hour_of(F.col("last_ts")).alias("tick")).agg(F.max_by("level_db", "block_idx").alias("level_db"))


def faults(rows: DataFrame) -> DataFrame:
    """rows with faults: how many there were so far; it never goes back to zero."""
    return rows.withColumn("faults", F.sum((F.col("kind") == FAULT).cast("long")).over(ordered_window().rowsBetween(Window.unboundedPreceding, 0)))


def controlled(rows: DataFrame, gain_db: float = 0.0, strength: float = 1.0) -> DataFrame:
    """rows with gain_db and strength as the control rows before them left them: last write wins; strength is clamped, gain isn't."""
    before = ordered_window().rowsBetween(Window.unboundedPreceding, -1)
    gain = F.last(F.when(F.col("kind") == GAIN, F.col("value") / 100), ignorenulls=True).over(before)
    amount = F.last(F.when(F.col("kind") == STRENGTH, clamp(F.col("value") / 100, 0.0, 1.0)), ignorenulls=True).over(before)
    return rows.withColumns({"gain_db": F.coalesce(gain, F.lit(gain_db)), "strength": F.coalesce(amount, F.lit(strength))})


def running(rows: DataFrame) -> DataFrame:
    """Rows up to a stream's first SHUTDOWN, that one included."""
    before = F.sum((F.col("command") == "SHUTDOWN").cast("int")).over(ordered_window().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__stopped", F.coalesce(before, F.lit(0))).where("__stopped = 0").drop("__stopped")


def is_number(arg: Column) -> Column:
    return arg.isNotNull() & ~F.isnan(arg)


def is_gain(arg: Column) -> Column:
    return is_number(arg) & (F.abs(arg) < float("inf"))


def device_of(arg: Column) -> Column:
    """The device that a command's argument names; -1, the default one, for anything but a finite number from 0 on."""
    named = is_number(arg) & (arg >= 0) & (arg < float(1 << 31))
    return F.when(named, F.floor(F.when(named, arg))).otherwise(F.lit(-1)).cast("long")


def states(rows: DataFrame) -> DataFrame:
    """rows with enabled, strength, gain_db, input_device and output_device (-1: the default one) as the commands before them left
    them. A strength or gain that is no number (null or NaN), or an infinite gain, changes nothing; no number switches off; a strength is clamped."""
    before, arg = ordered_window().rowsBetween(Window.unboundedPreceding, -1), F.col("arg")
    last = lambda command, value: F.last(F.when(F.col("command") == command, value), ignorenulls=True).over(before)
    device = device_of(arg)
    return rows.withColumns(
        {
            "enabled": F.coalesce(last("SET_ENABLED", F.when(is_number(arg), arg != 0).otherwise(False)), F.lit(True)),
            "strength": F.coalesce(last("SET_STRENGTH", F.when(is_number(arg), clamp(arg, 0.0, 1.0))), F.lit(1.0)),
            "gain_db": F.coalesce(last("SET_GAIN", F.when(is_gain(arg), arg)), F.lit(0.0)),
            "input_device": F.coalesce(last("SET_INPUT_DEVICE", device), F.lit(-1).cast("long")),
            "output_device": F.coalesce(last("SET_OUTPUT_DEVICE", device), F.lit(-1).cast("long")),
        }
    )


def smoothed(x: Column) -> Column:
    """Each sample averaged with the one before it."""
    return signal.let(x, lambda x: F.transform(x, lambda v, i: (v + F.coalesce(F.get(x, i - 1), F.lit(0.0))) / 2))


def processed(rows: DataFrame, size: int, channels_in: int, channels: int, channels_out: int, denoise: Callable[[Column], Column] = smoothed) -> DataFrame:
    """(stream_id, block_idx, the controls, faults, in_peak, out_peak, last_ts, last_seq, frames): for each full block, by the
    controls of its beginning: the first channels, denoised and blended if enabled, gain, clipping, and as many channels as go out."""
    live = states(faults(running(rows)))
    at = live.withColumn("block_idx", F.floor((F.row_number().over(ordered_window()) - 1) / size).cast("long"))
    controls, order = ("enabled", "strength", "gain_db", "input_device", "output_device"), F.struct("ts", "seq")
    b = at.groupBy("stream_id", "block_idx").agg(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))).alias("rows"),  # a block's, no more
        F.min_by(F.struct(*controls), order).alias("c"),
        F.max("faults").alias("faults"),
        F.max("ts").alias("last_ts"),
        F.max_by("seq", order).alias("last_seq"),
    )
    x = b.where(F.size("rows") == size).select("stream_id", "block_idx", "c.*", "faults", "last_ts", "last_seq", F.col("rows.value").alias("x"))
    dry = x.withColumn("dry", F.flatten(signal.first_channels(signal.frames_of(F.col("x"), channels_in), channels)))
    wet = F.when(F.col("enabled"), signal.blended(F.col("dry"), denoise(F.col("dry")), F.col("strength"))).otherwise(F.col("dry"))
    y = dry.withColumn("y", signal.clipped(signal.scaled(wet, signal.db_to_linear(F.col("gain_db")))))
    out = signal.fanned_out(signal.frames_of(F.col("y"), channels), channels_out)
    return y.select("stream_id", "block_idx", *controls, "faults", signal.peak(F.col("x")).alias("in_peak"), signal.peak(F.col("y")).alias("out_peak"), "last_ts", "last_seq", out.alias("frames"))


def ticks(processed_: DataFrame) -> DataFrame:
    """(stream_id, tick, block_idx, seq, input_db, output_db, faults): at each hourly tick the levels of the last block."""
    last = F.max_by(F.struct("block_idx", F.col("last_seq").alias("seq"), linear_to_db(F.col("in_peak")).alias("input_db"), linear_to_db(F.col("out_peak")).alias("output_db"), "faults"), "block_idx")
    return processed_.groupBy("stream_id", hour_of(F.col("last_ts")).alias("tick")).agg(last.alias("s")).select("stream_id", "tick", "s.*")


def problem(known: list[int]) -> Column:
    """What is wrong with a row's command, or null: a strength or gain that is no number, an infinite gain, a device that isn't there."""
    command, arg = F.col("command"), F.col("arg")
    device = device_of(arg)
    beyond = is_number(arg) & (arg >= float(1 << 31))
    return (
        F.when((command == "SET_STRENGTH") & ~is_number(arg) | (command == "SET_GAIN") & ~is_gain(arg), F.concat(command, F.lit(": not a number")))
        .when(command.isin("SET_INPUT_DEVICE", "SET_OUTPUT_DEVICE") & beyond, F.concat(command, F.lit(": no such device")))
        .when(command.isin("SET_INPUT_DEVICE", "SET_OUTPUT_DEVICE") & (device >= 0) & ~device.isin(known), F.concat(command, F.lit(": no device "), device.cast("string")))
    )


def events(rows: DataFrame, processed_: DataFrame, devices: DataFrame) -> DataFrame:
    """(stream_id, seq, event, payload, input_db, output_db, faults): answers to commands, a status for each tick, the end."""
    found = devices.select("index", "name").orderBy("index").collect()  # a machine's devices: a handful
    names, known = ", ".join(r.name for r in found), [r["index"] for r in found]
    live, none = running(rows), [F.lit(None).cast("double").alias("input_db"), F.lit(None).cast("double").alias("output_db"), F.lit(None).cast("long").alias("faults")]
    event = F.when(problem(known).isNotNull(), "ERROR").when(F.col("command") == "GET_DEVICES", "DEVICE_LIST").when(F.col("command") == "SHUTDOWN", "ENGINE_STOPPED")
    payload = F.coalesce(problem(known), F.when(F.col("command") == "GET_DEVICES", F.lit(names)))
    answers = live.select("stream_id", "seq", event.alias("event"), payload.alias("payload"), *none).where("event is not null")
    status_ = ticks(processed_).select("stream_id", "seq", F.lit("STATUS").alias("event"), F.lit(None).cast("string").alias("payload"), "input_db", "output_db", "faults")
    return answers.unionByName(status_)
