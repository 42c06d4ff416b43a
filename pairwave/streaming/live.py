"""The live path as Structured Streaming queries. Each stands beside a batch twin in operators.blocks with the same rows.

Rows of a micro-batch come unsorted and are put in order of (ts, seq) within a key; across micro-batches order is that of
arrival. State is a few numbers a key and, for blocks, less than one block of samples.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pairwave.config import StreamConfig
from pairwave.functions.denoise import Denoiser, Smoother
from pairwave.functions.signal import linear_to_db
from pairwave.operators.blocks import FAULT, GAIN, STRENGTH, hour_of
from pairwave.sources.shared import file_system, new_folder


_models: dict[tuple, Denoiser] = {}


def kept_model(make: Callable[..., Denoiser], *args) -> Denoiser:
    """The denoiser of this worker: made when it is first needed, not again for each key and micro-batch."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _models:
        _models[key] = make(*args)
    return _models[key]


def together(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A key's rows of a micro-batch in order; None without any."""
    found = [b for b in batches if len(b)]
    return pd.concat(found).sort_values(["ts", "seq"]) if found else None


def block_rows(size: int):
    """State function: full blocks of a key, with the peak and the faults so far; what is left over waits."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done, faults = state.get if state.exists else ([], 0, 0)
        rows, out, held = together(batches), [], list(held)
        if rows is None:
            return
        for value, kind in zip(rows["value"], rows["kind"], strict=True):
            held.append(abs(value))
            faults += kind == FAULT
            if len(held) == size:
                out.append((key[0], done, max(held), faults))
                held, done = [], done + 1
        state.update((held, int(done), int(faults)))
        yield pd.DataFrame(out, columns=["stream_id", "block_idx", "peak", "faults"])

    return run


def blocks(rows: DataFrame, size: int) -> DataFrame:
    out = "stream_id long, block_idx long, peak double, faults long"
    return rows.groupBy("stream_id").applyInPandasWithState(block_rows(size), out, "held array<double>, done long, faults long", "append", GroupStateTimeout.NoTimeout)


def control_rows(gain_db: float, strength: float):
    """State function: each row with the control values that hold when it comes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gain, amount = state.get if state.exists else (gain_db, strength)
        rows, out = together(batches), []
        if rows is None:
            return
        for seq, kind, value in zip(rows["seq"], rows["kind"], rows["value"], strict=True):
            out.append((key[0], seq, gain, amount))
            if kind == GAIN:
                gain = value / 100
            elif kind == STRENGTH:
                amount = min(1.0, max(0.0, value / 100))
        state.update((float(gain), float(amount)))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "gain_db", "strength"])

    return run


def controlled(rows: DataFrame, gain_db: float = 0.0, strength: float = 1.0) -> DataFrame:
    out = "stream_id long, seq long, gain_db double, strength double"
    return rows.groupBy("stream_id").applyInPandasWithState(control_rows(gain_db, strength), out, "gain_db double, strength double", "append", GroupStateTimeout.NoTimeout)


ENGINE = "stream_id long, event string, block_idx long, seq long, last_ts timestamp_ntz, enabled boolean, strength double, gain_db double, faults long, in_peak double, out_peak double, payload string, samples array<double>"


def engine_rows(size: int, channels_in: int, channels: int, channels_out: int, make: Callable[..., Denoiser], config: StreamConfig, names: list[tuple[int, str]]):
    """State function of the whole chain: samples wait until a block is full, commands change the controls of the blocks that
    begin after them, a command that can't be carried out gives an ERROR, a block whose denoiser fails goes on as it came, with an
    ERROR beside it, and after SHUTDOWN nothing more is done."""
    known, listed = {i for i, _ in names}, ", ".join(n for _, n in sorted(names))

    def wrong(command: str | None, arg: float) -> str | None:
        if command == "SET_STRENGTH" and math.isnan(arg) or command == "SET_GAIN" and not math.isfinite(arg):
            return f"{command}: not a number"
        if command in ("SET_INPUT_DEVICE", "SET_OUTPUT_DEVICE") and arg >= 1 << 31:
            return f"{command}: no such device"
        if command in ("SET_INPUT_DEVICE", "SET_OUTPUT_DEVICE") and arg >= 0 and int(arg) not in known:
            return f"{command}: no device {int(arg)}"
        return None

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done, faults, enabled, strength, gain, at, stopped = state.get if state.exists else ([], 0, 0, config.enabled, config.strength, config.gain_db, None, False)
        model, held, out = kept_model(make, config.model_path, config.sample_rate, size), list(held), []
        at = at or (enabled, strength, gain)  # the controls of the block that is being filled
        rows = together(batches)
        if rows is None:
            return
        blank = (None,) * 3
        for seq, ts, kind, value, command, arg in zip(rows["seq"], rows["ts"], rows["kind"], rows["value"], rows["command"], rows["arg"].astype(float), strict=True):
            if stopped:
                break
            if not held:
                at = (enabled, strength, gain)
            held.append(float(value))
            faults += kind == FAULT
            if len(held) == size:
                x = np.array(held).reshape(-1, channels_in)
                y = dry = x[:, :channels].ravel()
                if at[0]:
                    try:
                        y = (1 - at[1]) * dry + at[1] * model.process(dry)
                    except Exception as e:  # a plug-in's failure costs its block, not the stream
                        out.append((key[0], "ERROR", done, seq, ts, *blank, faults, None, None, f"denoiser: {type(e).__name__}: {e}", None))
                y = np.clip(y * 10 ** (at[2] / 20), -1, 1)
                wide = np.tile(y.reshape(-1, channels), -(-channels_out // channels))[:, :channels_out]
                out.append((key[0], "BLOCK", done, seq, ts, *at, faults, float(np.abs(x).max()), float(np.abs(y).max()), None, wide.ravel().tolist()))
                held, done = [], done + 1
            error = wrong(command, arg)
            if error or command in ("GET_DEVICES", "SHUTDOWN"):
                event = "ERROR" if error else "DEVICE_LIST" if command == "GET_DEVICES" else "ENGINE_STOPPED"
                out.append((key[0], event, None, seq, ts, *blank, faults, None, None, error or (listed if event == "DEVICE_LIST" else None), None))
            if command == "SET_ENABLED":
                enabled = arg == arg and arg != 0
            elif command == "SET_STRENGTH" and not error:
                strength = min(1.0, max(0.0, arg))
            elif command == "SET_GAIN" and not error:
                gain = arg
            stopped = command == "SHUTDOWN"
        state.update((held, int(done), int(faults), bool(enabled), float(strength), float(gain), tuple(at), bool(stopped)))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in ENGINE.split(", ")])
        yield frame.astype({"block_idx": "Int64", "enabled": "boolean", "faults": "Int64"})

    return run


def engine(rows: DataFrame, size: int, channels_in: int, channels: int, channels_out: int, names: list[tuple[int, str]], make: Callable[..., Denoiser] = Smoother, config: StreamConfig | None = None) -> DataFrame:
    """The chain of operators.blocks.processed and its answers to commands as one stream: a BLOCK row for each full block, and ERROR,
    DEVICE_LIST and ENGINE_STOPPED rows. STATUS comes from the blocks, by ``status``."""
    kept = "held array<double>, done long, faults long, enabled boolean, strength double, gain_db double, at struct<enabled: boolean, strength: double, gain_db: double>, stopped boolean"
    f = engine_rows(size, channels_in, channels, channels_out, make, config or StreamConfig(), names)
    return rows.groupBy("stream_id").applyInPandasWithState(f, ENGINE, kept, "append", GroupStateTimeout.NoTimeout)


def status(blocks_: DataFrame, late: str = "1 hour") -> DataFrame:
    """(stream_id, tick, input_db, output_db, faults) of BLOCK rows: the levels of the last block of each event-time hour; state older than ``late`` goes."""
    timed = blocks_.withColumn("at", F.col("last_ts").cast("timestamp")).withWatermark("at", late)
    last = timed.groupBy(F.window("at", "1 hour"), "stream_id").agg(F.max_by(F.struct("in_peak", "out_peak", "faults", "last_ts"), "block_idx").alias("s"))
    return last.select("stream_id", hour_of(F.col("s.last_ts")).alias("tick"), linear_to_db(F.col("s.in_peak")).alias("input_db"), linear_to_db(F.col("s.out_peak")).alias("output_db"), F.col("s.faults").alias("faults"))


def rows_from(spark: SparkSession, path: str, schema: StructType | str, files: int = 256) -> DataFrame:
    """A stream of the parquet files of a folder, at most so many to a micro-batch: a reader that is behind falls further
    behind, and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def landed(stream: DataFrame, name: str | None = None) -> str:
    """The folder of what the stream gives, as rows to append, for all that is there now."""
    out, log = new_folder(stream.sparkSession, "stream"), new_folder(stream.sparkSession, "stream-log")
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    writer.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", out).outputMode("append").start().awaitTermination()
    return out


def drained(stream: DataFrame, log: str) -> str:
    """The folder of what a stream with bounded micro-batches gives, until none has more; log is its checkpoint."""
    out = new_folder(stream.sparkSession, "stream")
    running = stream.writeStream.option("checkpointLocation", log).format("parquet").option("path", out).outputMode("append").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return out


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, from a written table. In complete mode each micro-batch replaces the one before."""
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(landed(stream))
    out, log = new_folder(spark, "stream"), new_folder(spark, "stream-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Handle:
    """Runs a stream of events into a table and reads them from there."""

    def __init__(self, stream: DataFrame, every: str = "50 milliseconds"):
        self.stream, self.every, self.query, self.done, self.polled = stream, every, None, -1, -1
        self.folder, self.log = new_folder(stream.sparkSession, "events"), new_folder(stream.sparkSession, "events-log")

    def start(self) -> None:
        """Does nothing while it runs; started again, it goes on where it stopped."""
        if not self.alive:
            land = lambda df, n: df.write.mode("overwrite").parquet(f"{self.folder}/batch={n}")  # noqa: E731  (a repeated batch replaces itself)
            self.query = self.stream.writeStream.option("checkpointLocation", self.log).trigger(processingTime=self.every).foreachBatch(land).start()

    def stop(self, seconds: float = 3.0) -> None:
        """Lets what has come be worked on for so long, then ends the query."""
        if self.alive:
            waiter = threading.Thread(target=self.query.processAllAvailable, daemon=True)
            waiter.start()
            waiter.join(seconds)
            self._seen()
            self.query.stop()
        self.query = None

    def _seen(self) -> None:
        """Take note of the micro-batches that have ended: those that the query's log has as committed."""
        store, top = file_system(f"{self.log}/commits")
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        self.done = max([self.done, *(int(f.base_name) for f in found if f.base_name.isdigit())])

    @property
    def alive(self) -> bool:
        return self.query is not None and self.query.isActive

    def poll_events(self) -> list:
        """The events of the micro-batches that ended since the last call; processed samples stay in the table."""
        spark = self.stream.sparkSession
        self._seen()
        found = []
        for n in range(self.polled + 1, self.done + 1):
            rows = spark.read.schema(self.stream.schema).parquet(f"{self.folder}/batch={n}")  # written before the batch was committed
            found += (rows.where("event <> 'BLOCK'") if "event" in rows.columns else rows).collect()
        self.polled = self.done
        return found
