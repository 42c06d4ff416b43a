"""The live path by stateful processors (RocksDB state): controls as value state, samples that wait as list state, the levels of each
stream's last block as map state, and a STATUS by timers of processing time, the first at once, also where no block comes.

Each is a class for transformWithStateInPandas; ``configure`` sets what the session needs for it. Rows of a micro-batch are put in order of (ts, seq) within a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pairwave.config import StreamConfig
from pairwave.functions.signal import SILENT_DB
from pairwave.operators.blocks import FAULT, GAIN, STRENGTH
from pairwave.streaming.live import together

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """State of processors is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Controls(StatefulProcessor):
    """Each row with the gain and strength that hold when it comes."""

    OUT = "stream_id long, seq long, gain_db double, strength double"

    def __init__(self, gain_db: float = 0.0, strength: float = 1.0, keep_ms: int | None = None):
        self.first, self.keep_ms = (gain_db, strength), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("controls", "gain_db double, strength double", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found, out = together(rows), []
        if found is None:
            return
        gain, amount = self.held.get() if self.held.exists() else self.first
        for seq, kind, value in zip(found["seq"], found["kind"], found["value"], strict=True):
            out.append((key[0], seq, gain, amount))
            if kind == GAIN:
                gain = value / 100
            elif kind == STRENGTH:
                amount = min(1.0, max(0.0, value / 100))
        self.held.update((float(gain), float(amount)))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "gain_db", "strength"])

    def close(self) -> None:
        pass


class Blocks(StatefulProcessor):
    """Full blocks of a key, with their peak and the faults so far; what is left over waits as a list."""

    OUT = "stream_id long, block_idx long, peak double, faults long"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double")
        self.counts = handle.getValueState("counts", "done long, faults long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found, out = together(rows), []
        if found is None:
            return
        held = [v for (v,) in self.held.get()] if self.held.exists() else []
        done, faults = self.counts.get() if self.counts.exists() else (0, 0)
        for value, kind in zip(found["value"], found["kind"], strict=True):
            held.append(float(abs(value)))
            faults += kind == FAULT
            if len(held) == self.size:
                out.append((key[0], done, max(held), faults))
                held, done = [], done + 1
        self.held.put([(v,) for v in held]) if held else self.held.clear()
        self.counts.update((int(done), int(faults)))
        yield pd.DataFrame(out, columns=["stream_id", "block_idx", "peak", "faults"])

    def close(self) -> None:
        pass


class Ticker(StatefulProcessor):
    """A STATUS row at once for each stream that is heard of, and then every ``every_ms`` of processing time, with the level of the last
    block that came (SILENT_DB before any), whether or not one came since; ``most`` ticks without a block end a stream's ticking."""

    OUT = "stream_id long, tick long, at_ms long, level_db double, fresh boolean"

    def __init__(self, every_ms: int = 50, most: int = 1200):
        self.every_ms, self.most = every_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "what string", "value double")
        self.ticks = handle.getValueState("ticks", "tick long, idle long, fresh boolean")

    def status(self, key: tuple, now: int) -> pd.DataFrame:
        tick, idle, fresh = self.ticks.get() if self.ticks.exists() else (0, 0, False)
        level = self.levels.getValue(("last",))[0] if self.levels.containsKey(("last",)) else SILENT_DB
        self.ticks.update((tick + 1, 0 if fresh else idle + 1, False))
        if idle < self.most:
            self.handle.registerTimer(now + self.every_ms)
        return pd.DataFrame([(key[0], tick, now, level, fresh)], columns=["stream_id", "tick", "at_ms", "level_db", "fresh"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [b for b in rows if len(b)]
        first = not self.ticks.exists()
        if found:
            last = pd.concat(found).sort_values("block_idx").iloc[-1]
            self.levels.updateValue(("last",), (float(last["level_db"]),))
            tick, idle, _ = self.ticks.get() if not first else (0, 0, False)
            self.ticks.update((tick, 0, True))
            if not first and idle >= self.most:
                first = True  # it had stopped ticking
        if first:
            yield self.status(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.status(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


#: Neighbouring streams whose rows are put in order under one key: calls to the state are by key, not by stream or row.
STREAMS = 32


class Ordered(StatefulProcessor):
    """Samples and commands of two sources in the order of their event time (ts, seq; a command after the sample of its time): rows wait
    until the watermark has passed them. Each sample comes out with the controls that the commands before it left; after a
    SHUTDOWN nothing does. What comes later than the watermark is dropped by Spark, samples and commands alike, and counted in
    its progress (numRowsDroppedByWatermark). A key is a group of streams; its rows wait as a list of Arrow tables, one for what a
    micro-batch brought."""

    OUT = "stream_id long, seq long, enabled boolean, strength double, gain_db double, input_device long, output_device long"
    ROW = pa.schema([("stream_id", pa.int64()), ("us", pa.int64()), ("seq", pa.int64()), ("command", pa.string()), ("arg", pa.float64())])

    def __init__(self, config: StreamConfig | None = None):
        self.config = config or StreamConfig()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.controls = handle.getListState("controls", "stream_id long, enabled boolean, strength double, gain_db double, input_device long, output_device long, stopped boolean")

    def packed(self, rows: pa.Table) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.ROW) as out:
            out.write_table(rows.combine_chunks())
        return (sink.getvalue().to_pybytes(),)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [pa.Table.from_pandas(b[self.ROW.names], self.ROW, preserve_index=False) for b in rows if len(b)]
        if came:
            came = pa.concat_tables(came)
            self.waiting.appendValue(self.packed(came))
            self.handle.registerTimer(pc.min(came["us"]).as_py() // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [pa.ipc.open_stream(bytes(x)).read_all() for (x,) in self.waiting.get()] if self.waiting.exists() else []
        rows = pa.concat_tables(held) if held else self.ROW.empty_table()
        early = pc.less(rows["us"], passed)
        due, rest = rows.filter(early), rows.filter(pc.invert(early))
        if not len(due):  # an earlier timer of this micro-batch has seen to it, and to the next
            return
        if len(rest):
            self.waiting.put([self.packed(rest)])
            self.handle.registerTimer(pc.min(rest["us"]).as_py() // 1000 + 1)
        else:
            self.waiting.clear()
        due = due.append_column("said", pc.is_valid(due["command"])).sort_by([(n, "ascending") for n in ("stream_id", "us", "seq", "said")])
        kept = {x[0]: tuple(x[1:]) for x in self.controls.get()} if self.controls.exists() else {}
        c, out, at = self.config, [], ()
        first = (c.enabled, c.strength, c.gain_db, -1, -1, False)
        for stream, seq, command, arg in zip(*(due[n].to_pylist() for n in ("stream_id", "seq", "command", "arg")), strict=True):
            if (stream,) != at:
                if at:
                    kept[at[0]] = (enabled, strength, gain, source, target, stopped)
                at = (stream,)
                enabled, strength, gain, source, target, stopped = kept.get(stream, first)
            if stopped:
                continue
            if command is None:
                out.append((stream, seq, enabled, strength, gain, source, target))
                continue
            number = arg is not None and not math.isnan(arg)
            device = int(arg) if number and 0 <= arg < 1 << 31 else -1
            if command == "SET_ENABLED":
                enabled = number and arg != 0
            elif command == "SET_STRENGTH" and number:
                strength = min(1.0, max(0.0, arg))
            elif command == "SET_GAIN" and number and math.isfinite(arg):
                gain = arg
            elif command == "SET_INPUT_DEVICE":
                source = device
            elif command == "SET_OUTPUT_DEVICE":
                target = device
            stopped = command == "SHUTDOWN"
        kept[at[0]] = (enabled, strength, gain, source, target, stopped)
        self.controls.put([(k, bool(v[0]), float(v[1]), float(v[2]), int(v[3]), int(v[4]), bool(v[5])) for k, v in kept.items()])
        made = pd.DataFrame(out, columns=[f.split()[0] for f in self.OUT.split(", ")])
        yield made.astype({"stream_id": "Int64"}) if None in kept else made

    def close(self) -> None:
        pass


def in_order(samples: DataFrame, commands: DataFrame, late: str) -> DataFrame:
    """The controls of each sample, from a source of samples (stream_id, ts, seq) and one of commands (stream_id, ts, seq, command, arg), of which
    rows may come in any order within ``late``."""
    none = {"command": F.lit(None).cast("string"), "arg": F.lit(None).cast("double")}
    both = samples.select("stream_id", "ts", "seq").withColumns(none).unionByName(commands.select("stream_id", "ts", "seq", "command", "arg"))
    timed = both.withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    grouped = timed.withColumn("streams", F.floor(F.col("stream_id") / STREAMS))
    return applied(grouped.select("streams", "stream_id", "at", "us", "seq", "command", "arg"), Ordered(), "EventTime", "streams")


def applied(rows: DataFrame, processor: StatefulProcessor, time_mode: str = "None", key: str = "stream_id") -> DataFrame:
    """What a processor makes of each stream of rows (stream_id, ...), or of each key."""
    configure(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="append", timeMode=time_mode)
