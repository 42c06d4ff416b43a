"""Stateful processors: a controlled clock, a restart from a checkpoint, rows out of order; and the listener's totals."""

import random
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from pairwave.streaming import live, processors, progress


class Kept:
    """State without Spark: a value, a list or a map."""

    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    put = update = lambda self, v: setattr(self, "value", v)
    clear = lambda self: setattr(self, "value", None)
    containsKey = lambda self, k: k in (self.value or {})  # noqa: E731, N815
    getValue = lambda self, k: self.value[k]  # noqa: E731, N815

    def updateValue(self, k, v):  # noqa: N802
        self.value = {**(self.value or {}), k: v}


class Clock:
    def __init__(self):
        self.now, self.timers = 1000, []

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now


def test_status_by_a_controlled_clock():
    clock = Clock()
    handle = SimpleNamespace(getMapState=lambda *a: Kept(), getValueState=lambda *a: Kept(), registerTimer=clock.timers.append)
    p = processors.Ticker(every_ms=50, most=3)
    p.init(handle)
    come = lambda *rows: [r for f in p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["block_idx", "level_db"])]), clock) for r in f.itertuples(index=False, name=None)]

    def fire():
        clock.now = clock.timers.pop(0)
        return [r for f in p.handleExpiredTimer((7,), clock, clock) for r in f.itertuples(index=False, name=None)]

    assert come() == [(7, 0, 1000, -120.0, False)] and clock.timers == [1050]  # at once, before any block
    assert fire() == [(7, 1, 1050, -120.0, False)] and clock.timers == [1100]
    assert come((1, -3.0), (0, -9.0)) == [] and fire() == [(7, 2, 1100, -3.0, True)]
    assert [fire() for _ in range(3)] == [[(7, 3 + i, 1150 + 50 * i, -3.0, False)] for i in range(3)]
    assert fire() == [(7, 6, 1300, -3.0, False)] and clock.timers == []  # too long without a block
    clock.now = 9000
    assert come((2, -1.0)) == [(7, 7, 9000, -1.0, True)] and clock.timers == [9050]


def test_status_without_blocks(spark, tmp_path):
    spark.createDataFrame([(1, 0, -6.0)], "stream_id long, block_idx long, level_db double").write.parquet(str(tmp_path / "in"))
    rows = live.rows_from(spark, str(tmp_path / "in"), "stream_id long, block_idx long, level_db double")
    out, got = str(tmp_path / "out"), []
    q = processors.applied(rows, processors.Ticker(every_ms=200), "ProcessingTime").writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="100 milliseconds").format("parquet").option("path", out).start()
    end = time.time() + 60
    while time.time() < end and len(got) < 4:
        time.sleep(1)
        assert q.isActive, q.exception()
        if (tmp_path / "out" / "_spark_metadata").exists():
            got = sorted((r.tick, r.level_db) for r in spark.read.schema(processors.Ticker.OUT).parquet(out).collect())
    q.stop()
    assert [t for t, _ in got] == list(range(len(got))) and len(got) >= 4 and {v for _, v in got} == {-6.0}


def test_processors_go_on_from_their_checkpoint(spark, tmp_path):
    kinds = ["signup", "x", "click", "error", "x"]
    rows = [(i % 2, i, kinds[i % 5], float(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "stream_id long, seq long, kind string, value double").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    d.coalesce(1).write.parquet(str(tmp_path / "all"))
    whole = live.rows_from(spark, str(tmp_path / "all"), d.schema)
    want = {n: sorted(map(tuple, live.run_to_end(stream).collect())) for n, stream in (("b", live.blocks(whole, 3)), ("c", live.controlled(whole)))}
    for n, p in (("b", processors.Blocks(3)), ("c", processors.Controls())):
        folder, out, log = (str(tmp_path / f"{n}-{x}") for x in ("in", "out", "log"))
        for part in (d.where("seq < 17"), d.where("seq >= 17")):
            part.coalesce(1).write.mode("append").parquet(folder)
            stream = processors.applied(live.rows_from(spark, folder, d.schema), p)
            stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        assert sorted(map(tuple, spark.read.schema(p.OUT).parquet(out).collect())) == want[n]


def test_totals_of_a_listener(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.range(50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = progress.Progress("totals", str(tmp_path / "progress"))
    spark.streams.addListener(heard)
    live.landed(live.rows_from(spark, str(tmp_path / "in"), "id long", files=1).observe("seen", F.count("*").alias("made"), F.count_if(F.col("id") % 10 == 0).alias("tens")), "totals")
    assert heard.ended.wait(60)
    spark.streams.removeListener(heard)
    got = [(r.rows_in, r.backlog_files, r.observed) for r in progress.table(spark, str(tmp_path / "progress")).orderBy("batch").collect() if r.rows_in]
    assert sorted(g[0] for g in got) == [50, 100] and sum(g[2]["made"] for g in got) == 150 and sum(g[2]["tens"] for g in got) == 15


class Listed(Kept):
    """A list state that counts what it is given."""

    given = 0

    def appendValue(self, v):  # noqa: N802
        self.value, self.given = [*(self.value or []), v], self.given + 1

    def put(self, v):
        self.value, self.given = list(v), self.given + len(v)


def test_streams_in_order_under_one_key():
    """Rows of many streams, null among them, that come out of order: each sample with its own stream's controls; a few values of state for thousands of rows."""
    states, timers, now = {}, [], SimpleNamespace(getCurrentWatermarkInMs=lambda: now.ms, ms=0)
    p = processors.Ordered()
    p.init(SimpleNamespace(getListState=lambda name, kind: states.setdefault(name, Listed()), getValueState=lambda *a: Kept(), registerTimer=timers.append))
    rng, streams, rows = random.Random(5), [*range(31), None], []
    for i in range(6000):
        command = rng.choice([None, None, None, "SET_GAIN", "SET_STRENGTH", "SET_ENABLED", "SET_INPUT_DEVICE"] + ["SHUTDOWN"] * (i % 50 == 0))
        rows.append((rng.choice(streams), 1000 * (i + 1), i, command, rng.choice([0.5, 3.0, float("nan"), None]) if command else None))
    got = []
    for part in range(3):
        came = [r for r in rows if (r[1] // 1000 - 1 + hash(r[2] * 7919) % 2000) // 2000 == part or part == 2 and (r[1] // 1000 - 1 + hash(r[2] * 7919) % 2000) // 2000 > 2]
        rng.shuffle(came)
        frame = pd.DataFrame(came, columns=["stream_id", "us", "seq", "command", "arg"]).astype({"stream_id": "Int64"})
        assert not list(p.handleInputRows((0,), iter([frame[:700], frame[700:]]), now))
        now.ms = [0, 2000, 7000][part]
        while [t for t in timers if t <= now.ms]:
            timers.remove(min(timers))
            got += [r for f in p.handleExpiredTimer((0,), now, None) for r in f.itertuples(index=False, name=None)]
    want = []
    for s in streams:
        state, stopped = {"e": True, "s": 1.0, "g": 0.0, "i": -1}, False
        for _, _, seq, command, arg in (r for r in rows if r[0] == s):
            number = arg is not None and arg == arg
            if command is None and not stopped:
                want.append((s, seq, state["e"], state["s"], state["g"], state["i"], -1))
            elif command == "SHUTDOWN":
                stopped = True
            elif command == "SET_ENABLED":
                state["e"] = number and arg != 0
            elif command == "SET_INPUT_DEVICE":
                state["i"] = int(arg) if number else -1
            elif command and number:
                state["s" if command == "SET_STRENGTH" else "g"] = min(1.0, arg) if command == "SET_STRENGTH" else arg
    clean = sorted((-1 if pd.isna(r[0]) else r[0], *r[1:]) for r in got)
    assert clean == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in want) and len(want) > 1000
    assert states["waiting"].given < 10 and states["controls"].given < 100 and not states["waiting"].exists()
