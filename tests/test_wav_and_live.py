"""WAV files of both kinds, the reader's ranges and filters, the writer's commit and abort; commands with odd numbers in batch and stream."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.operators import blocks, chunked, kernels, long_streams, visiting
from pairwave.sources import wav
from pairwave.streaming import live

X = np.array([0.0, 0.5, -0.25, 1.5, -3.0, 1e-7])


def test_float_files():
    y, rate = wav.decode(wav.encode(X, 48_000, "FLOAT"))
    assert rate == 48_000 and y.shape == (6, 1) and np.array_equal(y[:, 0], X.astype("f4"))
    assert np.abs(wav.decode(wav.encode(X, 8000))[0][:, 0] - np.clip(X, -1, 1)).max() < 1e-4
    with pytest.raises(ValueError):
        wav.encode(X, 8000, "PCM_24")


@pytest.mark.parametrize("content", [b"", b"RIFF", b"fLaC" + bytes(40), b"RIFF\0\0\0\0WAVEfmt ", wav.encode(X, 8000)[:30], wav.encode(X, 8000).replace(b"fmt \x10\0\0\0\1", b"fmt \x10\0\0\0\6")])
def test_odd_files_give_their_error(spark, content):
    got = wav.decoded(spark.createDataFrame([("a.wav", bytearray(content))], "path string, content binary")).first()
    assert got.samples is None and got.error


def test_extensible_and_unknown_chunks():
    plain = wav.encode(X, 8000, "FLOAT")
    at = plain.index(b"fmt ")
    body = plain[at + 8 : at + 24]
    wide = b"fmt " + (40).to_bytes(4, "little") + b"\xfe\xff" + body[2:] + bytes(8) + b"\3\0" + bytes(14)
    assert np.array_equal(wav.decode(plain[:at] + b"junk\3\0\0\0abc\0" + wide + plain[at + 24 :])[0], wav.decode(plain)[0])


def rows(spark, names):
    return spark.createDataFrame([(n, 8000, [i / 8, 0.5, -0.5, 0.25]) for i, n in enumerate(names)], "path string, sr int, samples array<double>")


def test_source_reads_what_it_wrote(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    names = ["top.wav", "a/1.wav", "a/b/2.wav", "c/3.wav", "c/4.wav"]
    rows(spark, names).repartition(3).write.format("wav").mode("append").option("subtype", "FLOAT").save(str(tmp_path))
    (tmp_path / "c/bad.wav").write_bytes(b"fLaC")
    (tmp_path / "c/note.txt").write_bytes(b"x")
    read = spark.read.format("wav").option("splits", 2).option("pushdown", "true").load(str(tmp_path))
    got = {r.path: r for r in read.collect()}
    assert {n: got[n].samples for n in names} == {n: [i / 8, 0.5, -0.5, 0.25] for i, n in enumerate(names)}
    assert len(got) == 6 and got["c/bad.wav"].error.startswith("CodecUnavailable") and got["a/1.wav"].frames == 4
    one = read.where("path = 'a/1.wav'")
    assert [r.path for r in one.collect()] == ["a/1.wav"] and [r.path for r in spark.read.format("wav").load(str(tmp_path)).where("path = 'a/1.wav'").collect()] == ["a/1.wav"]
    assert {r.path for r in read.where("path like 'c/%' and path in ('c/3.wav', 'c/4.wav', 'a/1.wav')").collect()} == {"c/3.wav", "c/4.wav"}
    part = spark.read.format("wav").option("start", 1).option("frames", 2).load(str(tmp_path)).where("path = 'c/4.wav'").first()
    assert part.samples == [0.5, -0.5] and part.frames == 4
    assert {p.name for p in tmp_path.iterdir()} == {"top.wav", "a", "c", "_SUCCESS"}


def test_writer_keeps_only_what_was_reported(tmp_path):
    class Row:
        def __init__(self, path, samples):
            self.path, self.sr, self.samples = path, 8000, samples

    w = wav.WavWriter(str(tmp_path), "PCM_16")
    lost, kept = w.write(iter([Row("s/1.wav", [0.1]), Row("s/9.wav", [0.1])])), w.write(iter([Row("s/1.wav", [0.5])]))
    with pytest.raises(ValueError):
        w.write(iter([Row("s/2.wav", [0.1]), Row("s/3.wav", None)]))
    assert lost.attempt != kept.attempt and not (tmp_path / "s").exists()
    w.commit([kept, None, w.write(iter([]))])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == ["_SUCCESS", "s", "s/1.wav"]
    assert wav.decode((tmp_path / "s/1.wav").read_bytes())[0][0, 0] == pytest.approx(0.5, abs=1e-4)


def test_failing_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    bad = rows(spark, ["a.wav", "b.wav"]).withColumn("samples", F.when(F.col("path") == "a.wav", F.col("samples"))).coalesce(1)
    with pytest.raises(Exception, match="no samples"):
        bad.write.format("wav").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_visits_of_one_file_by_all(spark, tmp_path):
    """One file drawn for all rows goes to several tasks; short and lost files, files at another rate."""
    x = np.random.default_rng(1).normal(size=500)
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000, "FLOAT"))
    (tmp_path / "s.wav").write_bytes(wav.encode(x[:10], 8000, "FLOAT"))
    (tmp_path / "r.wav").write_bytes(wav.encode(x, 4000, "FLOAT"))
    draws = [(i, "a.wav", (i * 37 % 101) / 101) for i in range(300)] + [(300, "s.wav", 0.5), (301, "r.wav", 0.5), (302, "lost.wav", 0.5)]
    d = spark.createDataFrame(draws, "global_idx long, path string, u double").repartition(3)
    cut = visiting.segments(d, str(tmp_path), 8000, 64, most=50)
    tasks = Counter(r.p for r in cut.where("path = 'a.wav'").select(F.spark_partition_id().alias("p")).collect())
    assert len(tasks) > 1
    got = {r.global_idx: r for r in cut.collect()}
    x = x.astype("f4").astype(float)
    assert len(got) == 303 and all(np.array_equal(got[i].x, x[(at := int(u * 437)) : at + 64]) for i, _, u in draws[:300])
    assert got[300].x == [0.0] * 27 + x[:10].tolist() + [0.0] * 27 and got[302].x is None and got[302].error
    assert np.allclose(got[301].x, kernels.resample(x, 4000, 8000)[int(0.5 * 937) :][:64])


def test_no_exchange_of_visits_holds_samples(spark, tmp_path):
    d = spark.createDataFrame([(0, "a.wav", 0.5)], "global_idx long, path string, u double")
    plan = visiting.segments(d, str(tmp_path), 8000, 64)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :].split("\n", 1)[1]
    assert "RepartitionByExpression" in below and "array" not in below and " x#" not in below


INF, NAN = math.inf, math.nan
SAID = [("SET_GAIN", 6.0), ("SET_GAIN", INF), ("SET_GAIN", -INF), ("SET_GAIN", NAN), ("SET_GAIN", None), ("SET_STRENGTH", INF), ("SET_STRENGTH", NAN), ("SET_INPUT_DEVICE", 1.0), ("SET_INPUT_DEVICE", INF), ("SET_INPUT_DEVICE", NAN), ("SET_OUTPUT_DEVICE", -INF), ("SET_OUTPUT_DEVICE", 1e300), ("SET_ENABLED", NAN), ("SET_ENABLED", INF), ("SET_ENABLED", None), (None, None)]


def commands(spark):
    said = [(1, i, "x", 0.25 * (i % 3), c, a) for i, (c, a) in enumerate(s for s in SAID for _ in range(2))]
    return spark.createDataFrame(said, "stream_id long, seq long, kind string, value double, command string, arg double").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))


def test_odd_arguments_mean_the_same_in_batch_and_stream(spark, tmp_path):
    d = commands(spark)
    done = blocks.processed(d, 2, 2, 1, 2)
    want = sorted((r.block_idx, r.enabled, r.strength, r.gain_db, tuple(r.frames[0])) for r in done.collect())
    devices = spark.createDataFrame([(1, "B"), (0, "A")], "index int, name string")
    answers = sorted((r.seq, r.event, r.payload) for r in blocks.events(d, done, devices).where("event <> 'STATUS'").collect())
    assert sum(a[1] == "ERROR" for a in answers) == 14 and all(map(math.isfinite, (g for *_, g, _ in want)))
    d.write.parquet(str(tmp_path / "in"))
    got = live.run_to_end(live.engine(live.rows_from(spark, str(tmp_path / "in"), d.schema), 2, 2, 1, 2, [(1, "B"), (0, "A")])).collect()
    assert sorted((r.block_idx, r.enabled, r.strength, r.gain_db, tuple(r.samples)) for r in got if r.event == "BLOCK") == want
    assert sorted((r.seq, r.event, r.payload) for r in got if r.event != "BLOCK") == answers


def test_states_of_long_streams_are_those_of_windows(spark):
    d = commands(spark).withColumn("command", F.when(F.col("seq") == 29, "SHUTDOWN").otherwise(F.col("command")))
    names = ["seq", "enabled", "strength", "gain_db", "input_device", "output_device"]
    ranges = long_streams.in_ranges(d)
    assert sorted(map(tuple, long_streams.states(ranges).select(names).collect())) == sorted(map(tuple, blocks.states(d).select(names).collect()))
    assert sorted(r.seq for r in long_streams.running(ranges).collect()) == list(range(30))


def test_one_stream_is_no_task(spark):
    d = spark.range(40_000).selectExpr("0L AS stream_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id AS seq", "IF(id % 7 = 0, 'error', 'view') AS kind", "cast(id % 100 AS double) AS value")
    ranges = long_streams.in_ranges(d)
    sizes = sorted(r["count"] for r in ranges.groupBy("__range").count().collect())
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    plan = long_streams.faults(ranges)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "windowspecdefinition" in line and " ts#" in line.split("windowspecdefinition", 1)[1]]
    assert over_rows and all("windowspecdefinition(__range#" in line for line in over_rows)
    assert {r.seq: r.faults for r in long_streams.faults(ranges).where("seq % 9999 = 0").collect()} == {i: i // 7 + 1 for i in range(0, 40_000, 9999)}


class Failing:
    def __init__(self, *args):
        pass

    def process(self, block):
        if block[0] == 0.25:
            raise RuntimeError("no")
        return block * 0


def test_a_failing_denoiser_costs_its_block():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    import pandas as pd

    f = live.engine_rows(1, 1, 1, 1, Failing, live.StreamConfig(), [])
    frame = pd.DataFrame({"seq": [0, 1, 2], "ts": [0, 1, 2], "kind": "x", "value": [0.5, 0.25, 0.5], "command": None, "arg": None})
    got = pd.concat(f((1,), iter([frame.iloc[:0], frame]), State()))
    assert list(got["event"]) == ["BLOCK", "ERROR", "BLOCK", "BLOCK"] and [s for s in got["samples"] if s] == [[0.0], [0.25], [0.0]] and got["payload"][1] == "denoiser: RuntimeError: no"
    assert list(f((1,), iter([frame.iloc[:0]]), State())) == []
    made = len(live._models)
    assert live.kept_model(Failing, 1) is live.kept_model(Failing, 1) and len(live._models) == made + 1


@pytest.mark.parametrize("size", [1, 3, 8, 16, 64, 100])
def test_chunked_signals_are_whole_ones(spark, size):
    rng = np.random.default_rng(size)
    signals = [rng.normal(size=n).tolist() for n in (1, 7, 64, 65, 130)] + [[]]
    d = chunked.chunks(spark.createDataFrame(list(enumerate(signals)), "id long, x array<double>").repartition(3), size)
    whole = lambda y: {r.id: np.concatenate([p["y"] for p in sorted(r.p)]) for r in y.groupBy("id").agg(F.collect_list(F.struct("start", "y")).alias("p")).collect()}
    for taps in (1, 5, 40):
        h = rng.normal(size=taps)
        got = whole(chunked.convolved(d, h, size))
        assert len(got) == 5 and all(np.allclose(got[i], kernels.convolve(np.array(x), h)) for i, x in enumerate(signals) if x)
    for up, down, taps in ((3, 2, 7), (2, 3, 31), (1, 1, 1), (147, 160, 301)):
        h = rng.normal(size=taps)
        got = whole(chunked.resampled(d, up, down, h, size))
        for i, x in enumerate(signals[:-1]):
            wide = np.zeros(len(x) * up)
            wide[::up] = x
            want = np.convolve(wide, h)[taps // 2 :][: len(wide)][::down][: -(-len(x) * up // down)]
            want = np.r_[want, np.zeros(-(-len(x) * up // down) - len(want))]
            assert np.allclose(got.get(i, np.zeros(0)), want)
