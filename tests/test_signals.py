"""Properties and edge cases of signals, files, splits and streams."""

import json
import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.config import BuildConfig
from pairwave.functions import denoise, signal
from pairwave.operators import blocks, corpus, kernels
from pairwave.plans import build, dataset
from pairwave.sources import wav
from pairwave.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def xs(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_levels(spark):
    nothing = F.array().cast("array<double>")
    assert one(spark, signal.rms(xs(0, 0))) == one(spark, signal.rms(xs(float("nan")))) == one(spark, signal.rms(nothing)) == 1e-12
    assert one(spark, signal.rms(xs(3, 4))) == pytest.approx(math.sqrt(12.5))
    assert [one(spark, signal.linear_to_db(F.lit(v))) for v in (0.0, 1e-12, 1.0)] == [-120.0, -120.0, 0.0]
    assert [one(spark, signal.meter_value(F.lit(v))) for v in (-59.9, -60.0, -200.0, 3.0)] == [-59, -60, -60, 0]
    assert math.isnan(one(spark, signal.clipped(xs(float("nan"), 2)))[0])


def test_silence_is_not_amplified(spark):
    assert one(spark, signal.normal_gain(signal.peak(xs(0, 1e-9)), 0.95)) == 1.0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_segment(spark, n):
    for u in (0.0, 0.999999):
        y = one(spark, signal.segment(xs(*range(1, n + 1)) if n else F.array().cast("array<double>"), 8, F.lit(u)))
        assert len(y) == 8 and sum(v != 0 for v in y) == min(n, 8)


def test_convolution_paths_agree(spark):
    rng = np.random.default_rng(1)
    x, h = rng.normal(size=40), rng.normal(size=60)
    assert np.allclose(one(spark, signal.convolved(xs(*x), xs(*h))), kernels.convolve(x, h), atol=1e-9)
    assert np.allclose(kernels.convolve(x, np.array([1.0])), x)


def test_resampling_keeps_a_tone():
    t = np.arange(4410) / 44100
    y = kernels.resample(np.sin(2 * np.pi * 1000 * t), 44100, 48000)
    assert len(y) == 4800 and np.allclose(y[500:-500], np.sin(2 * np.pi * 1000 * np.arange(4800) / 48000)[500:-500], atol=2e-3)


def test_fan_out(spark):
    frames = F.array(xs(1, 2))
    assert [one(spark, signal.fanned_out(frames, c))[0] for c in (1, 2, 4, 6)] == [[1], [1, 2], [1, 2, 1, 2], [1, 2] * 3]


@pytest.mark.parametrize("total,want", [(0, (0, 0, 0)), (1, (0, 0, 1)), (3, (2, 0, 1)), (7, (5, 0, 2)), (101, (80, 10, 11))])
def test_splits(spark, total, want):
    c = BuildConfig(total_samples=total)
    plan = dataset.split(dataset.draws(spark, total, 5, 5, c), c)
    counts = {r.split: r["count"] for r in dataset.split_counts(plan).collect()}
    assert tuple(counts[k] for k in ("train", "val", "test")) == want
    other = dataset.split(dataset.draws(spark, total, 5, 5, c).repartition(13), c)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, other.collect()))


def test_files_are_in_one_split(spark):
    rows = [(("speech", "noise")[i % 2], f"{i:03d}", 1 + i * i % 17, (i * 37 % 101) / 101) for i in range(100)] + [("lone", "x", 5, 0.5), ("none", "y", 0, 0.5)]
    files = spark.createDataFrame(rows, "pool string, name string, weight long, u double")
    c = BuildConfig(total_samples=200)
    placed = dataset.source_splits(files.where("pool <> 'none'"), c)
    at = {(r.pool, r.name): r.split for r in placed.collect()}
    for pool in ("speech", "noise", "lone"):
        mine, upto = sorted((u, n, w) for p, n, w, u in rows if p == pool), 0
        whole = sum(w for *_, w in mine)
        for _, n, w in mine:
            share = (upto + w / 2) / whole
            assert at[pool, n] == ("train" if share < 0.8 else "val" if share < 0.9 else "test")
            upto += w
    plan = dataset.split(spark.range(200).select(F.col("id").alias("global_idx"), (F.col("id") * 83 % 200 / 200).alias("u_split")), c).select("global_idx", "split")
    got = dataset.drawn_within(plan, placed, c).collect()
    assert len(got) == 200 and all(at["speech", r.speech_file] == at["noise", r.noise_file] == r.split for r in got)
    seen = [{r.speech_file for r in got if r.split == s} for s in ("train", "val", "test")]
    assert all(seen) and not seen[0] & seen[1] and not seen[0] & seen[2] and not seen[1] & seen[2]
    assert {r.lone_file for r in dataset.drawn_within(plan, placed, c, ("lone",)).collect()} == {"x", None}


def test_ratios_must_sum():
    with pytest.raises(ValueError):
        BuildConfig(train_ratio=0.79)


def test_discovery(spark, tmp_path):
    for name in ("a/2.WAV", "a.x/1.wav", ".hid.wav", "_u/3.wav", "n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    found = [r.path for r in corpus.discover(spark, str(tmp_path)).orderBy("ord").collect()]
    assert [p.removeprefix(f"{tmp_path}/") for p in found] == [".hid.wav", "_u/3.wav", "a/2.WAV", "a.x/1.wav"]
    uris = [r.path for r in corpus.discover(spark, f"file://{tmp_path}").orderBy("ord").collect()]
    assert uris == [f"file://{p}" for p in found]
    assert corpus.discover(spark, str(tmp_path / "n.txt")).count() == corpus.discover(spark, "").count() == corpus.discover(spark, str(tmp_path / "none")).count() == 0


def test_wav_round_trip():
    x = np.linspace(-1, 1, 1001)
    y, rate = wav.decode(wav.encode(x, 8000))
    assert rate == 8000 and np.abs(y[:, 0] - x).max() < 2 / 32768
    with pytest.raises(wav.CodecUnavailable):
        wav.decode(b"fLaC")


@pytest.mark.parametrize("rirs", [0, 2])
def test_build(spark, tmp_path, rirs):
    rng = np.random.default_rng(2)
    for folder, n in (("speech", 2), ("noise", 2), ("rir", rirs)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"{i}.wav").write_bytes(wav.encode(rng.uniform(-0.5, 0.5, 900 + 400 * i), 8000))
    (tmp_path / "speech/bad.flac").write_bytes(b"fLaC")
    c = BuildConfig(str(tmp_path / "speech"), str(tmp_path / "noise"), str(tmp_path / "rir"), str(tmp_path / "out"), total_samples=12, target_sr=8000, segment_duration=0.125, rt60_range=(0.15, 0.2))
    counts = build.build(spark, c, workers=2)
    meta = json.loads((tmp_path / "out/metadata.json").read_text())
    assert {k: v["count"] for k, v in meta["splits"].items()} == counts and 0 < sum(counts.values()) < 12  # rows with the bad file go
    for split in meta["splits"].values():
        for i, s in enumerate(split["samples"]):
            x, _ = wav.decode((tmp_path / "out" / s["noisy_file"]).read_bytes())
            assert len(x) == 1000 and np.abs(x).max() == pytest.approx(0.95, abs=1e-3) and s["noisy_file"].endswith(f"{i:06d}.wav")


def test_impulse_response_is_the_plain_sum():
    dim, source, mic, rate, order = (4.1, 5.2, 2.7), (1.0, 2.0, 1.5), (2.2, 2.9, 1.1), 48_000, 4
    got, want = kernels.impulse_response(dim, source, mic, 0.3, order, rate), np.zeros(1 << 14)
    for m in np.ndindex(11, 11, 11):
        for p in np.ndindex(2, 2, 2):
            n = sum(abs(a - 5 - q) + abs(a - 5) for a, q in zip(m, p, strict=True))
            if n <= order:
                d = math.sqrt(sum(((1 - 2 * q) * s + 2 * (a - 5) * x - c) ** 2 for a, q, s, x, c in zip(m, p, source, dim, mic, strict=True)))
                t = np.arange(-40, 41) - (d / 343 * rate) % 1
                at = int(d / 343 * rate)
                want[at : at + 81] += 0.7 ** (n / 2) / (4 * math.pi * d) * np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / 41))
    assert np.allclose(got, want[40 : 40 + len(got)], atol=1e-12)


def test_impulse_response_of_many_images():
    """Order 50 at full rate: the plain sum at some samples, in less time than it takes to add up one tap of each image 60 times."""
    dim, source, mic, rate, order = (8.1, 6.3, 3.2), (1.0, 2.0, 1.5), (4.2, 2.9, 1.1), 48_000, 50
    taken = math.inf
    for _ in range(4):
        begun = time.process_time()
        got = kernels.impulse_response(dim, source, mic, 0.2, order, rate)
        taken = min(taken, time.process_time() - begun)
    d, n = kernels.images(dim, source, mic, order)
    assert len(d) == sum(1 for a in range(-order, order + 1) for b in range(abs(a) - order, order + 1 - abs(a)) for _ in range(2 * (order - abs(a) - abs(b)) + 1))
    gain, delay = 0.8 ** (n / 2) / (4 * np.pi * d), d / 343 * rate
    assert len(got) == int(delay.max()) + 42
    for k in (int(delay.min()), 500, 4015, 4016, 9000, 30_000, len(got) - 1):
        t = k - delay
        whole = k - np.floor(delay)
        assert got[k] == pytest.approx((gain * np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / 41)))[np.abs(whole) <= 40].sum(), abs=1e-12)
    whole, begun = np.floor(delay).astype(int), time.process_time()
    for _ in range(60):
        np.bincount(whole, gain)
    assert taken < time.process_time() - begun


def test_impulse_response_takes_no_more_than_it_needs(monkeypatch):
    """Order 50: fewer sums than 12 of every image, memory anew for fewer than 2 arrays of them, and right all along."""
    dim, source, mic, rate, order, summed = (8.1, 6.3, 3.2), (1.0, 2.0, 1.5), (4.2, 2.9, 1.1), 48_000, 50, []
    got, bincount = kernels.impulse_response(dim, source, mic, 0.2, order, rate), np.bincount
    d, n = kernels.images(dim, source, mic, order)
    gain, delay = 0.8 ** (n / 2) / (4 * np.pi * d), d / 343 * rate
    for k in np.linspace(delay.min(), len(got) - 1, 40).astype(int):
        t = (k - delay)[np.abs(k - np.floor(delay)) <= 40]
        assert got[k] == pytest.approx((gain[np.abs(k - np.floor(delay)) <= 40] * np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / 41))).sum(), abs=1e-12)
    monkeypatch.setattr(np, "bincount", lambda x, *more: summed.append(len(x)) or bincount(x, *more))
    tracemalloc.start()
    again = kernels.impulse_response(dim, source, mic, 0.2, order, rate)
    taken = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == again).all() and len(d) < sum(summed) < 12 * len(d) and taken < 2 * d.nbytes


@pytest.mark.parametrize("order, absorption", [(0, 0.3), (1, 1.0), (2, 0.0), (5, 1.5)])
def test_impulse_response_of_odd_rooms(order, absorption):
    """Few images, walls that give nothing or all back, a microphone in the source, images at the edges of spans and spans without images."""
    for dim, source in (((4.0, 5.0, 3.0), (1.0, 2.0, 1.0)), ((343 * 4014 / 96_000, 5.0, 3.0), (3.0, 2.0, 1.0)), ((400.0, 5.0, 3.0), (399.0, 1.0, 2.0))):
        mic = (1.0, 2.0, 1.0)
        got, (d, n) = kernels.impulse_response(dim, source, mic, absorption, order, 48_000), kernels.images(dim, source, mic, order)
        want = np.zeros(int(d.max() / 343 * 48_000) + 123)
        for a, k in zip(d, n, strict=True):
            at = int(a / 343 * 48_000)
            t = np.arange(-40, 41) - (a / 343 * 48_000 - at)
            want[at : at + 81] += max(0.0, 1 - absorption) ** (k / 2) / (4 * math.pi * max(a, 1e-3)) * np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / 41))
        assert np.allclose(got, want[40 : 40 + len(got)], rtol=0, atol=1e-11) and len(got) == int(d.max() / 343 * 48_000) + 42


def test_room_responses_are_whole(spark, tmp_path):
    from pairwave.operators import room
    from pairwave.plans import queries

    spark.createDataFrame([(i, [0.1] * 64, i % 10) for i in range(12)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.global_idx: r for r in queries.ism_rir(spark, str(tmp_path)).collect()}
    rooms = room.sources(room.rooms(spark.range(12).select(F.col("id").alias("global_idx")), queries.CONFIG), queries.CONFIG).collect()
    assert len(got) == 12
    for r in rooms:
        for source, n in (("near", "n"), ("far", "far_n")):
            dim, of, mic = ([r[f"{k}_{a}"] for a in "xyz"] for k in ("dim", source, "mic"))
            assert got[r.global_idx][n] == (len(kernels.impulse_response(dim, of, mic, r.absorption, r.max_order, 48_000)) if r.feasible else None)


def test_room_responses_are_dealt_to_small_tasks(spark, tmp_path):
    """More rooms make more tasks, not longer ones; a response of other taps between two doesn't change them."""
    from pairwave.plans import queries

    spark.range(3000).selectExpr("id AS vec_id", "array(0.5F) AS embedding", "int(id % 10) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.ism_rir(spark, str(tmp_path)).rdd.getNumPartitions() == 15
    at = ((4.0, 5.0, 3.0), (1.0, 2.0, 1.0), (3.0, 1.0, 2.0), 0.3, 9, 48_000)
    first, _, again = (kernels.impulse_response(*at, half=half) for half in (40, 10, 40))
    assert (first == again).all()


def test_nothing_gives_nothing(spark):
    nothing = F.array().cast("array<double>")
    assert one(spark, signal.frames_of(nothing, 2)) == one(spark, signal.resampled(nothing, 3, 2, [1.0])) == one(spark, signal.fanned_out(signal.frames_of(nothing, 2), 3)) == []
    assert one(spark, signal.frames_of(xs(1, 2, 3), 2)) == [[1, 2]]


@pytest.mark.parametrize("h", [[], [1.0], [1.0, 0.5, 0.25]])
def test_convolution_of_many(h):
    rng = np.random.default_rng(3)
    signals = [rng.normal(size=n) for n in (5, 0, 7, 5, 1)]
    for x, y in zip(signals, kernels.convolve_many(signals, np.array(h)), strict=True):
        assert np.allclose(y, kernels.convolve(x, np.array(h)))


def test_denoiser_plug_in(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0]), (2, [])], "i long, x array<double>")
    got = {r.i: r.x for r in denoise.denoised(rows, denoise.Smoother).collect()}
    assert got == {1: [0.5, 2.0], 2: []}
    same = denoise.denoised(rows)
    assert "Python" not in same._jdf.queryExecution().executedPlan().toString() and same.collect() == rows.collect()


def test_mixing_is_not_worked_out_for_the_filter(spark):
    from pairwave.plans import queries

    plan = queries.mix_pipeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("aggregate(" in line for line in filters)


COMMAND_ROWS = [
    (1, 1, "view", 0.5, "SET_GAIN", 6.0), (1, 2, "error", -1.0, "SET_STRENGTH", None), (1, 3, "view", 0.25, "SET_INPUT_DEVICE", 9.0), (1, 4, "view", 0.5, "SET_ENABLED", 0.0),
    (1, 5, "view", 0.5, "GET_DEVICES", None), (1, 6, "view", 0.5, "NO_SUCH", 1.0), (1, 7, "view", 0.5, "SHUTDOWN", None), (1, 8, "view", 0.5, None, None), (2, 9, "view", 0.1, None, None),
]


def command_rows(spark, rows=COMMAND_ROWS):
    return spark.createDataFrame(rows, "stream_id long, seq long, kind string, value double, command string, arg double").withColumn("ts", F.timestamp_seconds("seq").cast("timestamp_ntz"))


def test_live_chain(spark):
    rows = command_rows(spark)
    got = sorted(blocks.processed(rows, 2, 2, 1, 2).collect(), key=lambda r: (r.stream_id, r.block_idx))
    assert [(r.block_idx, r.enabled, r.gain_db, r.faults, r.in_peak) for r in got] == [(0, True, 0.0, 1, 1.0), (1, True, 6.0, 1, 0.5), (2, False, 6.0, 1, 0.5)]  # the last sample and stream 2 fill no block
    assert [f for r in got for f in r.frames] == [[0.25, 0.25], [pytest.approx(0.125 * 10**0.3)] * 2, [pytest.approx(0.5 * 10**0.3)] * 2]
    devices_ = spark.createDataFrame([(1, "B"), (0, "A")], "index int, name string")
    found = [(r.seq, r.event, r.payload) for r in sorted(blocks.events(rows, blocks.processed(rows, 2, 2, 1, 2), devices_).collect(), key=lambda r: (r.seq, r.event))]
    assert found == [(2, "ERROR", "SET_STRENGTH: not a number"), (3, "ERROR", "SET_INPUT_DEVICE: no device 9"), (5, "DEVICE_LIST", "A, B"), (6, "STATUS", None), (7, "ENGINE_STOPPED", None)]


def test_live_chain_over_micro_batches(spark, tmp_path):
    """A handle on the stream, fed file by file: the same blocks and answers as at once, and nothing twice."""
    folder, want = str(tmp_path / "in"), []
    rows = command_rows(spark)
    for part in (rows.where("seq <= 3"), rows.where("seq > 3 and seq <= 6")):
        part.coalesce(1).write.mode("append").parquet(folder)
    h = live.Handle(live.engine(live.rows_from(spark, folder, rows.schema, files=1), 2, 2, 1, 2, [(1, "B"), (0, "A")]))
    h.start()
    h.start()
    assert h.alive
    h.query.processAllAvailable()
    first = h.poll_events()
    rows.where("seq > 6").coalesce(1).write.mode("append").parquet(folder)
    h.query.processAllAvailable()
    h.stop()
    assert not h.alive and [(r.event, r.payload) for r in h.poll_events()] == [("ENGINE_STOPPED", None)] and h.poll_events() == []
    second = [r for n in range(3) for r in spark.read.schema(live.ENGINE).parquet(f"{h.folder}/batch={n}").collect()]
    want = [(0, "BLOCK", [0.25, 0.25]), (None, "ERROR", None), (None, "ERROR", None), (1, "BLOCK", [pytest.approx(0.125 * 10**0.3)] * 2), (None, "DEVICE_LIST", None), (2, "BLOCK", [pytest.approx(0.5 * 10**0.3)] * 2), (None, "ENGINE_STOPPED", None)]
    assert [(r.block_idx, r.event, r.samples) for r in second] == want
    assert [r.event for r in first] == ["ERROR", "ERROR", "DEVICE_LIST"]


def test_labels(spark):
    assert one(spark, signal.percent_label(F.lit(50))) == "50 %"
    assert [one(spark, signal.status_text(F.lit(n))) for n in (0, 3)] == ["Engine running", "Engine running  |  x-runs: 3"]


def test_build_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    for folder in ("speech/_u", "noise"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "0.wav").write_bytes(wav.encode(np.random.default_rng(1).uniform(-0.5, 0.5, 900), 8000))
    where = [x for k in ("speech", "noise") for x in (f"--{k}-dir", str(tmp_path / k))] + ["--output-dir", str(tmp_path / "out")]
    more = ["--total-samples", "5", "--target-sr", "8000", "--segment-duration", "0.1", "--rir", "synthetic"]
    build.main([*where, *more])
    assert "'train': 4" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)  # folders from here, and as URIs
    for speech, noise, out in (("speech", "noise/", "near"), (f"file://{tmp_path}/speech", f"file:{tmp_path}/noise", f"file://{tmp_path}/far")):
        build.main(["--speech-dir", speech, "--noise-dir", noise, "--output-dir", out, *more])
        assert "'train': 4" in capsys.readouterr().out
    names = [sorted(str(p.relative_to(tmp_path / d)) for p in (tmp_path / d).rglob("*") if p.suffix in (".wav", ".json")) for d in ("out", "near", "far")]
    assert names[0] == names[1] == names[2] and len(names[0]) == 11
    with pytest.raises(FileNotFoundError):
        build.main([*where, *more[:-1], "file"])
