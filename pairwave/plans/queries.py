"""The registered queries of the signal engine. Signals are the vectors of ``embeddings``: those labelled under 5 are the speech
pool and the others the noise pool; streams are the events of each user. ``oracle.SQL`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.config import BuildConfig, StreamConfig
from pairwave.functions import denoise, signal
from pairwave.functions.rng import pick, uniform
from pairwave.operators import blocks, chunked, corpus, devices, kernels, long_streams, room, visiting
from pairwave.operators.numbering import numbered
from pairwave.plans import dataset
from pairwave.sources import feed, wav
from pairwave.sources.shared import new_folder, written
from pairwave.streaming import live, processors, progress

CONFIG = BuildConfig()
#: Samples of a segment, a padded segment and a block; room responses; the filter of a 3:2 resampling.
SEGMENT, PADDED, BLOCK = 48, 96, 16
#: Channels of the live chain: of what comes in, taken from it, and going out.
CHANNELS_IN, CHANNELS_TAKEN, CHANNELS_OUT = 2, 1, 2
NEAR, FAR = (1.0, 0.5, 0.25), (0.0, 0.0, 0.6, 0.3)
UP, DOWN, TAPS = 3, 2, (0.1, 0.4, 0.8, 1.0, 0.8, 0.4, 0.1)
#: Samples of a chunk of a long signal: no divisor of a vector's length.
CHUNK = 10
RESPONSES, GAIN_DB, STRENGTH, CHANNELS = 5, 6.0, 0.25, 5
#: Rooms of a task: some seconds' work, so that no core waits long for the last tasks.
ROOMS = 200
# Endings of the file names made of documents, by doc_id % 7; devices; sizes of builds.
ENDINGS = (".wav", ".FLAC", ".mp3", ".txt", ".ogg", ".aif", ".bak")
DEVICES = [(0, "Mic", 1, 0, 44100.0), (1, "Speakers", 0, 2, 48000.0), (2, "Interface", 4, 4, 48000.0), (3, "Null", 0, 0, 8000.0)]
DEFAULT_IN, DEFAULT_OUT = 2, -1
TOTALS = (0, 1, 3, 7, 101)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def array(values: tuple[float, ...]) -> Column:
    return F.array(*map(F.lit, values))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def pool(spark: SparkSession, sf_dir: str, speech: bool) -> DataFrame:
    """(ord, name, vec_id, x)"""
    rows = vectors(spark, sf_dir).where("label < 5" if speech else "label >= 5")
    placed = numbered(rows.select("vec_id", "x"), F.floor(F.col("vec_id") / dataset.BUCKET), ["vec_id"], "ord")
    return placed.select("ord", F.format_string("%s/%06d.wav", F.lit("speech" if speech else "noise"), "vec_id").alias("name"), "vec_id", "x")


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are vectors."""
    n, speech = (table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.col("label") < 5).alias("s")).first())
    return dataset.draws(spark, n, speech, n - speech, CONFIG, RESPONSES)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.paired(planned(spark, sf_dir), pool(spark, sf_dir, True), pool(spark, sf_dir, False))


def convolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """global_idx, snr_db, s, n: segments after their room responses."""
    p = pairs(spark, sf_dir)
    cut = p.select("global_idx", "snr_db", signal.segment(F.col("speech"), SEGMENT, F.col("u_speech")).alias("s"), signal.segment(F.col("noise"), SEGMENT, F.col("u_noise")).alias("n"))
    return cut.select("global_idx", "snr_db", signal.convolved(F.col("s"), array(NEAR)).alias("s"), signal.convolved(F.col("n"), array(FAR)).alias("n"))


def with_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = convolved_pairs(spark, sf_dir).withColumn("gain", signal.snr_gain(F.col("s"), F.col("n"), F.col("snr_db")))
    return m.withColumn("noisy", signal.mixed(F.col("s"), F.col("n"), F.col("gain")))


def check(x: Column | str, name: str = "checksum") -> Column:
    return signal.checksum(F.col(x) if isinstance(x, str) else x).alias(name)


def six(x: Column, name: str) -> Column:
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def streams(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 7).cast("int"))
    name = F.concat(F.format_string("%06d", F.col("doc_id")), ending)
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", name).alias("path"), F.col("n_chars").alias("length"))


@query
def corpus_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.audio_files(files(spark, sf_dir)).select("path", "ext", "length")


@query
def corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ordered(corpus.audio_files(files(spark, sf_dir))).select("ord", "path")


@query
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono = signal.downmixed(signal.frames_of(F.col("x"), 2))
    return vectors(spark, sf_dir).select("vec_id", mono.alias("m")).select("vec_id", F.size("m").cast("long").alias("n"), check("m"))


@query
def resample_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.resampled(F.col("x"), UP, DOWN, list(TAPS))
    return vectors(spark, sf_dir).select("vec_id", out.alias("y")).select("vec_id", F.size("y").cast("long").alias("n"), check("y"))


@query
def signal_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole vectors, rising: as they come, all have the same."""
    rising = F.transform("x", lambda v, i: v * (i + 1))
    return vectors(spark, sf_dir).select("vec_id", six(signal.rms(rising), "rms"))


@query
def signal_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", six(signal.peak(F.col("x")), "peak"))


def segments(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    u = uniform(CONFIG.seed, F.col("vec_id"), "soff")
    cut = vectors(spark, sf_dir).select("vec_id", signal.segment(F.col("x"), length, u).alias("y"))
    return cut.select("vec_id", F.size("y").cast("long").alias("n"), check("y"))


@query
def segment_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir, SEGMENT)


@query
def segment_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir, PADDED)


@query
def convolve_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = vectors(spark, sf_dir).select("vec_id", signal.convolved(F.col("x"), array(NEAR)).alias("y"))
    return y.select("vec_id", F.size("y").cast("long").alias("n"), check("y"))


@query
def convolve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows: each sample meets each tap, products with the same i + j add up, and the tail is cut."""
    x = vectors(spark, sf_dir).select("vec_id", F.size("x").alias("size"), F.posexplode("x").alias("i", "v"))
    products = x.select("vec_id", "size", "i", "v", F.posexplode(array(NEAR)).alias("j", "h")).where("i + j < size")
    y = products.groupBy("vec_id", (F.col("i") + F.col("j")).alias("k")).agg(F.sum(F.col("v") * F.col("h")).alias("y"))
    return y.groupBy("vec_id").agg(F.count("*").alias("n"), (F.round(F.sum((F.col("k") + 1) * F.col("y")), 6) + F.lit(0.0)).alias("checksum"))


@query
def fft_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by FFT on Arrow batches, as for full-rate signals."""
    h = np.array(NEAR)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(x=kernels.convolve_many([np.asarray(x) for x in b["x"]], h))

    y = vectors(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, x array<double>")
    return y.select("vec_id", F.size("x").cast("long").alias("n"), check("x"))


def whole_check(y: DataFrame) -> DataFrame:
    """vec_id, n, checksum of signals in chunks (id, start, y): the sums of whole ones, without putting them together."""
    part = F.aggregate(F.zip_with("y", F.sequence(F.lit(0), F.size("y") - 1), lambda v, i: v * (i + F.col("start") + 1)), F.lit(0.0), lambda a, v: a + v)
    return y.groupBy(F.col("id").alias("vec_id")).agg(F.sum(F.size("y")).alias("n"), (F.round(F.sum(part), 6) + F.lit(0.0)).alias("checksum"))


@query
def convolve_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for signals in chunks, which may be longer than a row."""
    rows = chunked.chunks(vectors(spark, sf_dir).withColumnRenamed("vec_id", "id"), CHUNK)
    return whole_check(chunked.convolved(rows, np.array(NEAR), CHUNK))


@query
def resample_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample_fir for signals in chunks."""
    rows = chunked.chunks(vectors(spark, sf_dir).withColumnRenamed("vec_id", "id"), CHUNK)
    return whole_check(chunked.resampled(rows, UP, DOWN, np.array(TAPS), CHUNK))


@query
def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("global_idx", "speech_file", "noise_file")


def vector_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The vectors as a tree of float WAV files; its folder, and the pools as (ord, speech, name)."""
    spark.dataSource.register(wav.WavSource)
    folder, speech = new_folder(spark, "vectors"), F.col("label") < 5
    name = F.format_string("%s/%06d.wav", F.when(speech, "speech").otherwise("noise"), "vec_id")
    rows = vectors(spark, sf_dir).select("vec_id", speech.alias("speech"), name.alias("name"), "x")
    rows.select(F.col("name").alias("path"), F.lit(CONFIG.target_sr).alias("sr"), F.col("x").alias("samples")).write.format("wav").mode("append").option("subtype", "FLOAT").save(folder)
    return folder, numbered(rows.select("vec_id", "speech", "name"), F.floor(F.col("vec_id") / dataset.BUCKET), ["vec_id"], "ord", ("speech",)).select("ord", "speech", "name")


@query
def wav_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector from the files of a folder, listed and read by the tasks."""
    read = spark.read.format("wav").load(vector_files(spark, sf_dir)[0])
    return read.select(F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long").alias("vec_id"), F.col("sr").cast("long").alias("sr"), "frames", check("samples"))


@query
def visit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all pairs, cut where the files are."""
    folder, pools = vector_files(spark, sf_dir)
    plan, names, cut = written(planned(spark, sf_dir), "draws"), written(pools, "pools"), []
    for kind, u in (("speech", "u_speech"), ("noise", "u_noise")):
        of = names.where(F.col("speech") == (kind == "speech")).select(F.col("ord").alias(f"{kind}_ord"), F.col("name").alias("path"))
        drawn = plan.join(of, f"{kind}_ord").select("global_idx", "path", F.col(u).alias("u"))
        cut.append(visiting.segments(drawn, folder, CONFIG.target_sr, SEGMENT).select("global_idx", F.col("path").alias(f"{kind}_file"), check("x", f"{kind}_sum")))
    return cut[0].join(cut[1], "global_idx")


@query
def rir_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws with replacement; for comparison, also two that differ."""
    p = planned(spark, sf_dir)
    other = pick(uniform(CONFIG.seed, F.col("global_idx"), "rir_far"), RESPONSES - 1)
    return p.select("global_idx", "rir_near_ord", "rir_far_ord", (other + (other >= F.col("rir_near_ord")).cast("long")).alias("rir_far_distinct_ord"))


@query
def snr_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convolved_pairs(spark, sf_dir).select("global_idx", six(signal.snr_gain(F.col("s"), F.col("n"), F.col("snr_db")), "gain"))


@query
def mix_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_mix(spark, sf_dir).select("global_idx", check("noisy", "noisy_sum"), check("s", "clean_sum"))


@query
def joint_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = with_mix(spark, sf_dir).withColumn("g", signal.normal_gain(signal.peak(F.col("noisy")), CONFIG.peak_norm_target))
    return g.select("global_idx", check(signal.scaled(F.col("noisy"), F.col("g")), "noisy_sum"), check(signal.scaled(F.col("s"), F.col("g")), "clean_sum"))


@query
def peak_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = signal.normal_gain(signal.peak(F.col("x")), CONFIG.peak_norm_target)
    return vectors(spark, sf_dir).select("vec_id", check(signal.scaled(F.col("x"), g)))


@query
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, *BuildConfig(total_samples=n).sizes().values()) for n in TOTALS]
    return spark.createDataFrame(rows, "total long, train long, val long, test long")


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    p = spark.range(n).select(F.col("id").alias("global_idx"), uniform(CONFIG.seed, F.col("id"), "split").alias("u_split"))
    return dataset.split(p, BuildConfig(total_samples=n))


@query
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_plan(spark, sf_dir).select("global_idx", "split")


@query
def local_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.local_index(split_plan(spark, sf_dir)).select("global_idx", "split", "local_idx")


@query
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build's draws where the files themselves are split, by their samples: no file is in two splits."""
    speech = F.col("label") < 5
    kind = F.when(speech, "speech").otherwise("noise")
    files = vectors(spark, sf_dir).select(kind.alias("pool"), F.format_string("%s/%06d.wav", kind, "vec_id").alias("name"), F.size("x").cast("long").alias("weight"), uniform(CONFIG.seed, F.col("vec_id"), "source").alias("u"))
    placed = written(dataset.source_splits(files, CONFIG), "source-splits")
    return dataset.drawn_within(split_plan(spark, sf_dir).select("global_idx", "split"), placed, CONFIG).select("global_idx", "split", "speech_file", "noise_file")


@query
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all rows, and what they would be a million further on."""
    rows = dataset.local_index(split_plan(spark, sf_dir))
    far = rows.withColumn("local_idx", F.col("local_idx") + 1_000_000)
    return rows.unionByName(far).select("global_idx", "local_idx", dataset.output_path("noisy").alias("noisy_file"), dataset.output_path("clean").alias("clean_file"))


def drawn_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many as there are vectors."""
    n = table(spark, sf_dir, "embeddings").count()
    return room.rooms(spark.range(n).select(F.col("id").alias("global_idx")), CONFIG)


@query
def room_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{k}_{a}" for k in ("dim", "mic") for a in room.AXES]
    return drawn_rooms(spark, sf_dir).select("global_idx", *(six(F.col(n), n) for n in [*names, "rt60"]))


@query
def inverse_sabine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_rooms(spark, sf_dir).select("global_idx", six(F.col("absorption"), "absorption"), "full_order", F.col("max_order").cast("long").alias("max_order"), "order_capped", "feasible")


@query
def source_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{k}_{a}" for k in ("near", "far") for a in room.AXES]
    return room.sources(drawn_rooms(spark, sf_dir), CONFIG).select("global_idx", *(six(F.col(n), n) for n in names))


@query
def ism_rir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room responses, near and far, of as many rooms as there are vectors: lengths and where the direct sound stands; null for
    rooms whose reverberation time no wall gives."""
    rooms = drawn_rooms(spark, sf_dir)
    placed = room.sources(rooms, CONFIG)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), rooms.count() // ROOMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.to_dict("records"):
                at = lambda n, r=r: [r[f"{n}_{a}"] for a in "xyz"]
                row = [r["global_idx"]]
                for source in ("near", "far"):
                    h = kernels.impulse_response(at("dim"), at(source), at("mic"), r["absorption"], int(r["max_order"]), CONFIG.target_sr) if r["feasible"] else None
                    row += [None, None] if h is None else [len(h), int(np.argmax(np.abs(h)))]
                made.append(row)
            yield pd.DataFrame(made, columns=["global_idx", "n", "peak_at", "far_n", "far_peak_at"], dtype="Int64")

    return placed.repartition(n).mapInPandas(run, "global_idx long, n long, peak_at long, far_n long, far_peak_at long")


def mixed_rows(spark: SparkSession, sf_dir: str, *figures: Column) -> DataFrame:
    """The good rows of a build by their names and numbers, with figures of their audio: what is written and numbered has no samples."""
    p = dataset.split(pairs(spark, sf_dir), BuildConfig(total_samples=table(spark, sf_dir, "embeddings").count()))
    spread = p.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "global_idx")  # little data, much work
    made = dataset.mixed(spread, SEGMENT, array(NEAR), array(FAR), CONFIG.peak_norm_target)
    return written(made.select("global_idx", "split", "speech_file", "noise_file", "snr_db", "error", *figures), "mixed").where("error is null")


@query
def mix_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: draws, pairing, segments, room responses, mixing, normalising, splits and numbers."""
    rows = dataset.local_index(mixed_rows(spark, sf_dir, check("noisy", "noisy_sum"), check("clean", "clean_sum")))
    return rows.select("global_idx", "split", "local_idx", "speech_file", "noise_file", six(F.col("snr_db"), "snr_db"), "noisy_sum", "clean_sum")


@query
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.manifest(dataset.local_index(mixed_rows(spark, sf_dir)), "synthetic")


@query
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_counts(mixed_rows(spark, sf_dir))


@query
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each sample; the driver joins the lines of a build into one file."""
    m = dataset.manifest(dataset.local_index(mixed_rows(spark, sf_dir)), "synthetic")
    return m.select("index", F.to_json(F.struct(*[c for c in m.columns if c != "split"])).alias("json"))


@query
def pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = signal.pcm16(signal.scaled(F.col("x"), F.lit(4.0)))
    return vectors(spark, sf_dir).select("vec_id", F.aggregate(y, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max(y).cast("long").alias("most"))


@query
def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a WAV file and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": [wav.encode(np.asarray(x), 48_000) for x in b["x"]]})

    read = wav.decoded(vectors(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "path string, content binary"))
    return read.select(F.col("path").cast("long").alias("vec_id"), F.col("sr").cast("long").alias("sr"), check("samples"))


@query
def gain_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = signal.clipped(signal.scaled(F.col("x"), signal.db_to_linear(F.lit(4 * GAIN_DB))))
    return vectors(spark, sf_dir).select("vec_id", six(signal.peak(y), "peak"), check(y))


@query
def wet_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry samples blended with filtered ones."""
    wet = vectors(spark, sf_dir).withColumn("w", signal.convolved(F.col("x"), array(FAR)))
    return wet.select("vec_id", check(signal.blended(F.col("x"), F.col("w"), F.lit(STRENGTH))))


@query
def enabled_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered where the label is even, else as it came."""
    on = F.col("label") % 2 == 0
    return vectors(spark, sf_dir).select("vec_id", on.alias("enabled"), check(F.when(on, signal.convolved(F.col("x"), array(FAR))).otherwise(F.col("x"))))


@query
def channel_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.flatten(signal.fanned_out(signal.frames_of(F.col("x"), 2), CHANNELS))
    return vectors(spark, sf_dir).select("vec_id", y.alias("y")).select("vec_id", F.size("y").cast("long").alias("n"), check("y"))


@query
def denoiser_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in that averages neighbours, blended with what came in."""
    return denoise.denoised(vectors(spark, sf_dir).select("vec_id", "x"), denoise.Smoother, StreamConfig(strength=STRENGTH)).select("vec_id", check("x"))


@query
def denoiser_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.denoised(vectors(spark, sf_dir).select("vec_id", "x"), config=StreamConfig(strength=STRENGTH)).select("vec_id", check("x"))


@query
def channel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.flatten(signal.first_channels(signal.frames_of(F.col("x"), 4), 3))
    return vectors(spark, sf_dir).select("vec_id", y.alias("y")).select("vec_id", F.size("y").cast("long").alias("n"), check("y"))


@query
def device_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = devices.catalogued(spark.createDataFrame(DEVICES, devices.SCHEMA), DEFAULT_IN, DEFAULT_OUT)
    each = [devices.labelled(known, d).select(F.lit(d).alias("direction"), F.col("index").cast("long").alias("index"), "label", "is_default_input", "is_default_output") for d in ("input", "output")]
    return each[0].unionByName(each[1])


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(streams(table(spark, sf_dir, "events")), BLOCK)


@query
def block_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_blocks(spark, sf_dir).select("stream_id", "block_idx", "n", six(F.col("peak"), "peak"), six(F.col("level_db"), "level_db"))


@query
def status_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.status(event_blocks(spark, sf_dir)).select("stream_id", "tick", six(F.col("level_db"), "level_db"))


@query
def xrun_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.faults(streams(table(spark, sf_dir, "events"))).select("stream_id", "seq", "faults")


@query
def control_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.controlled(streams(table(spark, sf_dir, "events"))).select("stream_id", "seq", six(F.col("gain_db"), "gain_db"), six(F.col("strength"), "strength"))


def one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream, in ranges of time."""
    return long_streams.in_ranges(streams(table(spark, sf_dir, "events")).withColumn("stream_id", F.lit(0).cast("long")))


@query
def scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_streams.blocks(one_stream(spark, sf_dir), BLOCK).select("stream_id", "block_idx", "n", six(F.col("peak"), "peak"), six(F.col("level_db"), "level_db"))


@query
def scan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_streams.faults(one_stream(spark, sf_dir)).select("stream_id", "seq", "faults")


@query
def scan_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_streams.controlled(one_stream(spark, sf_dir)).select("stream_id", "seq", six(F.col("gain_db"), "gain_db"), six(F.col("strength"), "strength"))


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", signal.linear_to_db(F.col("value") / 1000).alias("db"), "value")


@query
def meter_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_levels(spark, sf_dir).select("event_id", signal.meter_value(F.col("db")).cast("long").alias("meter"))


@query
def level_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_levels(spark, sf_dir).select("event_id", signal.level_label(F.col("db")).alias("label"))


@query
def gain_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slider's place, in tenths of a dB, and its label."""
    tenths = (F.floor(F.col("value")) % 241 - 120).cast("long")
    return event_levels(spark, sf_dir).select("event_id", tenths.alias("slider")).select("event_id", "slider", signal.gain_label(F.col("slider") / 10).alias("label"))


@query
def percent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", signal.percent_label(F.floor("value") % 101).alias("label"))


@query
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = blocks.faults(streams(table(spark, sf_dir, "events")))
    return counted.select("stream_id", "seq", signal.status_text(F.col("faults")).alias("text"))


def commands(events: DataFrame) -> DataFrame:
    """Events as samples about zero, some of which bring a command: all seven, and arguments that some of them can't take."""
    kind, turn, whole = F.col("event_type"), F.col("event_id") % 4, F.floor("value")
    command = (
        F.when(kind == "signup", "SET_GAIN")
        .when(kind == "click", "SET_STRENGTH")
        .when((kind == "view") & (turn == 0), "SET_ENABLED")
        .when((kind == "purchase") & (turn == 0), "SET_INPUT_DEVICE")
        .when((kind == "purchase") & (turn == 1), "SET_OUTPUT_DEVICE")
        .when((kind == "purchase") & (turn == 2), "GET_DEVICES")
        .when((kind == "purchase") & (F.col("event_id") % 40 == 3), "SHUTDOWN")
    )
    arg = (
        F.when((kind == "signup") & (F.col("event_id") % 5 > 0), F.col("value") / 100)
        .when((kind == "click") & (F.col("event_id") % 5 > 0), F.col("value") / 100)
        .when(kind == "view", (whole % 2).cast("double"))
        .when(kind == "purchase", (whole % 6 - 1).cast("double"))
    )
    return events.select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), ((F.col("value") - 50) / 200).alias("value"), command.alias("command"), arg.alias("arg"))


CONTROLS = ("enabled", "strength", "gain_db", "input_device", "output_device")


@query
def control_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All controls as each row finds them, until the stream is shut down."""
    live = blocks.states(blocks.running(commands(table(spark, sf_dir, "events"))))
    return live.select("stream_id", "seq", "enabled", six(F.col("strength"), "strength"), six(F.col("gain_db"), "gain_db"), "input_device", "output_device")


def live_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.processed(commands(table(spark, sf_dir, "events")), BLOCK, CHANNELS_IN, CHANNELS_TAKEN, CHANNELS_OUT)


@query
def live_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole live chain on full blocks."""
    return live_chain(spark, sf_dir).select(
        "stream_id", "block_idx", "enabled", six(F.col("strength"), "strength"), six(F.col("gain_db"), "gain_db"), "input_device", "output_device", "faults", six(F.col("in_peak"), "in_peak"), six(F.col("out_peak"), "out_peak"), check(F.flatten("frames"))
    )


def known_devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEVICES, devices.SCHEMA)


@query
def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status at each tick, device lists, errors and ends, of all streams."""
    found = blocks.events(commands(table(spark, sf_dir, "events")), live_chain(spark, sf_dir), known_devices(spark))
    return found.select("stream_id", "seq", "event", "payload", six(F.col("input_db"), "input_db"), six(F.col("output_db"), "output_db"), "faults")


def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.rows_from(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(event_source(spark, sf_dir))


def engine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.engine(commands(event_source(spark, sf_dir)), BLOCK, CHANNELS_IN, CHANNELS_TAKEN, CHANNELS_OUT, [(d[0], d[1]) for d in DEVICES])


@query
def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chain as a stream."""
    out = live.run_to_end(engine_stream(spark, sf_dir)).where("event = 'BLOCK'")
    return out.select("stream_id", "block_idx", "enabled", six(F.col("strength"), "strength"), six(F.col("gain_db"), "gain_db"), "faults", six(F.col("in_peak"), "in_peak"), six(F.col("out_peak"), "out_peak"), check("samples"))


@query
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream answers to commands."""
    return live.run_to_end(engine_stream(spark, sf_dir)).where("event <> 'BLOCK'").select("stream_id", "seq", "event", "payload")


@query
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full blocks with the faults so far; the rows left over wait for more."""
    return live.run_to_end(live.blocks(event_stream(spark, sf_dir), BLOCK)).select("stream_id", "block_idx", six(F.col("peak"), "peak"), "faults")


@query
def stream_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_to_end(live.controlled(event_stream(spark, sf_dir))).select("stream_id", "seq", six(F.col("gain_db"), "gain_db"), six(F.col("strength"), "strength"))


@query
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of blocks into a table, and from there a stream of the levels of each hour's last block."""
    folder = live.landed(engine_stream(spark, sf_dir))
    found = spark.readStream.schema(live.ENGINE).parquet(folder).where("event = 'BLOCK'")
    return live.run_to_end(live.status(found), "complete").select("stream_id", "tick", six(F.col("input_db"), "input_db"), six(F.col("output_db"), "output_db"), "faults")


@query
def processor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_blocks by a stateful processor."""
    out = live.run_to_end(processors.applied(event_stream(spark, sf_dir), processors.Blocks(BLOCK)))
    return out.select("stream_id", "block_idx", six(F.col("peak"), "peak"), "faults")


@query
def processor_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_control by a stateful processor."""
    out = live.run_to_end(processors.applied(event_stream(spark, sf_dir), processors.Controls()))
    return out.select("stream_id", "seq", six(F.col("gain_db"), "gain_db"), six(F.col("strength"), "strength"))


#: Arrivals that each of two sources comes in, of as many files as there are cores; a row may come an arrival later than its time says.
ARRIVALS = 5


def arriving(rows: DataFrame, name: str) -> tuple[str, int]:
    """rows (ts, seq, ...) as arrivals that come one after the other, out of order by up to one, and at last a file that ends the time; their
    folder, and the seconds by which a row can be late."""
    folder, width = new_folder(rows.sparkSession, name), rows.sparkSession.sparkContext.defaultParallelism
    low, high = rows.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    step = (high - low) // (ARRIVALS - 1) + 1
    at = ((F.unix_seconds(F.col("ts").cast("timestamp")) - low) / step + F.pmod(F.xxhash64("seq"), F.lit(1000)) / 1000).cast("int")
    dealt = written(rows.withColumn("__file", at), name)
    for k in range(ARRIVALS + 1):
        dealt.where(F.col("__file") == k).drop("__file").repartition(width).write.mode("append").parquet(folder)
    end = [F.lit(-1).cast("long").alias("stream_id"), (F.lit(high + 4 * step).cast("timestamp").cast("timestamp_ntz")).alias("ts"), F.lit(-1).cast("long").alias("seq")]
    have = {"stream_id", "ts", "seq"}
    more = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in have]
    rows.sparkSession.range(1).select(*end, *more).select(rows.columns).coalesce(1).write.mode("append").parquet(folder)
    return folder, 2 * step


@query
def ordered_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """control_state from two sources, samples and commands, whose rows come out of order over many micro-batches."""
    rows = commands(table(spark, sf_dir, "events"))
    samples, late = arriving(rows.select("stream_id", "ts", "seq"), "samples")
    said, _ = arriving(rows.where("command is not null").select("stream_id", "ts", "seq", "command", "arg"), "commands")
    read = lambda folder, names: live.rows_from(spark, folder, rows.select(*names).schema, files=spark.sparkContext.defaultParallelism)
    out = live.run_to_end(processors.in_order(read(samples, ["stream_id", "ts", "seq"]), read(said, ["stream_id", "ts", "seq", "command", "arg"]), f"{late} seconds"))
    return out.select("stream_id", "seq", "enabled", six(F.col("strength"), "strength"), six(F.col("gain_db"), "gain_db"), "input_device", "output_device")


@query
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener heard of a stream over all events: rows in, and observed rows and faults, summed over its micro-batches."""
    folder, name = new_folder(spark, "progress"), f"progress-{uuid.uuid4().hex}"
    heard = progress.Progress(name, folder)
    spark.streams.addListener(heard)
    try:
        seen = event_stream(spark, sf_dir).observe("seen", F.count("*").alias("made"), F.count_if(F.col("kind") == blocks.FAULT).alias("faults"))
        live.landed(seen, name)
        if not heard.ended.wait(120):
            raise TimeoutError("the stream's end was not heard of")
    finally:
        spark.streams.removeListener(heard)
    of = lambda k: F.sum(F.element_at("observed", k)).alias(k)
    return progress.table(spark, folder).agg(F.sum("rows_in").alias("rows_in"), of("made"), of("faults"))


#: Rows of an admission of the feed at most, and admissions that a micro-batch is given at most while more wait.
ADMITTED, TOGETHER = 2_500, 32


@query
def stream_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, landed in files by ranges, through a source with offsets of its own: for each admission
    its rows, the backlog left behind it, faults and last event."""
    events, log, landing = table(spark, sf_dir, "events"), new_folder(spark, "feed-log"), new_folder(spark, "feed")
    events.select("event_id", "event_type").repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(landing)
    rows = feed.feed(spark, landing, events.select("event_id", "event_type").schema, log, ADMITTED, order="name", admissions=TOGETHER)
    folder = live.drained(rows, new_folder(spark, "stream-log"))
    came = spark.read.schema(rows.schema).parquet(folder).groupBy((F.floor(F.col("offset") / ADMITTED) * ADMITTED).alias("start"))
    held = came.agg(F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("faults"), F.max("event_id").alias("last_event"))
    given = feed.admissions(spark, log)
    total = given.agg(F.max("end")).first()[0]
    return given.join(held, "start", "left").select("start", "end", (F.lit(total) - F.col("end")).alias("backlog"), "rows", "faults", "last_event")
