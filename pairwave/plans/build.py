"""A dataset build from folders of WAV files: a Spark job from discovery to files and manifest.

    python -m pairwave.plans.build --speech-dir speech --noise-dir noise --output-dir out --total-samples 100
"""

from __future__ import annotations

import argparse
import io
import json
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwave.config import BuildConfig
from pairwave.operators import kernels, room, visiting
from pairwave.operators.corpus import discover
from pairwave.operators.numbering import numbered
from pairwave.plans import dataset
from pairwave.sources.shared import file_system, located, written
from pairwave.sources.wav import SUBTYPES, WavSource, decoded

log = logging.getLogger(__name__)


def plain(path: Column) -> Column:
    """A path without scheme and first slashes, of which Spark and others write different numbers."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*:)?/+", "")


def loaded(spark: SparkSession, files: DataFrame, root: str, rate: int) -> DataFrame:
    """(ord, name, x, error): signals of a corpus (the files found below root) at the target rate. A file that Spark doesn't find gives an error."""
    root, files = located(root), files.withColumn("key", plain(F.col("path")))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = [r.path for r in files.where(F.substring("path", len(root) + 1, 1 << 20).rlike("(^|/)[._]")).select("path").collect()]  # names that Spark passes over
    if hidden:
        found = found.unionByName(spark.read.format("binaryFile").load(hidden))
    keyed = found.select(plain(F.col("path")).alias("path"), "content")
    content = keyed.join(files.select(F.col("key").alias("path")), "path", "left_semi")

    def at_rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [None if s is None else kernels.resample(np.asarray(s), int(r), rate) for s, r in zip(b["samples"], b["sr"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "x": x, "error": b["error"]})

    signals = decoded(content).mapInPandas(at_rate, "path string, x array<double>, error string")
    read = files.join(signals.withColumnRenamed("path", "key"), "key").select("ord", F.col("path").alias("name"), "x", "error")
    lost = files.join(keyed.select(F.col("path").alias("key")), "key", "left_anti")
    return read.unionByName(lost.select("ord", F.col("path").alias("name"), F.lit(None).cast("array<double>").alias("x"), F.lit("the file is listed and can't be found").alias("error")))


def with_fields(rows: DataFrame, **more: str) -> StructType:
    """The schema of rows with more fields, which may be null."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in more.items())).fields])


def responses(rows: DataFrame, c: BuildConfig) -> DataFrame:
    """rows with near, far: simulated room responses. A room that can't have the drawn reverberation time gives error."""
    placed = room.sources(room.rooms(rows, c), c)
    keep = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.to_dict("records"):
                at = lambda n, r=r: [r[f"{n}_{a}"] for a in "xyz"]
                if r["absorption"] > 1:
                    made.append((None, None, "the room can't have this reverberation time"))
                    continue
                near, far = (kernels.impulse_response(at("dim"), at(n), at("mic"), r["absorption"], int(r["max_order"]), c.target_sr) for n in ("near", "far"))
                made.append((near, far, None))
            yield b[keep].assign(near=[m[0] for m in made], far=[m[1] for m in made], room_error=[m[2] for m in made])

    return placed.mapInPandas(run, with_fields(rows, near="array<double>", far="array<double>", room_error="string"))


def mixed_long(pairs: DataFrame, c: BuildConfig) -> DataFrame:
    """The mixing stages on Arrow batches with FFT convolution, for signals at full rate; a failing row gives error."""
    keep = [x for x in pairs.columns if x not in ("speech", "noise", "near", "far", "room_error", "speech_error", "noise_error")]

    def place(x: np.ndarray, u: float) -> np.ndarray:
        n, start = c.segment_samples, int(u * (abs(len(x) - c.segment_samples) + 1))
        if len(x) >= n:
            return x[start : start + n]
        out = np.zeros(n)
        out[start : start + len(x)] = x
        return out

    def level(x: np.ndarray) -> float:
        r = float(np.sqrt(np.mean(x * x)))
        return r if r > 0 else 1e-12

    def one(r: dict) -> tuple:
        for e in ("speech_error", "noise_error", "room_error"):
            if r[e]:
                return None, None, r[e]
        s = kernels.convolve(place(np.asarray(r["speech"]), r["u_speech"]), np.asarray(r["near"]))
        n = kernels.convolve(place(np.asarray(r["noise"]), r["u_noise"]), np.asarray(r["far"]))
        noisy = s + n * (level(s) / 10 ** (r["snr_db"] / 20) / level(n))
        top = np.abs(noisy).max()
        if np.isnan(top):
            return None, None, "NaN"
        g = 1.0 if top < 1e-8 else c.peak_norm_target / top
        return noisy * g, s * g, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 8):
                part = b.iloc[at : at + 8]
                made = [one(r) for r in part.to_dict("records")]
                yield part[keep].assign(noisy=[m[0] for m in made], clean=[m[1] for m in made], error=[m[2] for m in made])

    return pairs.mapInPandas(run, with_fields(pairs.select(*keep), noisy="array<double>", clean="array<double>", error="string"))


def cut(plan: DataFrame, files: DataFrame, kind: str, c: BuildConfig) -> DataFrame:
    """(global_idx, and the kind's file, samples and error): the segments that a plan draws of a corpus, cut where its files are."""
    named = files.select(F.col("ord").alias(f"{kind}_ord"), F.col("path"))
    drawn = plan.join(named, f"{kind}_ord").select("global_idx", "path", F.col(f"u_{kind}").alias("u"))
    return visiting.segments(drawn, "", c.target_sr, c.segment_samples).select("global_idx", F.col("path").alias(f"{kind}_file"), F.col("x").alias(kind), F.col("error").alias(f"{kind}_error"))


def build(spark: SparkSession, c: BuildConfig, workers: int = 8, rir: str = "auto") -> dict:
    """Write the audio files and metadata.json; returns the number of samples in each split.

    rir: "file" takes room responses from files only, "synthetic" simulates them, "auto" takes files if there are two or more.
    Rows made and rows in error are counted as they are written, and logged.
    """
    if c.output_format != "wav":
        raise ValueError("only WAV can be written here")
    if c.output_subtype not in SUBTYPES:
        raise ValueError(f"{c.output_subtype!r}: only {' and '.join(SUBTYPES)} can be written here")
    speech, noise = discover(spark, c.speech_dir), discover(spark, c.noise_dir)
    n_speech, n_noise = speech.count(), noise.count()
    if not n_speech or not n_noise:
        raise FileNotFoundError(f"no audio files in {c.noise_dir if n_speech else c.speech_dir!r}")
    rirs = discover(spark, c.rir_dir).where("ext = '.wav'")
    n_rir = rirs.count() if c.rir_dir else 0
    if rir == "file" and n_rir < 2:
        raise FileNotFoundError(f"no two room responses in {c.rir_dir!r}")
    n_rir = 0 if rir == "synthetic" else n_rir
    plan = dataset.split(dataset.draws(spark, c.total_samples, n_speech, n_noise, c, n_rir if n_rir >= 2 else 0), c)
    plan = written(plan, "draws")
    pairs = plan.join(cut(plan, speech, "speech", c), "global_idx").join(cut(plan, noise, "noise", c), "global_idx").repartition(workers, "global_idx")
    if n_rir >= 2:
        r = written(loaded(spark, numbered(rirs.withColumnRenamed("ord", "at"), F.floor(F.col("at") / dataset.BUCKET), ["at"], "ord"), c.rir_dir, c.target_sr), "responses")  # near and far read the same
        for which in ("near", "far"):
            pairs = pairs.join(r.select(F.col("ord").cast("long").alias(f"rir_{which}_ord"), F.col("x").alias(which), F.col("error").alias(f"{which}_error")), f"rir_{which}_ord")
        pairs = pairs.withColumn("room_error", F.coalesce("near_error", "far_error")).drop("near_error", "far_error")
    else:
        pairs = responses(pairs, c)
    progress, out = Observation("build"), located(c.output_dir)
    made = mixed_long(pairs, c).observe(progress, F.count("*").alias("made"), F.count("error").alias("failed"))
    table = f"{out}/samples"
    made.write.mode("overwrite").parquet(table)
    log.info("made %(made)d samples, of which %(failed)d failed", progress.get)
    audio = spark.read.parquet(table).where("error is null")
    places = written(dataset.local_index(audio.select("global_idx", "split")).select("global_idx", "local_idx"), "places")  # numbers alone are shuffled and sorted
    good = audio.drop("local_idx").join(places, "global_idx")
    spark.dataSource.register(WavSource)
    for kind in ("noisy", "clean"):
        files = good.select(dataset.output_path(kind).alias("path"), F.lit(c.target_sr).alias("sr"), F.col(kind).alias("samples"))
        files.write.format("wav").mode("append").option("subtype", c.output_subtype).save(out)
    rows = dataset.manifest(good.drop("noisy", "clean"), "file" if n_rir >= 2 else "synthetic")
    rows.write.mode("overwrite").parquet(f"{out}/manifest")
    rows = spark.read.parquet(f"{out}/manifest")
    counts = {r.split: r["count"] for r in dataset.split_counts(rows).collect()}
    store, top = file_system(out)
    with io.TextIOWrapper(store.open_output_stream(f"{top}/metadata.json"), "utf-8") as f:
        f.write(f'{{"config": {json.dumps(c.as_dict(), default=str)}, "splits": {{')
        for i, split in enumerate(("train", "val", "test")):
            f.write(f'{", " * (i > 0)}"{split}": {{"count": {counts[split]}, "samples": [')
            for j, r in enumerate(rows.where(F.col("split") == split).drop("split").orderBy("index").toLocalIterator()):  # one partition at a time
                f.write("," * (j > 0) + "\n" + json.dumps(r.asDict()))
            f.write("]}")
        f.write("}}\n")
    log.info("wrote %s", counts)
    return counts


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("speech-dir", "noise-dir", "rir-dir", "output-dir", "output-format", "output-subtype"):
        p.add_argument(f"--{name}")
    for name in ("total-samples", "target-sr", "seed"):
        p.add_argument(f"--{name}", type=int)
    for name in ("segment-duration", "snr-min", "snr-max", "train-ratio", "val-ratio", "test-ratio", "peak-norm-target"):
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--rir", choices=("auto", "file", "synthetic"), default="auto")
    given = vars(p.parse_args(argv))
    rir = given.pop("rir")
    c = BuildConfig(**{k: v for k, v in given.items() if v is not None})
    print(build(SparkSession.builder.appName("pairwave-build").getOrCreate(), c, rir=rir))


if __name__ == "__main__":
    main()
