"""Paired-signal datasets: draws, pairing, mixing, splits and manifest.

Draws are cheap scalars and come first; signals are joined afterwards, by position in their pool, and are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.config import BuildConfig
from pairwave.functions import signal
from pairwave.functions.rng import between, pick, uniform
from pairwave.operators.numbering import numbered
from pairwave.operators.scan import ranged, scanned, total

#: Rows to a bucket of a dense numbering.
BUCKET = 1 << 16


def draws(spark: SparkSession, total: int, n_speech: int, n_noise: int, c: BuildConfig, n_rir: int = 0) -> DataFrame:
    """global_idx and everything that is drawn for it but the room."""
    u = lambda slot: uniform(c.seed, F.col("global_idx"), slot)
    out = spark.range(total).select(F.col("id").alias("global_idx")).select(
        "global_idx",
        pick(u("speech"), n_speech).alias("speech_ord"),
        pick(u("noise"), n_noise).alias("noise_ord"),
        u("soff").alias("u_speech"),
        u("noff").alias("u_noise"),
        between(u("snr"), c.snr_min, c.snr_max).alias("snr_db"),
        u("split").alias("u_split"),
    )
    if n_rir:
        out = out.withColumns({"rir_near_ord": pick(u("rir_near"), n_rir), "rir_far_ord": pick(u("rir_far"), n_rir)})
    return out


def split(rows: DataFrame, c: BuildConfig) -> DataFrame:
    """rows (global_idx, u_split) with split: exactly as many of each as the ratios say, by rank of a uniform draw.

    Draws are spread evenly, so equal ranges of them make equal buckets.
    """
    size, buckets = c.sizes(), max(8, c.total_samples // BUCKET)
    ranked = numbered(rows, F.floor(F.col("u_split") * buckets), ["u_split", "global_idx"], "__rank")
    name = F.when(F.col("__rank") < size["train"], "train").when(F.col("__rank") < size["train"] + size["val"], "val").otherwise("test")
    return ranked.withColumn("split", name).drop("__rank")


def source_splits(files: DataFrame, c: BuildConfig) -> DataFrame:
    """files (pool, name, weight, u) with split, so that no file is in two: the files of a pool stand in the order of the uniform draw u, and
    each belongs to the split in which the middle of its weight falls. A split's weight is off by half a file at each end at most."""
    order = ["u", "name"]
    placed = scanned(ranged(files, ["pool"], order, "files"), ["pool"], order, {"__upto": total(F.col("weight"))})
    sums = F.broadcast(files.groupBy("pool").agg(F.sum("weight").alias("__all")))  # a row a pool
    share = (F.col("__upto") - F.col("weight") / 2) / F.col("__all")
    name = F.when(share < c.train_ratio, "train").when(share < c.train_ratio + c.val_ratio, "val").otherwise("test")
    return placed.join(sums, "pool").select(*files.columns, name.alias("split"))


def drawn_within(rows: DataFrame, files: DataFrame, c: BuildConfig, kinds: tuple[str, ...] = ("speech", "noise")) -> DataFrame:
    """rows (global_idx, split) with a file of each kind out of the row's own split: speech_file, noise_file; null where a split has none.
    files: (pool, name, split), with the kinds as pools."""
    at = numbered(files.withColumn("__u", uniform(c.seed, F.col("name"), "pool")), F.floor(F.col("__u") * BUCKET), ["__u", "name"], "ord", ("pool", "split")).select("pool", "split", "ord", "name")
    sizes = files.groupBy("pool", "split").agg(F.count("*").alias("n"))  # a row a pool and split
    for kind in kinds:
        n = F.broadcast(sizes.where(F.col("pool") == kind).select("split", F.col("n").alias(f"__{kind}_n")))
        mine = at.where(F.col("pool") == kind).select("split", F.col("ord").alias("__ord"), F.col("name").alias(f"{kind}_file"))
        rows = rows.join(n, "split", "left").withColumn("__ord", pick(uniform(c.seed, F.col("global_idx"), kind), F.col(f"__{kind}_n"))).drop(f"__{kind}_n")
        rows = rows.join(mine, ["split", "__ord"], "left").drop("__ord")
    return rows


def local_index(rows: DataFrame) -> DataFrame:
    """rows (global_idx, split) with local_idx, dense in each split."""
    return numbered(rows, F.floor(F.col("global_idx") / BUCKET), ["global_idx"], "local_idx", ("split",))


def output_path(kind: str, fmt: str = "wav") -> Column:
    """split/kind/000123.wav; more digits where six aren't enough."""
    i = F.col("local_idx").cast("string")
    return F.concat(F.col("split"), F.lit(f"/{kind}/"), F.when(F.col("local_idx") < 1_000_000, F.lpad(i, 6, "0")).otherwise(i), F.lit(f".{fmt}"))


def paired(plan: DataFrame, speech: DataFrame, noise: DataFrame) -> DataFrame:
    """plan with speech and noise: their signals and names, by position. Pools are (ord, name, x), or also with error."""

    def named(pool: DataFrame, kind: str) -> DataFrame:
        error = [F.col("error").alias(f"{kind}_error")] if "error" in pool.columns else []
        return pool.select(F.col("ord").alias(f"{kind}_ord"), F.col("name").alias(f"{kind}_file"), F.col("x").alias(kind), *error)

    return plan.join(named(speech, "speech"), "speech_ord").join(named(noise, "noise"), "noise_ord")


def mixed(pairs: DataFrame, length: int, near: Column, far: Column, target: float) -> DataFrame:
    """pairs with noisy and clean, by array functions: for short signals and responses. A NaN anywhere marks the row in error."""
    a = pairs.withColumns({"__s": signal.segment(F.col("speech"), length, F.col("u_speech")), "__n": signal.segment(F.col("noise"), length, F.col("u_noise"))})
    b = a.withColumns({"__s": signal.convolved(F.col("__s"), near), "__n": signal.convolved(F.col("__n"), far)})
    m = b.withColumn("noisy", signal.mixed(F.col("__s"), F.col("__n"), signal.snr_gain(F.col("__s"), F.col("__n"), F.col("snr_db"))))
    g = m.withColumn("gain", signal.normal_gain(signal.peak(F.col("noisy")), target))
    out = g.withColumns({"noisy": signal.scaled(F.col("noisy"), F.col("gain")), "clean": signal.scaled(F.col("__s"), F.col("gain"))})
    return out.withColumn("error", F.when(F.exists("noisy", F.isnan), F.lit("NaN"))).drop("__s", "__n", "speech", "noise")


def manifest(rows: DataFrame, rir_type: str, fmt: str = "wav") -> DataFrame:
    return rows.select(
        F.col("global_idx").alias("index"), "split", "speech_file", "noise_file", (F.round("snr_db", 2) + F.lit(0.0)).alias("snr_db"), F.lit(rir_type).alias("rir_type"), output_path("noisy", fmt).alias("noisy_file"), output_path("clean", fmt).alias("clean_file")
    )


def split_counts(rows: DataFrame) -> DataFrame:
    """(split, count) of all three splits, none left out."""
    every = rows.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return F.broadcast(every).join(rows.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
