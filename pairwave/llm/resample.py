"""Target-distribution importance resampling: hashed n-gram gains between a target and the raw corpus, and a weighted draw.

A document's features are its runs of 1 to ``longest`` words. One pass over the texts turns them into bucket numbers: a task keeps a
dictionary of the distinct feature strings that it has met and hashes each once. Bucket counts are summed over all documents,
as over the target's texts; a bucket's gain is a floored log-ratio of both; and the gains, a table of ``buckets`` rows whatever the
corpus holds, are joined back to each document's features. The draw adds Gumbel noise, of a hash of doc_id, to the sum of gains and takes
the largest: ranks come from ranges of the score, written once, so nothing is sorted in one task.

``global_dictionary`` and ``weights_by_dictionary`` are the same over one dictionary of all distinct strings, by shuffles: see README.

Null and empty texts have no features and weight 0. Repeated rows stay and are ranked side by side; a null doc_id draws like an
empty one and stands last among ties. Other columns are ignored. Without documents there are no rows; without a target, T = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import written
from pairwave.llm.quality import let
from pairwave.operators.scan import ranged, scanned, total

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT = 20, 5
#: Distinct features that a task keeps at a time; words whose features are worked on at once; features to a batch of rows.
KEPT, PIECE, BATCH = 1 << 19, 1 << 16, 1 << 20
#: Not part of a word; upper case is lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Dictionary(dict):
    """Bucket of each distinct feature, hashed when it is first met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = self[feature] = crc32(feature) % self.buckets
        return bucket

    def of(self, text: str | None, longest: int) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        words = (text or "").encode().translate(PLAIN).split()
        found = []
        for at in range(0, len(words), PIECE):
            if len(self) > KEPT:
                self.clear()
            part = words[at : at + PIECE + longest - 1]
            runs = [zip(*(part[i : min(PIECE + i, len(part))] for i in range(n)), strict=False) for n in range(2, longest + 1)]
            found.append(np.fromiter(map(self.__getitem__, chain(part[:PIECE], *(map(b" ".join, r) for r in runs))), np.int32))
        return len(words), np.concatenate(found) if found else np.array([], np.int32)


def features(texts: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Columns in keep, n_words, buckets (of each feature), for each row of texts (text, ...)."""
    rows = texts.select(*keep, F.col("text").alias("__text"))
    schema = rows.drop("__text").withColumns({"n_words": F.lit(0).cast("long"), "buckets": F.array(F.lit(0))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(buckets)

        def packed(part: pa.RecordBatch, got: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(b) for _, b in got)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([b for _, b in got])))
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for n, _ in got], pa.int64()), lists], names=[*part.schema.names[:-1], "n_words", "buckets"])

        for batch in batches:
            got, at, n = [], 0, 0
            for i in range(batch.num_rows):
                got.append(known.of(batch.column(batch.num_columns - 1)[i].as_py(), longest))
                n += len(got[-1][1])
                if n >= BATCH or i == batch.num_rows - 1:
                    yield packed(batch.slice(at, i + 1 - at), got)
                    got, at, n = [], i + 1, 0

    return rows.mapInArrow(run, schema)


def counts(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how often each bucket stands in rows (buckets)."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gain(s: Column, all_s: Column, t: Column, all_t: Column, buckets: int) -> Column:
    d = lambda x: x.cast("double")
    return F.floor(1000 * F.log(d(t + 1) * d(all_s + buckets) / (d(s + 1) * d(all_t + buckets))))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, gains: of every bucket, in their order, from the counts (bucket, s) and (bucket, t)."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(raw, "bucket", "left").join(target, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("rows"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # a row a bucket
    return one.select(F.transform("rows", lambda x: gain(x["s"], F.col("all_s"), x["t"], F.col("all_t"), buckets)).alias("gains"))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise of a document, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weighed (doc_id, n_words, score, ...) with rank: 1, 2, ... for the best so many of the documents that are long enough, by score
    and then doc_id; null for the rest."""
    fit = F.col("n_words") >= min_words
    order = {"__down": -F.col("score"), "__none": F.col("doc_id").isNull()}
    able = ranged(weighed.where(fit).withColumns(order), [], ["__down", "__none", "doc_id"], "by-score")
    placed = scanned(able, [], ["__down", "__none", "doc_id"], {"__place": total(F.lit(1))})
    most = able.agg(F.floor(percent * F.count("*") / 100)).scalar()
    rank = F.when(F.col("__place") <= most, F.col("__place")).cast("long")
    return placed.select(*weighed.columns, rank.alias("rank")).unionByName(weighed.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words for every row of docs (doc_id, text); target has text."""
    rows = written(features(docs, ("doc_id",), buckets, longest), "features")
    table = written(gains(counts(rows, "s"), counts(features(target, (), buckets, longest), "t"), buckets), "gains")
    joined = rows.withColumn("gains", table.scalar())
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get("gains", b))
    weighed = joined.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    return drawn(written(weighed, "weights"), percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def strings(text: Column, longest: int = LONGEST) -> Column:
    """array<string> of a text's features."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        run = lambda n: F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda _, i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.concat(w, *(run(n) for n in range(2, longest + 1)))

    return let(words, of)


def global_dictionary(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(feature, n, bucket): every distinct string of the corpus, counted and hashed once."""
    every = docs.select(F.explode(strings(F.col("text"), longest)).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return every.withColumn("bucket", F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets)).cast("int"))


def weights_by_dictionary(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, weight) through one dictionary: a document's counts of distinct strings are joined to it. doc_id must be unique."""
    known = written(global_dictionary(docs, buckets, longest), "dictionary")
    of = lambda d, n: d.groupBy("bucket").agg(F.sum("n").alias(n))
    table = gains(of(known, "s"), of(global_dictionary(target, buckets, longest), "t"), buckets)
    gained = known.select("feature", F.get(table.scalar(), F.col("bucket")).alias("gain"))
    each = docs.select("doc_id", F.explode(strings(F.col("text"), longest)).alias("feature")).groupBy("doc_id", "feature").agg(F.count("*").alias("n"))
    weights = each.join(gained, "feature").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    return docs.select("doc_id").join(weights, "doc_id", "left").select("doc_id", F.coalesce("weight", F.lit(0)).alias("weight"))
