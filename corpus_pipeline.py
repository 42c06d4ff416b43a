"""A training corpus from raw documents, in five stages. Each takes (spark, docs, sf_dir), with docs what its predecessor
kept, and returns a DataFrame that is written as Parquet and read again for the next one.

1. Quality rules: documents that fail the base rules or the likelihood-ratio threshold go.
2. SimHash near-dedup: of each group of linked fingerprints the document with the smallest id stays.
3. Benchmark decontamination: documents that hold a benchmark item go.
4. Secret scans: secrets in texts are replaced by their kind in brackets; no document goes.
5. SentencePiece: texts become piece ids, which must decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.llm import decontam, quality, registry, secrets, sentencepiece, simhash
from pairwave.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, quality.untoxic(read(spark, sf_dir, "labels")), tuple(COLUMNS[1:])).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scanned(docs, tuple(COLUMNS[1:]))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("found")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece.encoded(docs, registry.tokenizer("piece_bpe_32k.model"), ("lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids_crc32", "round_trip", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("piece_ids", piece_ids),
]

#: Neither hashed likelihood ratios, SimHash nor a trained tokenizer can be told in SQL: tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
