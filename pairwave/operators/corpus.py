"""Source corpora: which files are audio, and in what order."""

from __future__ import annotations

from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.operators.numbering import numbered
from pairwave.sources.listing import ListingSource
from pairwave.sources.shared import file_system, located, written

#: What counts as an audio file.
EXTENSIONS = (".aif", ".aiff", ".flac", ".mp3", ".ogg", ".wav")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]+)$", 1))


def audio_files(files: DataFrame) -> DataFrame:
    """Rows of (path, ...) with an audio extension in either case, and the extension."""
    return files.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*EXTENSIONS))


def ordered(files: DataFrame) -> DataFrame:
    """With ord, the place among all paths compared part by part. Ranges of paths, written as a table, are numbered each by itself."""
    ranges = files.withColumn("parts", F.split("path", "/")).repartitionByRange("parts").withColumn("range", F.spark_partition_id())
    return numbered(written(ranges, "ranges"), F.col("range"), ["parts"], "ord").drop("parts", "range")


def discover(spark: SparkSession, root: str, splits: int = 1) -> DataFrame:
    """(ord, path, ext, length) of the audio files below a folder or URI; none if it isn't there. Tasks list the files, so many for each subfolder."""
    store, top = file_system(root) if root else (None, "")
    if store is None or store.get_file_info(top).type != FileType.Directory:
        return spark.createDataFrame([], "ord long, path string, ext string, length long")
    spark.dataSource.register(ListingSource)
    found = spark.read.format("file_listing").option("splits", splits).load(located(root))
    placed = ordered(audio_files(found.select(F.col("name").alias("path"), "length")))
    return placed.select("ord", F.concat(F.lit(located(root) + "/"), "path").alias("path"), "ext", "length")
