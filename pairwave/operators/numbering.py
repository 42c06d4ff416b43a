"""Dense numbers over a whole table without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str, per: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``: 0, 1, ... in the given order, within each value of ``per``.

    ``bucket`` must not decrease along the order. Rows are numbered within their bucket, and begin at the count of
    the buckets before; those counts are a row a bucket, whatever the table's size.
    """
    b = df.withColumn("__bucket", bucket.cast("long"))
    sizes = b.groupBy(*per, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*per).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*per, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*per, "__bucket").orderBy(*order))
    return b.withColumn("__own", own).join(starts, [*per, "__bucket"]).withColumn(name, (F.col("__start") + F.col("__own") - 1).cast("long")).drop("__bucket", "__own", "__start")
