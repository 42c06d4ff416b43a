"""Running values along an order, of streams of any length: a two-level prefix scan.

Rows are dealt into ranges of (stream, order) and written with the number of their range. Each range of a stream gives a summary; an
exclusive scan over the summaries, of which a stream has one a range, gives what a range begins with; and windows inside
the ranges do the rest. No task has more of a stream than a range of it, and only one stream can enter a range from the one before, so what
is broadcast has at most a row a range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwave.sources.shared import written

RANGE = "__range"


@dataclass(frozen=True)
class Fold:
    """An associative aggregate: of rows in a window, of a whole range, of the summaries before, and of both together."""

    value: Column
    over_rows: Callable[[Column], Column]
    of_range: Callable[[Column, Column, Callable], Column]
    both: Callable[[Column, Column], Column]
    #: 0: the row itself included; -1: what stands before it.
    upto: int = 0


def total(value: Column, upto: int = 0) -> Fold:
    """The sum so far; 0 before the first."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return Fold(value, F.sum, lambda v, order, last_by: F.sum(v), lambda a, b: zero(a) + zero(b), upto)


def parity(value: Column, upto: int = 0) -> Fold:
    """The exclusive or of longs so far; 0 before the first."""
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return Fold(value, F.bit_xor, lambda v, order, last_by: F.bit_xor(v), lambda a, b: zero(a).bitwiseXOR(zero(b)), upto)


def latest(value: Column, upto: int = 0) -> Fold:
    """The last value that isn't null; null before the first."""
    return Fold(value, lambda v: F.last(v, ignorenulls=True), lambda v, order, last_by: last_by(v, F.when(v.isNotNull(), order)), lambda a, b: F.coalesce(b, a), upto)


def ranged(rows: DataFrame, per: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """rows as a table in ranges of (per, order), which should tell rows apart: those that it doesn't share a range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, or small ranges would be put together
    return written(rows.repartitionByRange(n, *per, *order).withColumn(RANGE, F.spark_partition_id()), name)


def scanned(rows: DataFrame, per: list[str], order: list[str], folds: dict[str, Fold], backward: bool = False) -> DataFrame:
    """rows (as ranged() gives them) with a column for each fold, along the order or, backward, against it. Nulls come first."""
    turned = (lambda names: [F.col(c).desc() for c in names]) if backward else (lambda names: [F.col(c).asc() for c in names])
    inside = Window.partitionBy(RANGE, *per).orderBy(*turned(order))
    key, last_by = F.struct(*order), F.min_by if backward else F.max_by
    summaries = rows.groupBy(RANGE, *per).agg(*(f.of_range(f.value, key, last_by).alias(n) for n, f in folds.items()))
    along = Window.partitionBy(*per).orderBy(*turned([RANGE]))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(RANGE, *per, F.lag(F.lit(1)).over(along).alias("__later"), *(f.over_rows(F.col(n)).over(earlier).alias(n) for n, f in folds.items()))
    start = carried.where("__later = 1").select(F.col(RANGE).alias("__at"), *(F.col(c).alias(f"__per_{c}") for c in per), *(F.col(n).alias(f"__carry_{n}") for n in folds))
    own = rows.withColumns({n: f.over_rows(f.value).over(inside.rowsBetween(Window.unboundedPreceding, f.upto)) for n, f in folds.items()})
    same = F.col(RANGE) == F.col("__at")
    for c in per:
        same &= F.col(c).eqNullSafe(F.col(f"__per_{c}"))
    out = own.join(F.broadcast(start), same, "left")
    return out.withColumns({n: f.both(F.col(f"__carry_{n}"), F.col(n)) for n, f in folds.items()}).drop("__at", *(f"__per_{c}" for c in per), *(f"__carry_{n}" for n in folds))
