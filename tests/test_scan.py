"""Running values over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pairwave.operators.scan import latest, parity, ranged, scanned, total


@pytest.mark.parametrize("backward", [False, True])
def test_scans_against_plain_code(spark, backward):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.choice([None, 1, 2, 3])) for i in range(800)]
    d = ranged(spark.createDataFrame(rows, "s long, i long, v long").repartition(5), ["s"], ["i"])
    folds = {"a": total(F.col("v")), "b": total(F.col("v"), -1), "c": parity(F.col("v")), "d": latest(F.col("v")), "e": latest(F.col("v"), -1)}
    got = {r.i: (r.a, r.b, r.c, r.d, r.e) for r in scanned(d, ["s"], ["i"], folds, backward).collect()}
    assert d.select("__range").distinct().count() == 4 and d.where("s = 1").select("__range").distinct().count() > 1
    state = {}
    for s, i, v in reversed(rows) if backward else rows:
        a, c, e = state.get(s, (0, 0, None))
        new = (a + (v or 0), c ^ (v or 0), e if v is None else v)
        assert got[i] == (new[0], a, new[1], new[2], e)
        state[s] = new


def test_scan_of_no_rows(spark):
    d = ranged(spark.createDataFrame([], "s long, i long, v long"), ["s"], ["i"])
    assert scanned(d, ["s"], ["i"], {"a": total(F.col("v"))}).count() == 0
