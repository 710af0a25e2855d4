"""Series dealt to ranges against whole windows: hot series, short ranges, null keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import dealt, kinematics, series


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    keys = ["hot"] * 300 + ["b"] * 7 + [None] * 20 + ["z"] * 2
    table = [(k, int(t), float(v), (x / np.linalg.norm(x)).tolist()) for k, t, v, x in zip(keys, rng.permutation(len(keys)), rng.normal(size=len(keys)), rng.normal(size=(len(keys), 4)))]
    return spark.createDataFrame(table, "k string, t int, v double, q array<double>").repartition(3)


def made(w):
    return {"median": series.moving_median("v", w, 6), "low": F.min("v").over(w.rowsBetween(-5, 2)), "before": F.lag("v", 3).over(w)}


@pytest.mark.parametrize("partitions,keys", [("4", ["k"]), ("90", ["k"]), ("4", []), ("1", ["k"])])
def test_framed_windows_and_runs_equal_whole_ones(spark, rows, partitions, keys):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # with 90, ranges are shorter than the frames
    try:
        w = series.along(keys, ["t"])
        want = rows.select("*", *[c.alias(n) for n, c in made(w).items()])
        got = dealt.framed(rows, keys, ["t"], 5, 2, made)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        flag = F.col("v") > -0.3
        assert sorted(map(str, dealt.islands(rows, flag, keys, ["t"]).collect())) == sorted(map(str, series.islands(rows, flag, keys, ["t"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cumulative_products_over_many_ranges(spark, rows):
    want = {(r.k, r.t): r["product"] for r in kinematics.cumulative_product(rows, ["k"], "t", "q").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r.k, r.t): r["product"] for r in dealt.cumulative_product(rows, ["k"], ["t"], "q").collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
        assert dealt.cumulative_product(rows.limit(0), ["k"], ["t"], "q").count() == dealt.framed(rows.limit(0), ["k"], ["t"], 2, 2, made).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
