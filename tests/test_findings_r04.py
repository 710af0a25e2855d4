"""What the fourth round of findings showed, in small."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import blocks, kinematics, proximity
from tracewright.plans import accuracy


def _points(spark, n):
    g = np.random.default_rng(4)
    return spark.createDataFrame([(i, g.uniform(0, 9, 3).round(2).tolist()) for i in range(n)], "id long, vec array<double>").coalesce(1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("subset, limit", [("all", None), ("minimum", 4.0)])
def test_pairs_of_points_from_one_partition_go_to_all_tasks_without_functions_on_arrays(spark, subset, limit):
    points = _points(spark, 300)
    asked = points.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    out = proximity.pairs_of_points(asked, points, subset, limit, 6)
    assert "zip_with" not in _plan(out) and "round(" not in _plan(out)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    v = {r.id: r.vec for r in points.collect()}
    far = {(a, b): math.dist(v[a], v[b]) for a in v for b in v if a % 50 == 0 and a != b}
    got = {(r.query_id, r.id): r.distance for r in out.collect()}
    assert got == {k: pytest.approx(d, abs=6e-7) for k, d in far.items() if limit is None or round(d, 6) >= limit}


def test_pairs_of_points_of_several_lengths(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0])], "id long, vec array<double>")
    out = proximity.pairs_of_points(points.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), points, "minimum", 1.0, 6)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 5.0), (2, 1, 5.0)]


def test_points_within_a_limit_are_met_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(proximity, "SLICE_ROWS", 16)
    monkeypatch.setattr(proximity, "PAIRS_AT_ONCE", 40)
    points = _points(spark, 400)
    asked = points.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    out = proximity.pairs_of_points(asked, points, "maximum", 2.5, 6)
    assert "Join" not in _plan(out)
    v = {r.id: r.vec for r in points.collect()}
    far = {(a, b): math.dist(v[a], v[b]) for a in v for b in v if a % 20 == 0 and a != b}
    got = {(r.query_id, r.id): r.distance for r in out.collect()}
    assert got == {k: pytest.approx(d, abs=6e-7) for k, d in far.items() if round(d, 6) <= 2.5}
    assert proximity.pairs_of_points(asked, points.where("id < 0"), "maximum", 2.5, 6).count() == proximity.pairs_of_points(asked.where("query_id < 0"), points, "maximum", 2.5, 6).count() == 0


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
@pytest.mark.parametrize("k, slack", [(1, 1e-9), (5, 0.0), (7, 1e-3)])
def test_vectors_of_few_components_meet_near_tiles_only(monkeypatch, measure, k, slack):
    g = np.random.default_rng(5)
    r = np.hstack([g.uniform(0, 90, (6000, 2)).round(1), np.ones((6000, 1))])
    q, ids, own, theirs = r[::10], np.arange(6000), np.arange(6000)[::10] % 9, np.arange(6000) % 9
    seen, kernel = [0], blocks.measured

    def counted(a, b, qn, rn, m):
        out = kernel(a, b, qn, rn, m)
        seen[0] += out.size
        return out

    monkeypatch.setattr(blocks, "measured", counted)
    i, j, far = blocks._few(q, r, lambda i, j: own[i] == theirs[j], k, ids, measure, slack)
    assert seen[0] < len(q) * len(r) / 2 and blocks._few_by_tiles
    whole = kernel(q[:, None], r[None], blocks._norms(q)[:, None], blocks._norms(r)[None], measure)
    near = (lambda d: round(d / slack)) if slack else (lambda d: d)
    for a in range(len(q)):
        want = sorted((near(whole[a, b]), b) for b in range(len(r)) if own[a] != theirs[b])[:k]
        assert sorted((near(d), b) for d, b in zip(far[i == a], j[i == a].tolist()))[:k] == want


def test_series_of_rates_are_integrated_a_few_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(k, float(t), [0.1 * (k + 1) * t, 0.0, 0.2]) for k in range(7) for t in range(2 + 3 * k)], "k long, at double, rate array<double>").coalesce(1)
    rows = rows.repartition(1)
    want = sorted((r.k, r["at"], r.orientation) for r in kinematics.integrated_by_spline(rows, ["k"], "at", "rate").collect())
    monkeypatch.setattr(kinematics, "POINTS_AT_ONCE", 20)
    made = kinematics.integrated_by_spline(rows, ["k"], "at", "rate")
    got = sorted((r.k, r["at"], r.orientation) for r in made.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == sum(2 + 3 * k for k in range(7))
    assert all(g[2] == pytest.approx(w[2], abs=1e-9) for g, w in zip(got, want))
    assert "MapInArrow" in _plan(made)  # flat arrays in bounded pieces; a Python object a point was the memory


def test_all_distances_shuffle_rows_once(spark, monkeypatch):
    g = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, g.normal(size=5).tolist()) for i in range(90)] + [(90, None), (91, [1.0])], "id long, vec array<double>")
    asked = rows.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    shared = blocks.all_distances(asked, rows, list(blocks.MEASURES))
    assert "CoGroup" not in _plan(shared)
    monkeypatch.setattr(blocks, "MOST_SHARED_BYTES", 100)
    dealt = blocks.all_distances(asked, rows, list(blocks.MEASURES))
    assert "CoGroup" in _plan(dealt)
    got, want = (sorted(map(tuple, d.collect())) for d in (shared, dealt))
    assert got == want and len(got) == 10 * 90


def test_figures_of_all_metrics_are_made_in_one_pass_over_the_points(spark):
    g = np.random.default_rng(7)
    sides = []
    for side in range(2):
        rows = [(k, "ab"[i // 5 % 2], i, g.uniform(0, 9, 3).tolist()) for k in range(5) for i in range(8 + 3 * k + side)]
        rows += [(7, "a", 0, [1.0, 2.0, 3.0]), (9, "a" if side else "b", 0, [1.0, 1.0, 1.0])] + ([(8, "a", 0, [1.0, 1.0, float("nan")])] if side else [(8, "a", 0, [0.0, 0.0, 0.0]), (6, "a", 0, [0.0, 0.0, 0.0])])
        sides.append(spark.createDataFrame(rows, "traj_id long, seg_id string, ord long, v array<double>"))
    results = accuracy.evaluate(*sides)
    results["dtw_by_segment"] = accuracy.evaluate(*sides, ("dtw",), "segment")["dtw"]
    made = accuracy.whole_summaries(*sides, by_segment=("dtw",))
    assert _plan(made).count("CoGroup") == 1
    got = {(r.metric, r.traj_id): r for r in made.collect()}
    want = {(r.metric, r.traj_id): r for r in accuracy.all_metrics(results).collect()}
    assert set(got) == set(want) and len(want) > 30
    for key, row in want.items():
        assert [got[key][c] for c in accuracy.FIGURES] == pytest.approx([row[c] for c in accuracy.FIGURES], abs=1e-9), key
