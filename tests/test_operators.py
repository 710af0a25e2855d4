"""Sources, sinks, joins and plans on small fixtures."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewright.functions import kernels, quaternions, stats, vectors
from tracewright.operators import alignment, joins, kinematics, prediction, ranking, series, summary
from tracewright.plans import accuracy, queries
from tracewright.sources import tables
from tracewright.streaming import summaries


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("width", [40, 43, 47])
def test_recordings_by_header_width(spark, tmp_path, width):
    path = tmp_path / "r.csv"
    path.write_text(",".join(f"c{i}" for i in range(width)) + "\n" + ",".join(map(str, range(width))) + "\n")
    df = tables.recording_csv(spark, str(path))
    assert len(df.columns) == width == len(set(df.columns)) and df.first()[width - 1] == width - 1.0
    assert ("ap_x" in df.columns) == (width > 40) and ("aq_w" in df.columns) == (width == 47)
    with pytest.raises(ValueError):
        tables.recording_columns(41)


def test_result_csvs_and_appending(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"run_2024010{i}_120000.csv").write_text("a,b\n1,2\n")
    df, missing = tables.result_csvs(spark, str(tmp_path / "run_*.csv"), ["a", "c"])
    assert missing == ["c"] and {r.run_stamp for r in df.collect()} == {"20240101_120000", "20240102_120000"}
    old = df.where("run_stamp = '20240101_120000'")
    assert joins.append_new(old, df, "run_stamp").count() == 2


def test_replacing_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "traj_id long, x double")
    tables.write_replacing(frame([(1, 1.0), (2, 2.0)]), path, "traj_id")
    tables.write_replacing(frame([(2, 3.0)]), path, "traj_id")
    assert sorted((r.traj_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0)]


def test_asof_directions_ties_and_missing(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, "a", 9)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, rt int, v string")
    get = lambda **o: {r.id: r.v for r in joins.asof(left, right, "at", "rt", ["k"], right_columns=["v"], **o).collect()}
    assert get() == {1: "y", 2: None, 3: None, 4: "y"}
    assert get(strict=True) == {1: "x", 2: None, 3: None, 4: "y"}
    assert get(direction="forward") == {1: "y", 2: "x", 3: None, 4: None}
    assert get(direction="forward", strict=True) == {1: None, 2: "x", 3: None, 4: None}
    near = {r.id: r.v for r in joins.nearest(left, right, "at", "rt", ["k"], ["v"]).collect()}
    assert near == {1: "y", 2: "x", 3: None, 4: "y"}
    tie = spark.createDataFrame([(1, "a", 3)], "id int, k string, at int")
    right2 = spark.createDataFrame([("a", 1, "early"), ("a", 5, "late")], "k string, rt int, v string")
    assert joins.nearest(tie, right2, "at", "rt", ["k"], ["v"]).first().v == "early"


def test_pending_keeps_rows_when_done_holds_null(spark):
    work, done = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.id for r in joins.pending(work, done, "id").collect()] == [2]


def test_summary_of_one_value_and_whole_row(spark):
    rows = spark.createDataFrame([(7, "7_1", 2.0), (7, "7_2", 4.0), (7, "7_2", None)], "traj_id long, seg_id string, d double")
    got = {r.seg_id: r for r in summary.info(rows, "d").collect()}
    assert got["7_1"].standard_deviation == 0.0 and got["7"].average_distance == 3.0 and len(got) == 3


def test_alignment_isolates_errors(spark):
    points = lambda rows: spark.createDataFrame([(t, "s", o, v) for t, o, v in rows], "traj_id long, seg_id string, ord long, v array<double>")
    a = points([(1, 1, [0.0, 0.0, 0.0]), (1, 2, [1.0, 0.0, 0.0]), (2, 1, [0.0, 0.0, 0.0])])
    b = points([(1, 1, [0.0, 1.0, 0.0]), (1, 2, [1.0, 1.0, 0.0])])
    for metric in alignment.METRICS[:5]:
        rows = alignment.align(a, b, metric).collect()
        assert {r.status for r in rows if r.traj_id == 1} == {"ok"} and all(r.distance == pytest.approx(1) for r in rows if r.traj_id == 1)
        assert [r.status for r in rows if r.traj_id == 2] == ["one side has no points"]
        assert [(r.traj_id, r.status) for r in alignment.failed(alignment.align(a, b, metric)).collect()] == [(2, "one side has no points")]
    holes = points([(1, 1, [0.0, math.nan, 0.0]), (3, 1, [0.0, 0.0, 0.0])])
    assert {r.status for r in alignment.align(holes, b, "dtw").collect()} == {"points that are not finite", "one side has no points"}
    assert alignment.align(points([(1, 1, [0.0] * 4)]), points([(1, 1, [1.0, 0.0, 0.0, 0.0])]), "qad", 4).first().status == "an orientation of length zero"
    assert accuracy.evaluate(a, b, ("dtw",), done=spark.createDataFrame([(1,)], "traj_id long"))["dtw"][0].count() == 0


def test_staged_rerank_keeps_pruned_rows_in_first_stage_order(spark):
    line = lambda s: [[float(i), float(s * i % 7), 0.0] for i in range(10)]
    rows = spark.createDataFrame([(0, i, i, line(3), line(3 if i == 4 else i + 1)) for i in range(1, 7)], "query_id long, id long, rank_s1 long, query_seq array<array<double>>, seq array<array<double>>")
    out = prediction.staged_rerank(rows, kim_share=0.5, keogh_most=2).orderBy("rank_s2").collect()
    assert len(out) == 6 and sum(math.isinf(r.dtw_dist) for r in out) == 4
    assert out[0].dtw_dist == 0.0 and [r.rank_s1 for r in out[2:]] == sorted(r.rank_s1 for r in out[2:])


def test_query_blocks_equal_the_broadcast(spark, monkeypatch):
    queries, rows = spark.range(20).withColumnRenamed("id", "query_id"), spark.range(30)
    few = ranking.pairs(queries, rows).count()
    monkeypatch.setattr(ranking, "MAX_BROADCAST_BYTES", 5)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 40)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 7)
    assert ranking.pairs(queries, rows).count() == few == 600


def shape_preserving(y, x):
    """Piecewise cubic Hermite interpolation of y at 0, 1, 2, ... with Fritsch and Carlson's slopes, in plain Python."""
    n, d = len(y), [b - a for a, b in zip(y, y[1:])]
    if n == 2:
        return y[0] + d[0] * x

    def end(a, b):
        m = (3 * a - b) / 2
        return 0.0 if m * a <= 0 else 3 * a if a * b <= 0 and abs(m) > 3 * abs(a) else m

    slopes = [end(d[0], d[1]), *(2 * a * b / (a + b) if a * b > 0 else 0.0 for a, b in zip(d, d[1:])), end(d[-1], d[-2])]
    i = min(int(x), n - 2)
    u = x - i
    return (2 * u**3 - 3 * u**2 + 1) * y[i] + (u**3 - 2 * u**2 + u) * slopes[i] + (3 * u**2 - 2 * u**3) * y[i + 1] + (u**3 - u**2) * slopes[i + 1]


def test_kim_bound_of_whole_sequences(spark, sf):
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    seqs = {r.user_id: np.array(r.seq, float) for r in queries._seqs(t).collect()}
    assert len({len(s) for s in seqs.values()}) > 1
    want = {}
    for i in (i for i in seqs if i % 50 == 0):
        for j in (j for j in seqs if j != i):
            a, b = seqs[i], seqs[j]
            if min(len(a), len(b)) < 2:
                want[i, j] = math.inf
                continue
            b = np.array([[shape_preserving(y, x) for y in b.T.tolist()] for x in np.linspace(0, len(b) - 1, len(a))])
            want[i, j] = max(math.dist(x, y) for x, y in ((a[0], b[0]), (a[-1], b[-1]), (a.min(0), b.min(0)), (a.max(0), b.max(0))))
    got = {(r.query_id, r.id): r.bound for r in queries.QUERIES["kim_bound_sequences"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_percentiles_between_ranks(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    r = series.midpoint_percentiles(rows, [], "x", [90, 50, 1]).first()
    assert (r.p90, r.p50, r.p1) == (9.5, 5.5, 1.0)


def test_streaming_summary(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    src = str(tmp_path / "in")
    spark.createDataFrame([(t0 + dt.timedelta(minutes=30 * i), "a", float(i)) for i in range(8)], "at timestamp, k string, x double").write.parquet(src)
    stream = spark.readStream.schema("at timestamp, k string, x double").parquet(src)
    q = summaries.write_appending(summaries.windowed_info(stream, "at", "x", ["k"], late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    rows = spark.read.schema("start timestamp, k string, min_distance double, max_distance double").parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.min_distance, r.max_distance) for r in rows][:2] == [(0.0, 1.0), (2.0, 3.0)]


def test_sequences_of_missing_ids_are_empty(spark):
    pts = tables.points(spark.createDataFrame([(1, "1_1", 1, 2.0, None)], "t long, s string, o int, x double, y double"), "t", "s", ["o"], ["x", "y"])
    got = {r.id: (r.seq, r.n) for r in tables.sequences_of(spark.createDataFrame([("1",), ("1_1",), ("9",)], "id string"), pts).collect()}
    assert got["9"] == ([], 0) and got["1"][1] == got["1_1"][1] == 1 and math.isnan(got["1"][0][0][1])
    assert tables.at_level(pts, "trajectory").count() == 0 and pts.where(F.size("v") == 2).count() == 1


def test_result_csvs_meet_by_name(spark, tmp_path):
    (tmp_path / "run_20240101_120000.csv").write_text("a,b\n1,2\n")
    (tmp_path / "run_20240102_120000.csv").write_text("b,a\n20,10.5\n")
    (tmp_path / "run_20240103_120000.csv").write_text("c,a\nx,100\n")
    df, missing = tables.result_csvs(spark, str(tmp_path / "run_*.csv"), ["a", "b", "c", "d"])
    assert missing == ["d"] and sorted((r.a, r.b, r.c, r.run_stamp[:8]) for r in df.collect()) == [(1.0, 2, None, "20240101"), (10.5, 20, None, "20240102"), (100.0, None, "x", "20240103")]


def test_database_tables_and_batches(spark):
    options = {"url": "jdbc:derby:memory:tracewright;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, float("nan") if i == 3 else i / 2) for i in range(50)], "id long, x double")
    tables.write_jdbc(rows.where("id < 40"), "poses", options)
    assert tables.write_jdbc_in_batches(rows.where("id >= 40"), "poses", options) == 10_000
    back = tables.jdbc(spark, "poses", options, {"partitionColumn": "id", "lowerBound": "0", "upperBound": "50", "numPartitions": "3"})
    assert back.rdd.getNumPartitions() == 3 and sorted((r.ID if hasattr(r, "ID") else r.id, r[1]) for r in back.collect()) == [(i, None if i == 3 else i / 2) for i in range(50)]
    bad = rows.select("id", "x", "x")
    with pytest.raises(Exception):  # noqa: B017  whatever the database says; each batch size is tried
        tables.write_jdbc_in_batches(bad, "poses", options)
    assert tables.jdbc(spark, "poses", options).count() == 50


def test_poses_are_stored_with_the_real_part_last(spark, tmp_path):
    path = str(tmp_path / "poses")
    frame = lambda t, x: spark.createDataFrame([(t, "s", 1, [x, 2.0, 3.0], [0.1, 0.2, 0.3, 0.4], "c")], "traj_id long, seg_id string, timestamp long, position array<double>, orientation array<double>, calibration_id string")
    tables.write_transformed_poses(frame(1, 1.0).union(frame(2, 5.0)), path)
    tables.write_transformed_poses(frame(2, 7.0), path)
    rows = {r.traj_id: r for r in spark.read.parquet(path).collect()}
    assert (rows[1].x, rows[2].x) == (1.0, 7.0) and (rows[1].qx, rows[1].qy, rows[1].qz, rows[1].qw) == (0.2, 0.3, 0.4, 0.1)


def test_orientations_without_direction_are_null(spark):
    rows = spark.createDataFrame([([0.0] * 4,), ([0.0, 1.0, 0.0, 0.0],), (None,)], "p array<double>")
    numbers = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    some = {
        "inverse": quaternions.inverse("p"), "unit": quaternions.normalised("p"), "rodrigues": quaternions.rodrigues("p"), "tracker": quaternions.tracker_to_instrument("p"), "power": quaternions.power(quaternions.normalised("p"), 0.5),
        "axis": quaternions.from_axis_angle(F.slice("p", 2, 3), F.lit(1.0)), "turned": quaternions.turned_by_angles("p", numbers(1, 0, 0, 0, 1, 0, 0, 0, 1), numbers(1, 0, 0, 0), numbers(1, 0, 0, 0)), "between": quaternions.from_vectors(F.slice("p", 2, 3), numbers(0, 0, 1)),
    }
    zero, half, none = rows.select(*[v.alias(n) for n, v in some.items()]).collect()
    assert all(zero[n] is None for n in some) and all(none[n] is None for n in some)
    assert half.rodrigues is None and half.inverse == [0.0, -1.0, 0.0, 0.0] and half.axis == pytest.approx([math.cos(0.5), math.sin(0.5), 0, 0]) and half.turned == pytest.approx([0, 1, 0, 0], abs=1e-9)


def test_means_leave_infinite_values_out(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (float("inf"), 5.0), (float("nan"), 5.0), (None, 5.0), (4.0, 2.0), (9.0, None)], "v double, w double")
    assert rows.agg(stats.weighted_mean("v", "w").alias("m")).first().m == 3.0


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_without_keys(spark, direction, strict):
    rng = np.random.default_rng(3)
    left = [(i, None if i == 7 else int(t)) for i, t in enumerate(rng.integers(0, 500, 200))] + [(900 + i, 250) for i in range(300)]
    right = [(int(t), f"r{t}") for t in rng.choice(500, 40, replace=False)] + [(None, "never")]
    a, b = spark.createDataFrame(left, "id int, at int"), spark.createDataFrame(right, "rt int, v string")
    df = joins.asof(a, b, "at", "rt", direction=direction, strict=strict, right_columns=["v"])
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    known = sorted((t, v) for t, v in right if t is not None)
    for r in df.collect():
        fits = [v for t, v in known if r.at is not None and ((t < r.at or t == r.at and not strict) if direction == "backward" else (t > r.at or t == r.at and not strict))]
        assert r.v == (fits[-1 if direction == "backward" else 0] if fits else None)
    assert df.count() == 500 and joins.asof(a.limit(0), b, "at", "rt", right_columns=["v"]).count() == 0
    assert joins.asof(a, b.limit(0), "at", "rt", right_columns=["v"]).where("v is null").count() == 500


def test_running_totals_over_ranges(spark):
    rows = [("hot", i, i % 5) for i in range(3000)] + [(None, i, 1) for i in range(20)] + [("b", 0, 2)]
    df = spark.createDataFrame(rows, "k string, o int, x int").repartition(5)
    got = {(r.k, r.o): r.total for r in series.running_total(df, ["k"], ["o"], F.col("x"), "total").collect()}
    for k in ("hot", None, "b"):
        total = 0
        for _, o, x in [r for r in rows if r[0] == k]:
            total += x
            assert got[k, o] == total
    assert series.running_total(df.limit(0), ["k"], ["o"], F.col("x"), "total").count() == 0


def test_exact_rerank_finds_the_nearest_and_spares_distances(spark):
    rng = np.random.default_rng(4)
    walk = lambda n: np.cumsum(rng.normal(size=(n, 3)), axis=0)
    query = walk(30)
    others = [(query + 0.3 * rng.normal(size=query.shape) + 50).tolist() if i % 4 == 0 else (walk(int(rng.integers(20, 45))) * 4).tolist() for i in range(60)]
    rows = spark.createDataFrame([(0, i + 1, query.tolist(), s) for i, s in enumerate(others)], "query_id long, id long, query_seq array<array<double>>, seq array<array<double>>")
    want = sorted((kernels.constrained_dtw(query, np.array(s), window=0.2), i + 1) for i, s in enumerate(others))[:5]
    got = prediction.exact_rerank(rows, 5).orderBy("rank_s2").collect()
    assert [r.id for r in got] == [i for _, i in want] and [r.dtw_dist for r in got] == pytest.approx([d for d, _ in want])
    assert got[0].dtw_calls < 60
    bound = rows.select("id", vectors.kim_bound(vectors.relative_to_first("query_seq"), vectors.relative_to_first("seq"), 3).alias("b"))
    assert all(r.b <= kernels.constrained_dtw(query, np.array(others[r.id - 1]), window=0.2) + 1e-9 for r in bound.collect())


def test_adaptive_rerank_looks_at_the_list(spark, monkeypatch):
    rows = spark.createDataFrame([(q, i, i, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]], [[0.0, 0.0, 0.0], [1.0, float(i), 0.0]]) for q, n in ((0, 4), (1, 30)) for i in range(1, n + 1)], "query_id long, id long, rank_s1 long, query_seq array<array<double>>, seq array<array<double>>")
    monkeypatch.setattr(prediction, "SMALL_LIST", 10)
    out = prediction.adaptive_rerank(rows).collect()
    assert sum(math.isinf(r.dtw_dist) for r in out if r.query_id == 0) == 0 and sum(math.isinf(r.dtw_dist) for r in out if r.query_id == 1) == 20


def test_whole_rankings_equal_top_k(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)], "id long, vec array<double>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.distance) for r in df.collect())
    assert key(ranking.cosine_ranking(asked, rows, 9)) == key(ranking.cosine_top_k(asked, rows, 1000, 9))


def test_points_are_compared_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    curve, points = rng.normal(size=(12, 3)), rng.normal(size=(50, 3))
    whole = kernels.point_to_polyline(curve, points)
    monkeypatch.setattr(kernels, "CELLS", 30)
    assert all(np.array_equal(a, b) for a, b in zip(whole, kernels.point_to_polyline(curve, points)))


def test_interpolated_orientations_outside_are_null(spark):
    half = math.sqrt(0.5)
    samples = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0, 0.0]), ("a", 10, [half, half, 0.0, 0.0])], "k string, at int, p array<double>")
    wanted = spark.createDataFrame([("a", -1), ("a", 0), ("a", 5), ("a", 10), ("a", 11), ("b", 5)], "k string, at int")
    got = {(r.k, r.at): r.orientation for r in kinematics.interpolated(samples, wanted, ["k"], "at", "p").collect()}
    assert got["a", -1] is None and got["a", 11] is None and got["b", 5] is None
    assert got["a", 0] == pytest.approx([1, 0, 0, 0]) and got["a", 10] == pytest.approx([half, half, 0, 0]) and got["a", 5] == pytest.approx([math.cos(math.pi / 8), math.sin(math.pi / 8), 0, 0])


def test_percentiles_by_selection_in_large_and_small_groups(spark, monkeypatch):
    import numpy as np

    from tracewright.operators import series

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=4000), "b": np.round(rng.normal(size=3000), 1), "c": np.full(900, 2.5), "d": rng.normal(size=3), None: rng.normal(size=50)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None)], "k string, v double").repartition(3)
    percents = [0, 1, 25, 50, 99.5, 100]
    monkeypatch.setattr(series, "SMALL_GROUP", 60)  # others are bracketed
    monkeypatch.setattr(series, "SKETCH", 100)
    for few in (series.FEW_GROUPS, 2):
        monkeypatch.setattr(series, "FEW_GROUPS", few)
        got = {r.k: r[1:] for r in series.midpoint_percentiles(df, ["k"], "v", percents).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert np.allclose(got[k], np.percentile(v, percents, method="hazen"))
    every = np.concatenate(list(groups.values()))
    row = series.midpoint_percentiles(df, [], "v", percents)
    assert np.allclose(row.first(), np.percentile(every, percents, method="hazen"))
    plan = row._jdf.queryExecution().toString()
    assert "RDDScan" not in plan and "RangePartitioning" not in plan
    assert series.midpoint_percentiles(df.limit(0), ["k"], "v", [50]).count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_joins_in_time_over_ranges_equal_those_by_key(spark, keys):
    rng = np.random.default_rng(11)
    some = lambda n: ["hot"] * (n - 30) + ["b"] * 20 + [None] * 10
    left = spark.createDataFrame([(k, int(t), i) for i, (k, t) in enumerate(zip(some(200), rng.integers(0, 300, 200)))] + [("hot", None, 1000)], "k string, at int, id int").repartition(3)
    right = spark.createDataFrame([(k, int(t), float(i)) for i, (k, t) in enumerate(zip(some(80), rng.permutation(300)[:80]))], "k string, rt int, v double").repartition(2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for direction in ("backward", "forward"):
            for strict in (False, True):
                got = {r.id: r.v for r in joins.asof(left, right, "at", "rt", keys, direction, strict, ["v"], spread=True).collect()}
                rows, others = left.collect(), right.collect()
                assert len(got) == len(rows)
                for r in rows:
                    back = direction == "backward"
                    fit = [o for o in others if r["at"] is not None and (not keys or o.k == r.k) and ((o.rt < r["at"] or not strict and o.rt == r["at"]) if back else (o.rt > r["at"] or not strict and o.rt == r["at"]))]
                    assert got[r.id] == (None if not fit else (max if back else min)(fit, key=lambda o: o.rt).v)
        near = {r.id: r.v for r in joins.nearest(left, right, "at", "rt", keys, ["v"], F.col("gap__") <= 40, spread=True).collect()}
        for r in rows:
            fit = sorted((abs(o.rt - r["at"]), o.rt, o.v) for o in others if r["at"] is not None and (not keys or o.k == r.k))
            assert near[r.id] == (fit[0][2] if fit and fit[0][0] <= 40 else None)
        plan = joins.nearest(left, right, "at", "rt", keys, ["v"], spread=True)._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_csv_writer_round_trip(spark, tmp_path):
    from tracewright.sources import tables

    rows = spark.createDataFrame([(1, "a,b", 1.5), (2, 'quote "x"', None), (3, None, -0.25)], "id int, name string, v double")
    tables.write_csv(rows, str(tmp_path / "out"))
    tables.write_csv(rows.where("id < 3"), str(tmp_path / "out"))  # a second call replaces the first
    back = spark.read.schema(rows.schema).option("header", True).option("escape", "\\").csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.where("id < 3").collect()))


def test_points_of_ids_are_counted_as_their_sequences_say(spark):
    from tracewright.sources import tables

    points_ = spark.createDataFrame([(1, "1_a", i, [0.0]) for i in range(4)] + [(1, "1_b", 9, [0.0]), (2, "2", 1, [0.0])], "traj_id long, seg_id string, ord int, v array<double>")
    ids = spark.createDataFrame([("1",), ("1_a",), ("2",), ("x",), (None,)], "id string")
    counts = {r.id: r.n for r in tables.counts_of(ids, points_).collect()}
    assert counts == {"1": 5, "1_a": 4, "2": 1, "x": 0, None: 0} == {r.id: r.n for r in tables.sequences_of(ids, points_).collect()}
