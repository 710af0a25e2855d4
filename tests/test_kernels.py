"""Kernels and expressions against direct definitions, hand-checked cases and each other."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import kernels as k
from tracewright.functions import quaternions as q
from tracewright.functions import vectors

paths = st.integers(2, 9).flatmap(lambda n: st.lists(st.tuples(*[st.integers(-5, 5)] * 3), min_size=n, max_size=n)).map(lambda p: np.array(p, float))


def slow_total(cost, join):
    m, n = cost.shape
    acc = np.zeros((m, n))
    for i in range(m):
        for j in range(n):
            before = [acc[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
            acc[i, j] = join(min(before), cost[i, j]) if before else cost[i, j]
    return acc


@settings(max_examples=60, deadline=None)
@given(paths, paths)
def test_programs_equal_the_plain_recurrence(x, y):
    d = k.distances(x, y)
    assert np.allclose(k.accumulate(d), slow_total(d, lambda a, b: a + b))
    assert np.allclose(k.accumulate(d, bottleneck=True), slow_total(d, max))
    for i, j, dist, total in (k.dtw(x, y, free_start=False), k.discrete_frechet(x, y)):
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(x) - 1, len(y) - 1)
        assert set(zip(np.diff(i), np.diff(j))) <= {(0, 1), (1, 0), (1, 1)}
        assert np.isclose(total, dist.sum()) or np.isclose(total, dist.max())
    assert np.isclose(k.dtw(x, y)[3], slow_total(d, lambda a, b: a + b)[-1, -1] - d[0, 0])


@settings(max_examples=60, deadline=None)
@given(paths, paths)
def test_selective_alignment_is_monotone_and_exact_on_its_points(x, y):
    px, py, d, ix, iy, row = k.selective_dtw(x, y)
    assert (ix[0], iy[0], ix[-1], iy[-1]) == (0, 0, len(x) - 1, len(y) - 1)
    assert (np.diff(ix) >= -1e-12).all() and (np.diff(iy) >= -1e-12).all() and len(row) == len(d)
    assert np.allclose(d, np.linalg.norm(k.along(x, ix) - k.along(y, iy), axis=1))
    whole = (ix % 1 == 0) | (iy % 1 == 0)
    assert whole.all()  # never an interior point of both paths


def test_selective_alignment_uses_edges():
    x = np.array([[0, 0, 0], [10, 0, 0]], float)
    y = np.array([[0, 1, 0], [3, 1, 0], [7, 1, 0], [10, 1, 0]], float)
    _, _, d, ix, iy, _ = k.selective_dtw(x, y)
    # an edge is entered from the vertex pair beside it (its first admissible predecessor), so that pair is on the path
    assert np.allclose(ix, [0, 0, 0.3, 0.7, 1]) and np.allclose(iy, [0, 1, 1, 2, 3])
    assert np.allclose(d, [1, 10**0.5, 1, 1, 1])
    same = k.selective_dtw(y, y)
    assert np.allclose(same[2], 0)
    one = k.selective_dtw(x[:1], y[:1])
    assert np.allclose(one[2], 1) and len(one[2]) == 1


def test_lcss_matches_everything_of_close_paths():
    x = np.arange(12.0).reshape(4, 3)
    i, j, d, score, eps = k.lcss(x, x + 0.1)
    assert score == 1 and i.tolist() == j.tolist() == [0, 1, 2, 3] and eps > 0
    far = k.lcss(x, x + 100, epsilon=1.0)
    assert far[3] == 0 and len(far[0]) == 0


def test_point_to_polyline():
    foot, d, at = k.point_to_polyline(np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0]], float), np.array([[1, 1, 0], [5, -1, 0], [9, 2, 0]], float))
    assert np.allclose(foot, [[1, 0, 0], [4, 0, 0], [4, 2, 0]]) and np.allclose(d, [1, 2**0.5, 5]) and np.allclose(at, [1 / 8, 0.5, 0.75])
    zero_edge = k.point_to_polyline(np.array([[0, 0, 0], [0, 0, 0]], float), np.array([[3, 4, 0]], float))
    assert np.allclose(zero_edge[1], 5)


def test_constrained_dtw_and_bounds():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 3))
    assert k.constrained_dtw(a, a + 7) == pytest.approx(0)  # translation is removed
    assert k.constrained_dtw(a, a[::2], window=1.0) >= 0
    assert k.constrained_dtw(a, a[::-1], best=0.5) == 0.5
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    assert k.constrained_dtw(a, a @ turn.T + 3, rotate=True) == pytest.approx(0, abs=1e-9)
    assert k.kim_bound(a, a + 100) == pytest.approx(100 * 3**0.5) and k.kim_bound(a, a + 100, translate=True) == pytest.approx(0)
    assert k.keogh_bound(a, a) == 0 and k.kim_bound(a[:1], a) == float("inf")
    assert k.keogh_bound(a, a + np.array([50, 0, 0])) > 0
    joints = rng.uniform(0, 1, (10, 6))
    assert k.constrained_dtw(joints, joints * 2 + 1, mode="joint") == pytest.approx(0)  # joints are always scaled
    assert [k.half_up(x) for x in (0.5, 1.5, 2.4)] == [1, 2, 2]


def test_pairs_together_equal_pairs_alone():
    rng = np.random.default_rng(4)
    pairs = [(rng.normal(size=(rng.integers(1, 30), 3)), rng.normal(size=(rng.integers(1, 30), 3))) for _ in range(60)]
    for options in ({}, {"window": 0.05}, {"mode": "joint"}, {"normalise": True}):
        alone = [k.constrained_dtw(a, b, **options) for a, b in pairs]
        assert np.allclose(k.constrained_dtw_many(pairs, cells=5000, **options), alone)


def test_smoothing_keeps_polynomials_and_pchip_keeps_monotony():
    t = np.arange(30.0)[:, None]
    cubic = np.hstack([t**3 - t, t**2, 2 * t])
    assert np.allclose(k.smooth(cubic, 3, 9), cubic)
    y = np.array([[0.0], [1], [1], [4], [9]])
    out = k.pchip(y, np.linspace(0, 4, 81))[:, 0]
    assert (np.diff(out) >= -1e-12).all() and np.allclose(out[::20], y[:, 0])
    assert np.allclose(k.velocity_embedding(np.zeros((5, 3)), 2, 3), 0) and len(k.velocity_embedding(np.zeros((5, 3)), 2, 3)) == 15
    for n in range(10, 35):
        v = k.velocity_embedding(np.cumsum(np.ones((n, 3)), 0), 2, 3)
        assert np.linalg.norm(v) == pytest.approx(1) and np.allclose(v, v[0])


def test_orientation_cleaning():
    angle = np.radians(np.linspace(0, 20, 41))
    path = np.stack([np.cos(angle / 2), np.sin(angle / 2), 0 * angle, 0 * angle], 1)
    assert np.allclose(k.without_jumps(path), path)
    assert k.quaternion_distance(path, -path)[1].max() < 1e-5  # signs do not matter
    for at in (1, 20, 40):  # a jump at the start, inside and at the end
        bad = path.copy()
        bad[at] = [0.0, 1.0, 0.0, 0.0]
        assert np.isfinite(k.without_jumps(bad)).all()
    bad = path.copy()
    bad[20] = [0.0, 1.0, 0.0, 0.0]
    assert np.abs(k.without_jumps(bad) - path).max() < 1e-3
    i, j, d, total = k.quaternion_dtw(path, path)
    assert total == pytest.approx(0, abs=1e-4) and (i == j).all()


def test_rigid_fit_recovers_a_transform():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    r, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    y = x @ r + [1, 2, 3]
    got_r, got_t = k.rigid_fit(len(x), x.sum(0), y.sum(0), x.T @ y)
    assert np.allclose(got_r, r) and np.allclose(got_t, [1, 2, 3])


def test_quaternion_expressions(spark):
    rng = np.random.default_rng(2)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 20, 4)))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")
    row = df.select(
        q.product("a", q.inverse("a")).alias("one"), q.from_rotation(q.rotation("a")).alias("again"), q.exponential(q.logarithm("a")).alias("back"),
        q.power(q.power("a", 0.5), 2.0).alias("half"), q.slerp("a", "b", F.lit(0.0)).alias("start"), q.slerp("a", "b", F.lit(1.0)).alias("end"),
        q.rotate("a", F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("turned"), q.axis_angle("a").alias("aa"), q.angle_degrees("a", "b").alias("deg"), "a", "b",
    ).collect()
    for r in row:
        assert np.allclose(r.one, [1, 0, 0, 0])
        assert np.allclose(r.again, r.a) or np.allclose(r.again, -np.array(r.a))
        assert np.allclose(r.back, r.a) and np.allclose(r.half, r.a) and np.allclose(r.start, r.a)
        assert np.allclose(r.end, r.b) or np.allclose(r.end, -np.array(r.b))
        assert np.linalg.norm(r.turned) == pytest.approx(3)
        axis, angle = np.array(r.aa[:3]), r.aa[3]
        assert np.allclose([np.cos(angle / 2), *(np.sin(angle / 2) * axis)], r.a) or np.allclose([np.cos(angle / 2), *(np.sin(angle / 2) * axis)], -np.array(r.a))
        assert r.deg == pytest.approx(k.quaternion_angles(np.array(r.a), np.array(r.b)))
    e = spark.range(1).select(q.euler_fixed_xyz(F.array(*[F.lit(float(x)) for x in (0.5**0.5, 0, 0.5**0.5, 0)])).alias("e"), q.logarithm(F.array(*[F.lit(x) for x in (-2.0, 0.0, 0.0, 0.0)])).alias("l")).first()
    assert e.e[1] == pytest.approx(90) and e.e[0] == 0 and e.l[1] == pytest.approx(np.pi)


def test_vector_expressions_on_odd_sequences(spark):
    rows = [(0, None), (1, []), (2, [[1.0, 2.0, 3.0]]), (3, [[1.0, 1.0, 1.0], [3.0, 1.0, 1.0]]), (4, [[float(i), 0.0, 0.0] for i in range(30)])]
    df = spark.createDataFrame(rows, "id int, seq array<array<double>>")
    got = {r.id: r for r in df.select("id", vectors.position_embedding("seq", 2, 3).alias("p"), vectors.resample("seq", 4).alias("r")).collect()}
    assert got[0].p == got[1].p == [0.0] * 15 and got[2].p == [0.0] * 15
    assert got[3].r == [[1.0, 1.0, 1.0]] + [[3.0, 1.0, 1.0]] * 3  # short sequences repeat their end
    assert [p[0] for p in got[4].r] == pytest.approx([0, 29 / 3, 58 / 3, 29])
    assert np.linalg.norm(got[4].p) == pytest.approx(1)
    shares = spark.createDataFrame([("linear",), ("circular",), ("lcl",), ("",)], "m string").select(vectors.movement_share("m", "l", "linear")[0].alias("l")).collect()
    assert [r.l for r in shares] == pytest.approx([1.0, 0.25, 2 / 3, 0.0])


def test_euler_orders_vectors_and_rates(spark):
    from tracewright.operators import kinematics

    rng = np.random.default_rng(3)
    rows = [(v.tolist(), u.tolist(), w.tolist()) for v, u, w in zip(rng.normal(size=(12, 4)), rng.normal(size=(12, 3)), rng.normal(size=(12, 3)))]
    rows += [([1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [-2.0, 0.0, 0.0]), ([0.5**0.5, 0.0, 0.5**0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 3.0, 0.0])]
    df = spark.createDataFrame(rows, "p array<double>, u array<double>, v array<double>").withColumn("p", q.normalised("p"))
    orders = [a + b + c for a in "XYZ" for b in "XYZ" for c in "XYZ" if a != b != c]
    got = df.select("p", q.rotate(q.from_vectors("u", "v"), q.scale("u", 1 / q.norm("u"))).alias("t"), q.scale("v", 1 / q.norm("v")).alias("n"), *[q.from_euler(o, q.to_euler(o, "p")).alias(o) for o in orders]).collect()
    for r in got:
        assert np.allclose(r.t, r.n, atol=1e-6)
        assert all(np.allclose(r[o], r.p, atol=1e-6) or np.allclose(r[o], -np.array(r.p), atol=1e-6) for o in orders)
    spin = spark.range(6).select(F.lit(1).alias("k"), F.col("id").alias("at"), q.from_axis_angle(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("id") * 0.2).alias("p"))
    rates = kinematics.angular_rates(spin, ["k"], "at", "p").orderBy("at")
    assert [r.rate if r.rate is None else round(r.rate[2], 9) for r in rates.collect()] == [None] + [0.2] * 5
    back = kinematics.integrated(rates, ["k"], "at", "rate").orderBy("at").collect()
    assert all(np.allclose(r.orientation, r.p) for r in back)
    turning = spin.select(q.derivative("p", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.2))).alias("d")).first()
    assert np.allclose(turning.d, [0, 0, 0, 0.1])


@settings(max_examples=40, deadline=None)
@given(paths, paths)
def test_kept_diagonals_equal_the_whole_plane(x, y):
    """Also where values between are computed again on the way back."""
    some = (k.dtw, k.discrete_frechet, lambda a, b: k.lcss(a, b, 2.5), lambda a, b: k.lcss(a, b))
    whole = [f(x, y) for f in some]
    cells, k.PLANE_CELLS = k.PLANE_CELLS, 0
    try:
        again = [f(x, y) for f in some]
    finally:
        k.PLANE_CELLS = cells
    for a, b in zip(whole, again):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))


def test_a_long_pair_keeps_few_diagonals():
    rng = np.random.default_rng(1)
    x, y = np.cumsum(rng.normal(size=(3000, 3)), axis=0), np.cumsum(rng.normal(size=(2500, 3)), axis=0)
    i, j, d, total = k.dtw(x, y)
    cells, k.PLANE_CELLS = k.PLANE_CELLS, 1000
    try:
        again = k.dtw(x, y)
    finally:
        k.PLANE_CELLS = cells
    assert all(np.array_equal(u, v) for u, v in zip((i, j, d, total), again))


def test_splines_go_through_their_points_and_keep_cubics():
    t = np.arange(9.0)
    cubic = lambda u: np.stack([u**3 - 4 * u**2 + u - 7, 2 * u**3 - u], 1)
    at = np.linspace(0, 8, 41)
    assert np.allclose(k.spline(cubic(t), at), cubic(at))
    y = np.random.default_rng(2).normal(size=(9, 2))
    assert np.allclose(k.spline(y, t), y)
    e = 1e-4  # slopes and curvatures meet at the points
    for i in range(1, 8):
        left, here, right = (k.spline(y, np.array([i + d * e, i + d * 2 * e])) for d in (-1, 0, 1))
        assert np.allclose((here[0] - left[0]) / e, (right[0] - here[0]) / e, atol=1e-2)
    for n in (1, 2, 3):
        assert np.allclose(k.spline(cubic(t[:n]), t[:n]), cubic(t[:n]))


def test_selective_dtw_is_the_same_however_much_is_kept(monkeypatch):
    rng = np.random.default_rng(12)
    for t in range(60):
        m, n = rng.integers(1, 45, 2)
        x = np.cumsum(rng.normal(size=(m, 3)), axis=0)
        y = x[np.sort(rng.integers(0, m, n))] + 0.3 * rng.normal(size=(n, 3)) if t % 2 else np.cumsum(rng.normal(size=(n, 3)), axis=0)
        if t % 5 == 0:
            x, y = np.round(x), np.round(y)  # ties, repeated points
        monkeypatch.setattr(k, "KEPT_CELLS", 1_000_000)
        whole = k.selective_dtw(x, y)
        monkeypatch.setattr(k, "KEPT_CELLS", 0)
        assert all(np.array_equal(a, b) for a, b in zip(whole, k.selective_dtw(x, y)))


def test_selective_dtw_of_long_paths_takes_little_memory():
    """Planes of 2,500 x 2,500 cells would take over a gigabyte; the peak of the process must not grow by a tenth of that."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tracewright.functions import kernels as k
x = np.cumsum(np.random.default_rng(1).normal(size=(2500, 3)), axis=0)
k.selective_dtw(x[:300], x[:300])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
d = k.selective_dtw(x, x + 0.01)[2]
assert len(d) >= 2500 and np.median(d) < 0.02
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert float(out.stdout) < 100, out.stdout + out.stderr


def test_alignments_are_given_up_when_they_cannot_come_up_to_a_figure():
    rng = np.random.default_rng(21)
    pairs = [(np.cumsum(rng.normal(size=(n, 3)), axis=0), np.cumsum(rng.normal(size=(m, 3)), axis=0)) for n, m in rng.integers(1, 40, (80, 2))]
    whole = np.array([k.constrained_dtw(a, b, window=0.2) for a, b in pairs])
    assert np.allclose(k.constrained_dtw_many(pairs, window=0.2), whole)
    limits = whole * rng.choice([0.3, 0.999, 1.0, 2.0, np.inf], len(pairs))
    k.COUNTED["cells"] = 0
    got = np.array(k.constrained_dtw_many(pairs, window=0.2, best=limits * (1 + 1e-12)))
    some, kept = k.COUNTED["cells"], whole <= limits
    assert np.allclose(got[kept], whole[kept]) and ((got[~kept] > limits[~kept]) | np.isinf(got[~kept])).all() and np.isinf(got).any()
    k.COUNTED["cells"] = 0
    k.constrained_dtw_many(pairs, window=0.2)
    assert some < 0.9 * k.COUNTED["cells"]
