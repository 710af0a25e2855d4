"""Initial value problems side by side against closed forms and conserved quantities."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import kernels, ode
from tracewright.operators import kinematics


def test_rows_advance_by_their_own_steps_and_times():
    w = np.array([1.0, 5.0, 40.0, 3.0])
    slope = lambda rows, t, y: np.stack([-w[rows] * y[:, 1], w[rows] * y[:, 0]], axis=1)
    times = [np.linspace(0, 3, 7), np.array([0, 1.0, 2.5]), np.array([2.0, 1.0, -1.0]), np.array([1.0])]
    for got, t, f in zip(ode.solve(slope, np.tile([1.0, 0.0], (4, 1)), times), times, w):
        assert np.allclose(got[:, 0], np.cos(f * (t - t[0])), atol=1e-8) and np.allclose(got[:, 1], np.sin(f * (t - t[0])), atol=1e-8)
    assert ode.solve(slope, np.zeros((0, 2)), []) == []


def test_the_error_follows_the_tolerance_and_failures_are_not_numbers():
    slope = lambda rows, t, y: -2 * t[:, None] * y**2  # noqa: E731  y = 1 / (1 + t^2)
    errors = [abs(ode.solve(slope, np.ones((1, 1)), [np.array([0, 3.0])], tol, 1e-14)[0][1, 0] - 0.1) for tol in (1e-4, 1e-7, 1e-10)]
    assert errors[0] < 1e-4 and errors[1] < 1e-7 and errors[2] < 1e-10
    blown = ode.solve(lambda rows, t, y: y**2, np.array([[1.0], [0.1]]), [np.array([0, 0.5, 2.0])] * 2)  # the first is infinite at 1
    assert math.isclose(blown[0][1, 0], 2, rel_tol=1e-8) and np.isnan(blown[0][2, 0]) and math.isclose(blown[1][2, 0], 1 / 8, rel_tol=1e-8)


def test_cubic_pieces_equal_the_spline_of_even_steps():
    y = np.random.default_rng(2).normal(size=(9, 2))
    c, x = ode.cubic(np.arange(9.0), y), np.linspace(0, 8, 41)
    i = np.clip(x.astype(int), 0, 7)
    s = (x - i)[:, None]
    assert np.allclose(c[i, 0] + s * (c[i, 1] + s * (c[i, 2] + s * c[i, 3])), kernels.spline(y, x))
    for n in (1, 2, 3):
        t = np.array([0.0, 0.5, 2.0])[:n]
        c = ode.cubic(t, (t**2)[:, None])
        assert c.shape == (max(1, n - 1), 4, 1) and (n < 3 or np.allclose(c[1, :, 0], [0.25, 1.0, 1.0, 0.0]))


def test_free_bodies_keep_energy_and_momentum_and_driven_ones_follow_the_torque(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=3).tolist(), (1 + rng.random(3)).tolist(), [0.0, 0.7, 3.0, 2.0 + i]) for i in range(40)]
    odd = [(100, None, [1.0, 0, 0], [1.0, 1, 1], [0.0]), (101, [1.0, 0, 0, 0], [1.0, 0, 0], [1.0, 0.0, 1], [0.0]), (102, [1.0, 0, 0, 0], [1.0, 0, 0], [1.0, 1, 1], []), (103, [0.0] * 4, [1.0, 0, 0], [1.0, 1, 1], [0.0])]
    real = lambda v: None if v is None else [float(x) for x in v]
    rows = [(i, real(q), real(w), real(m), sorted(t)) for i, q, w, m, t in rows + odd]
    df = spark.createDataFrame(rows, "id long, q array<double>, w array<double>, i array<double>, t array<double>")
    for r in kinematics.propagated(df, "q", "w", "i", "t").collect():
        if r.id >= 100:
            assert r.motion is None
            continue
        m, space = np.array(r.i), []
        for at, s in zip(r.t, r.motion):
            a, v = s.orientation[0], np.array(s.orientation[1:])
            body = m * np.array(s.rate)
            space.append(body + 2 * a * np.cross(v, body) + 2 * np.cross(v, np.cross(v, body)))
            assert s.t == at and math.isclose(a * a + v @ v, 1) and math.isclose((m * np.array(s.rate) ** 2).sum(), (m * np.array(r.w) ** 2).sum(), rel_tol=1e-7)
        assert np.allclose(space, space[0], atol=1e-7)
    still = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [2.0, 2.0, 2.0], [0.0, 1.0, 2.0])], df.schema)
    driven = kinematics.propagated(still, "q", "w", "i", "t", torque=lambda t, q, w: np.stack([0 * t, 0 * t, 6 * t], axis=1)).first().motion
    for s in driven:  # 2 w' = 6 t about z
        assert math.isclose(s.rate[2], 1.5 * s.t**2, abs_tol=1e-9) and math.isclose(s.orientation[3], math.sin(s.t**3 / 4), abs_tol=1e-9)


def test_integration_by_spline_of_odd_series(spark):
    rows = [("a", 0.0, [0.0, 0, 1.0]), ("a", 2.0, [0.0, 0, 1.0]), ("a", 2.0, [0.0, 0, 9.0]), ("a", None, [1.0, 1, 1]), ("b", 5.0, [1.0, 0, 0]), ("c", 1.0, None), ("c", 2.0, [1.0, None, 0]), (None, 0.0, [0.0, 0, 0]), (None, 3.0, [0.0, 0, 0])]
    df = spark.createDataFrame([(k, t, v and [None if x is None else float(x) for x in v]) for k, t, v in rows], "k string, at double, rate array<double>")
    got = {(r.k, r.at): r.orientation for r in kinematics.integrated_by_spline(df, ["k"], "at", "rate").collect()}
    assert set(got) == {("a", 0.0), ("a", 2.0), ("b", 5.0), (None, 0.0), (None, 3.0)}
    assert np.allclose(got["a", 2.0], [math.cos(1), 0, 0, math.sin(1)]) and np.allclose(got["b", 5.0], [1, 0, 0, 0]) and np.allclose(got[None, 3.0], [1, 0, 0, 0])
    assert kinematics.integrated_by_spline(df.where(F.lit(False)), ["k"], "at", "rate").count() == 0
