"""Nearest points of cubic curves against dense sampling, and the pieces against known curves."""

import numpy as np
import pytest

from tracewright.functions import curves, kernels


def dense(path, points, method, n=4000):
    c = curves.pieces(curves.distinct(path), method)
    s = np.tile(np.linspace(0, 1, n), len(c))
    on = curves.at(c, np.repeat(np.arange(len(c)), n), s)
    d = np.array([np.linalg.norm(on - p, axis=1).min() for p in points])
    steps = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(on, axis=0), axis=1))])
    share = np.array([steps[np.linalg.norm(on - p, axis=1).argmin()] for p in points]) / steps[-1]
    return d, share


@pytest.mark.parametrize("method", ["pchip", "spline"])
@pytest.mark.parametrize("n,dims", [(2, 2), (3, 3), (4, 3), (12, 2), (30, 3), (9, 1)])
def test_nearest_points_equal_dense_sampling(method, n, dims, monkeypatch):
    rng = np.random.default_rng(n + dims)
    path, points = np.cumsum(rng.normal(size=(n, dims)), axis=0), 2 * rng.normal(size=(60, dims)) + 1
    foot, d, share = curves.nearest(path, points, method)
    want, shares = dense(path, points, method)
    assert np.allclose(d, want, atol=5e-4) and (d <= want + 1e-9).all() and np.allclose(np.linalg.norm(foot - points, axis=1), d)
    assert (np.abs(share - shares) < 2e-3).mean() > 0.95  # but for points with two feet
    monkeypatch.setattr(curves, "PAIRS", 7)
    monkeypatch.setattr(curves, "CELLS", 20)
    again = curves.nearest(path, points, method)
    assert all(np.allclose(a, b) for a, b in zip(again, (foot, d, share)))


def test_straight_and_repeated_points():
    path = np.array([[0.0, 0], [1, 0], [1, 0], [3, 0], [4, 0]])
    points = np.array([[2.0, 1], [-1, 0], [5, 0], [1, 0], [3.5, -2]])
    for method in ("pchip", "spline"):
        foot, d, share = curves.nearest(path, points, method)
        assert np.allclose(foot, [[2, 0], [0, 0], [4, 0], [1, 0], [3.5, 0]]) and np.allclose(d, [1, 1, 1, 0, 2]) and np.allclose(share, [0.5, 0, 1, 0.25, 0.875])
    assert np.allclose(curves.nearest(path[:1], points)[1], np.linalg.norm(points, axis=1))
    assert np.allclose(kernels.point_to_polyline(path, points)[1], d)


def test_pieces_follow_even_cubics_and_circles():
    y = np.random.default_rng(1).normal(size=8)
    path = np.stack([np.arange(8.0), np.zeros(8)], axis=1)
    assert np.allclose(curves.pieces(path, "pchip")[:, 1, 1], 0)
    even = np.stack([np.cumsum(np.ones(8)), y], axis=1)  # chords differ, so only shapes are compared
    c = curves.pieces(even, "pchip")
    v = curves.at(c, np.repeat(np.arange(7), 50), np.tile(np.linspace(0, 1, 50), 7))[:, 1].reshape(7, 50)
    assert (v >= np.minimum(y[:-1], y[1:])[:, None] - 1e-9).all() and (v <= np.maximum(y[:-1], y[1:])[:, None] + 1e-9).all()  # keeps the shape
    turn = np.linspace(0, 2 * np.pi, 60)
    circle = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    _, d, share = curves.nearest(circle, np.array([[0.0, 3.0], [-2.0, 0.0]]), "spline")
    assert np.allclose(d, [2, 1], atol=1e-4) and np.allclose(share, [0.25, 0.5], atol=1e-3)
    c = curves.pieces(circle, "spline")
    assert np.isclose(curves.lengths(c, np.arange(59), np.ones(59)).sum(), 2 * np.pi, rtol=1e-5)
