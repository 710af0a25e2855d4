"""Nearest points of cubic curves: pieces through points, stationary points of the distance in batches, arc lengths.

A curve is an array of pieces (pieces, 4, dimensions): rising powers of a parameter from 0 to 1 along each. Points and pieces are compared
in pairs; the box around a piece's four control points says how near it can be, so most pairs are settled without solving.
"""

from __future__ import annotations

import numpy as np

from . import ode

#: Pairs of point and piece that are solved, and that are compared, at once.
PAIRS, CELLS = 50_000, 2_000_000
#: Nodes and weights of the quadrature of arc lengths, and the parts of a piece that it is used on.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(10)
PARTS = 4


def distinct(path: np.ndarray) -> np.ndarray:
    """The path without points that repeat the one before."""
    return path[np.concatenate([[True], (np.diff(path, axis=0) != 0).any(axis=1)])]


def _slopes(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Shape-preserving slopes at uneven points (Fritsch and Carlson, 1980): weighted harmonic means inside, one-sided at the ends."""
    if len(d) == 1:
        return np.vstack([d, d])
    a, b, h0, h1 = d[:-1], d[1:], h[:-1, None], h[1:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(a * b > 0, 3 * (h0 + h1) / ((2 * h0 + h1) / b + (h0 + 2 * h1) / a), 0.0)
    ends = []
    for x, y, p, q in ((d[0], d[1], h[0], h[1]), (d[-1], d[-2], h[-1], h[-2])):
        e = ((2 * p + q) * x - p * y) / (p + q)
        e = np.where(e * x <= 0, 0.0, e)
        ends.append(np.where((x * y < 0) & (np.abs(e) > 3 * np.abs(x)), 3 * x, e))
    return np.vstack([ends[0], inner, ends[1]])


def pieces(path: np.ndarray, method: str = "pchip") -> np.ndarray:
    """The cubic pieces through distinct points, parametrised by chord length: shape-preserving 'pchip', or a cubic 'spline'."""
    h = np.linalg.norm(np.diff(path, axis=0), axis=1)
    if method == "spline":
        c = ode.cubic(np.concatenate([[0.0], np.cumsum(h)]), path)
        return c * h[:, None, None] ** np.arange(4)[None, :, None]
    d = np.diff(path, axis=0) / h[:, None]
    s = _slopes(h, d) * 1.0
    y0, y1, m0, m1 = path[:-1], path[1:], s[:-1] * h[:, None], s[1:] * h[:, None]
    return np.stack([y0, m0, 3 * (y1 - y0) - 2 * m0 - m1, 2 * (y0 - y1) + m0 + m1], axis=1)


def at(curve: np.ndarray, piece: np.ndarray, s: np.ndarray) -> np.ndarray:
    c, s = curve[piece], s[:, None]
    return c[:, 0] + s * (c[:, 1] + s * (c[:, 2] + s * c[:, 3]))


def lengths(curve: np.ndarray, piece: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Arc length of the pieces from their start up to a parameter."""
    c, total = curve[piece], np.zeros(len(piece))
    for k in range(PARTS):
        for node, weight in zip(NODES, WEIGHTS):
            s = (upto * (k + (node + 1) / 2) / PARTS)[:, None]
            total += weight / 2 * np.linalg.norm(c[:, 1] + s * (2 * c[:, 2] + s * 3 * c[:, 3]), axis=1)
    return total * upto / PARTS


def _stationary(c: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, parameter) of the interior stationary points of the distance of each point from its piece c[i]."""
    c = np.concatenate([(c[:, 0] - points)[:, None], c[:, 1:]], axis=1)
    g = np.zeros((len(c), 6))  # half the derivative of the squared distance, rising powers
    for i in range(4):
        for j in range(1, 4):
            g[:, i + j - 1] += j * (c[:, i] * c[:, j]).sum(axis=1)
    size = np.abs(g).max(axis=1)
    rows = np.flatnonzero(size > 0)
    g = g[rows] / size[rows, None]
    lead = np.where(np.abs(g[:, 5]) < 1e-12, 1e-12, g[:, 5])  # a lower degree has its other roots far away
    companion = np.zeros((len(g), 5, 5))
    companion[:, np.arange(1, 5), np.arange(4)] = 1
    companion[:, :, 4] = -g[:, :5] / lead[:, None]
    roots = np.linalg.eigvals(companion) if len(g) else np.zeros((0, 5))
    real = np.abs(roots.imag) < 1e-5 * (1 + np.abs(roots.real))  # double roots come as close pairs; wrong ones are no nearer
    pair, s = np.nonzero(real & (roots.real > -1e-6) & (roots.real < 1 + 1e-6))[0], None
    s = roots.real[real & (roots.real > -1e-6) & (roots.real < 1 + 1e-6)]
    p = g[pair]
    for _ in range(3):  # polished on the polynomial itself
        value, slope = np.zeros(len(s)), np.zeros(len(s))
        for k in range(5, -1, -1):
            slope = slope * s + value
            value = value * s + p[:, k]
        s = s - np.divide(value, slope, out=np.zeros(len(s)), where=np.abs(slope) > 1e-14)
    inside = (s > 0) & (s < 1)
    return rows[pair[inside]], s[inside]


def nearest(path: np.ndarray, points: np.ndarray, method: str = "pchip") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(foot points, distances, share of the arc length at the foot) of each point on the curve through the path."""
    path = distinct(path)
    if len(path) == 1:
        return np.repeat(path, len(points), 0), np.linalg.norm(points - path, axis=1), np.zeros(len(points))
    curve = pieces(path, method)
    c0, c1, c2, c3 = curve[:, 0], curve[:, 0] + curve[:, 1] / 3, curve[:, 0] + 2 * curve[:, 1] / 3 + curve[:, 2] / 3, curve.sum(axis=1)
    low, high = (f(np.stack([c0, c1, c2, c3]), axis=0) for f in (np.min, np.max))
    foot, best = np.zeros_like(points), np.zeros(len(points))
    where, spot = np.zeros(len(points), int), np.zeros(len(points))
    step = max(1, CELLS // len(path))
    for first in range(0, len(points), step):
        block = slice(first, min(first + step, len(points)))
        x = points[block]
        d = np.sqrt(((x[:, None] - path[None]) ** 2).sum(axis=2))
        v = d.argmin(axis=1)
        b = d[np.arange(len(x)), v]
        foot[block], w, s = path[v], np.minimum(v, len(curve) - 1), (v == len(curve)).astype(float)
        gap = np.sqrt((np.maximum(0, np.maximum(low[None] - x[:, None], x[:, None] - high[None])) ** 2).sum(axis=2))
        row, piece = np.nonzero(gap < b[:, None])
        for k in range(0, len(row), PAIRS):
            r, q = row[k : k + PAIRS], piece[k : k + PAIRS]
            pair, t = _stationary(curve[q], x[r])
            on = at(curve, q[pair], t)
            far = np.linalg.norm(on - x[r[pair]], axis=1)
            order = np.lexsort((t, q[pair], far, r[pair]))
            keep = order[np.concatenate([[True], np.diff(r[pair][order]) != 0])] if len(order) else order
            rows, better = r[pair][keep], far[keep] < b[r[pair][keep]]
            rows, keep = rows[better], keep[better]
            b[rows], w[rows], s[rows] = far[keep], q[pair][keep], t[keep]
            foot[first + rows] = on[keep]
        best[block], where[block], spot[block] = b, w, s
    whole = lengths(curve, np.arange(len(curve)), np.ones(len(curve)))
    before = np.concatenate([[0.0], np.cumsum(whole)])
    return foot, best, (before[where] + lengths(curve, where, spot)) / before[-1]
