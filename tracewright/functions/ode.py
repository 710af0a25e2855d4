"""Initial value problems of many rows side by side, by an embedded Runge-Kutta pair of orders 5 and 4 (Dormand and Prince, 1980).

Every row has its own time, step and stop times; a step is a few array operations for all rows that are still on their way, and
each row's step follows its own error. The weights below are fixed values of the published pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

C = np.array([0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1])
A = [
    np.array([]),
    np.array([1 / 5]),
    np.array([3 / 40, 9 / 40]),
    np.array([44 / 45, -56 / 15, 32 / 9]),
    np.array([19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729]),
    np.array([9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656]),
    np.array([35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]),
]
#: Fifth order less fourth order.
E = np.array([71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40])
SAFETY, SLOWEST, FASTEST = 0.9, 0.2, 5.0
#: A row whose step falls below this share of its time span has failed: its states are not a number from there on.
LEAST_STEP = 1e-12


def solve(slope: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], state: np.ndarray, times: list[np.ndarray], relative: float = 1e-10, absolute: float = 1e-12) -> list[np.ndarray]:
    """The states of each row at its times (rising or falling; the first is that of `state`).

    slope(rows, t, y) gives the derivatives of the named rows, whose times are t and states y."""
    n = len(state)
    counts = np.array([len(t) for t in times], np.int64)
    table = np.full((n, max(1, counts.max() if n else 1)), np.nan)
    for i, t in enumerate(times):
        table[i, : len(t)] = t
    out = np.full((n, table.shape[1], state.shape[1]), np.nan)
    if not n:
        return []
    out[:, 0] = state
    y, t, target = state.astype(float).copy(), table[:, 0].copy(), np.ones(n, np.int64)
    span = np.where(counts > 1, np.abs(table[np.arange(n), np.maximum(counts - 1, 0)] - t), 0.0)
    step = span / 100
    live = np.flatnonzero((counts > 1) & np.isfinite(span))
    k = np.zeros((7, n, state.shape[1]))
    k[0, live] = slope(live, t[live], y[live])
    while len(live):
        goal = table[live, target[live]]
        left = goal - t[live]
        h = np.sign(left) * np.minimum(step[live], np.abs(left))
        for s in range(1, 7):
            k[s, live] = slope(live, t[live] + C[s] * h, y[live] + h[:, None] * np.tensordot(A[s], k[:s, live], (0, 0)))
        new = y[live] + h[:, None] * np.tensordot(A[6], k[:6, live], (0, 0))
        error = h[:, None] * np.tensordot(E, k[:, live], (0, 0))
        size = absolute + relative * np.maximum(np.abs(y[live]), np.abs(new))
        wrong = np.sqrt(((error / size) ** 2).mean(axis=1))
        wrong = np.where(np.isfinite(wrong), wrong, np.inf)
        good = wrong <= 1
        rows = live[good]
        arrived = np.abs(h[good]) >= np.abs(left[good])
        y[rows] = new[good]
        t[rows] = np.where(arrived, goal[good], t[rows] + h[good])
        k[0, rows] = k[6, rows]  # the last slope of a step is the first of the next
        done = rows[arrived]
        out[done, target[done]] = y[done]
        target[done] += 1
        grown = np.abs(h) * np.clip(SAFETY * np.maximum(wrong, 1e-10) ** -0.2, SLOWEST, FASTEST)
        shorter = good & (np.abs(h) < step[live])  # cut short by a stop time: the step before still fits
        step[live] = np.where(shorter, np.maximum(grown, step[live]), grown)
        failed = ~good & (step[live] < LEAST_STEP * span[live])
        live = live[(target[live] < counts[live]) & ~failed]
    return [out[i, :c] for i, c in enumerate(counts)]


def cubic(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (pieces, 4, columns), rising powers of t - t[i], of the cubic spline through rows y at rising times t; the third
    derivative goes on over the second and the last but one point, three points give a parabola, two a line, one a constant."""
    n = len(t)
    if n == 1:
        return np.stack([y, 0 * y, 0 * y, 0 * y], axis=1)
    h, d = np.diff(t), np.diff(y, axis=0) / np.diff(t)[:, None]
    if n == 2:
        return np.stack([y[:1], d, 0 * d, 0 * d], axis=1)
    if n == 3:
        curve = (d[1] - d[0]) / (t[2] - t[0])
        slopes = np.stack([d[0] - curve * h[0], d[0] + curve * h[0]])
        return np.stack([y[:2], slopes, np.stack([curve, curve]), 0 * slopes], axis=1)
    m, right = np.zeros((n, n)), np.zeros_like(y)
    for i in range(1, n - 1):  # second derivatives
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * (d[i] - d[i - 1])
    m[0, :3], m[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    s = np.linalg.solve(m, right)
    a, b = s[:-1], s[1:]
    return np.stack([y[:-1], d - h[:, None] * (2 * a + b) / 6, a / 2, (b - a) / (6 * h[:, None])], axis=1)
