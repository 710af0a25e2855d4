"""NumPy kernels for what no expression can say: alignments by dynamic programming, smoothing, small decompositions.

Each works on one pair of sequences (points in rows) inside a task. Programs run along anti-diagonals, whose cells do
not depend on each other, so the inner work is vectorised.
"""

from __future__ import annotations

import numpy as np

UP, LEFT, DIAGONAL = (1, 0), (0, 1), (1, 1)
#: Degrees of a step that marks an orientation artifact, and rows kept after the last such step.
JUMP_DEGREES, JUMP_TAIL = 1.5, 10


def half_up(x: float) -> int:
    """Round half away from zero (non-negative x)."""
    return int(np.floor(x + 0.5))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))


def _diagonals(m: int, n: int):
    for s in range(m + n - 1):
        i = np.arange(max(0, s - n + 1), min(m, s + 1))
        yield i, s - i


def accumulate(cost: np.ndarray, bottleneck: bool = False) -> np.ndarray:
    """Cheapest monotone path to each cell: sum of its costs, or its largest cost."""
    m, n = cost.shape
    acc = np.full((m + 1, n + 1), np.inf)
    acc[0, 0] = -np.inf if bottleneck else 0.0
    join = np.maximum if bottleneck else np.add
    for i, j in _diagonals(m, n):
        before = np.minimum(np.minimum(acc[i, j + 1], acc[i + 1, j]), acc[i, j])
        acc[i + 1, j + 1] = join(before, cost[i, j])
    return acc[1:, 1:]


#: Cells of a plane that is kept whole. A larger program keeps every so many diagonals, and computes those between again
#: on the way back, so its memory grows with the power 1.5 of the lengths.
PLANE_CELLS = 16_000_000
#: The value before the first cell.
START = 0.0


def _sweep(m: int, n: int, cost, step, outside: float, cells: int):
    """(last value, cell -> value) of a program over (m, n) cells, along diagonals. step(up, left, diagonal, cost) gives the values of
    a diagonal from those before; cost(i, j) its local costs; `outside` is the value beyond the first row and column.

    Values are to be asked for in the order of a walk back to the first cell."""
    every = m + n if m * n <= cells else max(2, int(np.sqrt(m + n)))
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def diagonals(first: int, last: int, one: np.ndarray, two: np.ndarray):
        for s in range(first, last):
            i = np.arange(max(0, s - n + 1), min(m, s + 1))
            now = np.full(m + 1, outside)
            now[i + 1] = step(one[i], one[i + 1], two[i], cost(i, s - i))
            if s == 0:
                now[1] = step(np.array([outside]), np.array([outside]), np.array([START]), cost(i, s - i))[0]
            yield s, now
            one, two = now, one

    none = np.full(m + 1, outside)
    one = two = none
    block: dict[int, np.ndarray] = {}
    for s, now in diagonals(0, m + n - 1, one, two):
        if s % every == 0:
            kept[s] = one, two
            block = {}
        block[s] = now
        one, two = now, one

    def value(i: int, j: int) -> float:
        if i < 0 or j < 0:
            return outside
        s = i + j
        if s not in block:
            start = s - s % every
            recent = {k: v for k, v in block.items() if k < start + every + 2}  # a walk compares cells of two diagonals
            block.clear()
            block.update(recent)
            block.update(diagonals(start, min(m + n - 1, start + every), *kept[start]))
        return float(block[s][i + 1])

    return value(m - 1, n - 1), value


def _cheapest(x: np.ndarray, y: np.ndarray, distance, bottleneck: bool = False, order: tuple = (UP, LEFT, DIAGONAL), free_start: bool = False):
    """(x rows, y rows, distances on the path, total) of the cheapest monotone path; among equal predecessors the first of `order`."""

    def cost(i, j):
        d = distance(x[i], y[j])
        if free_start:
            d = np.where((i == 0) & (j == 0), 0.0, d)
        return d

    join = np.maximum if bottleneck else np.add
    total, value = _sweep(len(x), len(y), cost, lambda up, left, diagonal, c: join(np.minimum(np.minimum(up, left), diagonal), c), np.inf, PLANE_CELLS)
    i, j = len(x) - 1, len(y) - 1
    path = [(i, j)]
    while i or j:
        di, dj = min((d for d in order if i >= d[0] and j >= d[1]), key=lambda d: value(i - d[0], j - d[1]))
        i, j = i - di, j - dj
        path.append((i, j))
    rows, columns = np.array(path[::-1]).T
    return rows, columns, distance(x[rows], y[columns]), total


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((p - q) ** 2).sum(-1))


def dtw(x: np.ndarray, y: np.ndarray, free_start: bool = True):
    """(x rows, y rows, distances on the path, total). With free_start the first pair costs nothing."""
    return _cheapest(x, y, _apart, free_start=free_start)


def discrete_frechet(x: np.ndarray, y: np.ndarray):
    return _cheapest(x, y, _apart, bottleneck=True, order=(UP, DIAGONAL, LEFT))


#: Cells of point and edge that are compared at once.
CELLS = 2_000_000


def point_to_polyline(curve: np.ndarray, points: np.ndarray):
    """(foot points, distances, arc-length share of the foot) of each point on a polyline. Points are taken in blocks."""
    step = max(1, CELLS // len(curve))
    parts = [_to_polyline(curve, points[at : at + step]) for at in range(0, len(points), step)] or [_to_polyline(curve, points)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _to_polyline(curve: np.ndarray, points: np.ndarray):
    start, step = curve[:-1], np.diff(curve, axis=0)
    length2 = (step**2).sum(1)
    nearest = distances(points, curve)
    vertex = nearest.argmin(1)
    foot, best = curve[vertex].copy(), nearest[np.arange(len(points)), vertex]
    along = np.concatenate([[0.0], np.cumsum(np.sqrt(length2))])
    at = along[vertex]
    if len(step):
        with np.errstate(invalid="ignore", divide="ignore"):
            t = ((points[:, None, :] - start) * step).sum(-1) / length2
        inside = (t > 0) & (t < 1)
        on = start + np.where(inside, t, 0)[..., None] * step
        d = np.where(inside, np.sqrt(((points[:, None, :] - on) ** 2).sum(-1)), np.inf)
        edge = d.argmin(1)
        row = np.arange(len(points))
        closer = d[row, edge] < best
        foot[closer], best[closer] = on[row, edge][closer], d[row, edge][closer]
        at[closer] = (along[edge] + t[row, edge] * np.sqrt(length2[edge]))[closer]
    return foot, best, at / along[-1] if along[-1] > 0 else np.zeros(len(points))


def lcss(x: np.ndarray, y: np.ndarray, epsilon: float | None = None):
    """(x rows, y rows, distances of matched pairs, score, epsilon). epsilon: one and a half times the largest distance of y from the polyline x."""
    if epsilon is None:
        epsilon = 1.5 * float(point_to_polyline(x, y)[1].max())
    match = lambda i, j: _apart(x[i], y[j]) <= epsilon
    m, n = len(x), len(y)
    total, value = _sweep(m, n, match, lambda up, left, diagonal, hit: np.where(hit, diagonal + 1, np.maximum(up, left)), 0.0, PLANE_CELLS)
    i, j, path = m - 1, n - 1, []
    while i >= 0 and j >= 0:
        if match(i, j):
            path.append((i, j))
            i, j = i - 1, j - 1
        elif value(i - 1, j) > value(i, j - 1):
            i -= 1
        else:
            j -= 1
    rows, columns = np.array(path[::-1], int).reshape(-1, 2).T
    return rows, columns, _apart(x[rows], y[columns]), float(total / min(m, n)), epsilon


#: Cells of diagonals that selective_dtw keeps, at most, before it computes them again on the way back.
KEPT_CELLS = 1_000_000


class _Planes:
    """The three cost planes of selective_dtw along anti-diagonals s = i + j.

    A diagonal is six arrays over i: the planes v, x and y, the distance of the vertices, and the shares of the edges that end at i and at j
    where the other path's point reaches them. Step s needs the two diagonals before and what those local figures are on its own."""

    FIELDS = 6

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.m, self.n = len(x), len(y)
        pad = lambda p: np.vstack([np.zeros((1, p.shape[1])), np.diff(p, axis=0)])
        before = lambda p: np.vstack([p[:1], p[:-1]])
        size = lambda d: np.maximum((d**2).sum(axis=1), np.finfo(float).eps)
        dx, dy = pad(x), pad(y)
        # the second path backwards, so that the cells of a diagonal are slices of both
        self.x, self.x0, self.dx, self.x_size = x.T.copy(), before(x).T.copy(), dx.T.copy(), size(dx)
        self.y, self.y0, self.dy, self.y_size = y[::-1].T.copy(), before(y)[::-1].T.copy(), dy[::-1].T.copy(), size(dy)[::-1].copy()

    def empty(self) -> np.ndarray:
        out = np.full((self.FIELDS, self.m), np.inf)
        out[4:] = np.nan
        return out

    def _local(self, now: np.ndarray, s: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Fill in distances and shares of the cells lo..hi - 1; their distances from the edges that end at i and at j."""
        i, j = slice(lo, hi), slice(self.n - 1 - s + lo, self.n - 1 - s + hi)
        x, y = self.x[:, i], self.y[:, j]
        now[3, i] = np.sqrt(((x - y) ** 2).sum(axis=0))
        t = np.clip(((y - self.x0[:, i]) * self.dx[:, i]).sum(axis=0) / self.x_size[i], 0, 1)
        reach_x = np.sqrt(((y - self.x0[:, i] - t * self.dx[:, i]) ** 2).sum(axis=0))
        now[4, i] = t
        t = np.clip(((x - self.y0[:, j]) * self.dy[:, j]).sum(axis=0) / self.y_size[j], 0, 1)
        reach_y = np.sqrt(((x - self.y0[:, j] - t * self.dy[:, j]) ** 2).sum(axis=0))
        now[5, i] = t
        if lo == 0:
            now[4, 0], reach_x[0] = np.nan, np.inf  # no edge ends at the first point
        if s - hi + 1 == 0:
            now[5, hi - 1], reach_y[-1] = np.nan, np.inf
        return reach_x, reach_y

    def step(self, s: int, one: np.ndarray, two: np.ndarray, codes: bool = False):
        """The diagonal s after the diagonals s - 1 and s - 2; with `codes` also which option each plane's cells took."""
        lo, hi = max(0, s - self.n + 1), min(self.m, s + 1)
        now = self.empty()
        rx, ry = self._local(now, s, lo, hi)
        how = np.zeros((3, self.m), np.int8) if codes else None
        if lo == 0:  # the first row
            now[0, 0] = now[3, 0] + (one[0, 0] if s else 0.0)
            if s:
                now[2, 0] = one[0, 0] + ry[0]
        if s and s - hi + 1 == 0:  # the first column
            now[0, s] = one[0, s - 1] + now[3, s]
        a, b = max(lo, 1), min(hi, s)
        if a >= b:
            return now, how
        here, left, up, back = slice(a, b), one[:, a:b], one[:, a - 1 : b - 1], two[:, a - 1 : b - 1]
        rx, ry = rx[a - lo : b - lo], ry[a - lo : b - lo]
        d, px, py = now[3, here], now[4, here], now[5, here]
        x_here, y_here = (px > 0) & (px < 1), (py > 0) & (py < 1)
        x_left, y_up = (left[4] > 0) & (left[4] < 1), (up[5] > 0) & (up[5] < 1)
        from_x, from_y = np.where(x_left, left[1], np.inf), np.where(y_up, up[2], np.inf)
        with np.errstate(invalid="ignore"):
            options = np.where(left[4] <= px, from_x, np.inf), from_y, up[0]
            cost = self._first(options, how, 1, here)
            now[1, here] = np.where(x_here, rx + cost, np.inf)
            options = from_x, np.where(up[5] <= py, from_y, np.inf), left[0]
            cost = self._first(options, how, 2, here)
            now[2, here] = np.where(y_here, ry + cost, np.inf)
            straight = ~(x_here | y_here | x_left | y_up) & (d <= up[3]) & (d <= left[3]) & (back[3] <= up[3]) & (back[3] <= left[3])
            only = lambda ok, c: np.where(ok, c, np.inf)
            best = now[1, here].copy()  # infinite where no point of the edge is reached
            code = np.zeros(b - a, np.int8)
            for k, c in enumerate(
                (
                    now[2, here],
                    only((d <= left[3]) & ~y_here & ((px < left[4]) | ~x_here), from_x),
                    only((d <= up[3]) & ~x_here & ((py < up[5]) | ~y_here), from_y),
                    only(~y_here, left[0]),
                    only(~x_here, up[0]),
                    only(straight, back[0]),
                ),
                1,
            ):
                less = c < best
                np.copyto(best, c, where=less)
                if codes:
                    code[less] = k
        now[0, here] = best + d
        if codes:
            how[0, here] = code
        return now, how

    @staticmethod
    def _first(options: tuple, how: np.ndarray | None, plane: int, here: slice) -> np.ndarray:
        """The first finite option of each cell."""
        a, b, c = options
        one, two = np.isfinite(a), np.isfinite(b)
        if how is not None:
            how[plane, here] = np.where(one, 0, np.where(two, 1, np.where(np.isfinite(c), 2, 0)))
        return np.where(one, a, np.where(two, b, np.where(np.isfinite(c), c, np.inf)))


def selective_dtw(x: np.ndarray, y: np.ndarray):
    """DTW that may also pair a point with an interior point of the other path's edge.

    Three cost planes: vertex pairs, pairs with a point on the x edge that ends at i, and on the y edge that ends at j.
    An edge plane takes its first admissible predecessor, the vertex plane its cheapest (first on ties). Every move is the
    pair (part of an x step, part of a y step) that the predecessor stands at: 0 is one step back, 1 stays.
    Every so many diagonals are kept, and those between are computed again on the way back, so memory grows with the power 1.5
    of the lengths. Returns (x points, y points, distances, x positions, y positions, row i of each pair)."""
    m, n = len(x), len(y)
    planes = _Planes(np.asarray(x, float), np.asarray(y, float))
    whole = (m + n) * m <= KEPT_CELLS  # short pairs keep every diagonal
    every = max(2, int(np.sqrt(m + n)))
    kept: dict[int, tuple] = {}
    block: dict[int, tuple] = {}
    one = two = planes.empty()
    block[-1] = one, None
    for s in range(m + n - 1):
        if s % every == 0 and not whole:
            kept[s] = one, two
        now, how = planes.step(s, one, two, whole)
        if whole:
            block[s] = now, how
        one, two = now, one

    def diagonal(s: int):
        if s not in block or block[s][1] is None:
            start = s - s % every
            block.clear()
            one, two = kept[start]
            block[start - 1] = one, None  # only its shares are asked for
            for k in range(start, min(m + n - 1, start + every)):
                now, how = planes.step(k, one, two, True)
                block[k] = now, how
                one, two = now, one
        return block[s]

    def move(plane: str, i: int, j: int) -> tuple[float, float]:
        if j == 0:
            return 0.0, 1.0
        if i == 0:
            return 1.0, 0.0
        now, how = diagonal(i + j)
        before = block[i + j - 1][0]
        code = int(how["vxy".index(plane), i])
        if plane != "v":
            return [(before[4, i], 0.0), (0.0, before[5, i - 1]), (0.0, 1.0) if plane == "x" else (1.0, 0.0)][code]
        return [(now[4, i], 1.0), (1.0, now[5, i]), (before[4, i], 0.0), (0.0, before[5, i - 1]), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)][code]

    i, j = m - 1, n - 1
    pairs, rows = [(float(i), float(j))], [i]
    at = "v"
    while i or j:
        a, b = move(at, i, j)
        pairs.append((i - 1 + a, j - 1 + b))
        rows.append(i)
        at = "x" if 0 < a < 1 else "y" if 0 < b < 1 else "v"
        i, j = i - (a == 0), j - (b == 0)
    ix, iy = np.array(pairs[::-1]).T
    px, py = along(x, ix), along(y, iy)
    return px, py, np.sqrt(((px - py) ** 2).sum(1)), ix, iy, np.array(rows[::-1])


def along(path: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Points of a path, or of each of several of one length, at fractional row positions."""
    last = path.shape[-2] - 1
    at = np.clip(at, 0, last)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, last)
    return path[..., low, :] + (at - low)[:, None] * (path[..., high, :] - path[..., low, :])


def slerp(p: np.ndarray, q: np.ndarray, t: np.ndarray, parallel: float) -> np.ndarray:
    """Rows of unit quaternions between rows p and q; nearly parallel ones linearly."""
    c = (p * q).sum(-1)
    q, c = np.where(c[..., None] < 0, -q, q), np.minimum(np.abs(c), 1.0)
    theta = np.arccos(c)
    linear = c > parallel
    sine = np.where(linear, 1.0, np.sin(theta))
    a = np.where(linear, 1 - t, np.sin((1 - t) * theta) / sine)
    b = np.where(linear, t, np.sin(t * theta) / sine)
    out = a[..., None] * p + b[..., None] * q
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


def without_jumps(q: np.ndarray) -> np.ndarray:
    """Orientations with every run of large steps, and the rows just after it, replaced by an arc between its ends."""
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    angle = 2 * np.arccos(np.minimum(np.abs((unit[:-1] * unit[1:]).sum(1)), 1.0))
    jumps = np.flatnonzero(angle > np.radians(JUMP_DEGREES))
    out = q.copy()
    for run in np.split(jumps, np.flatnonzero(np.diff(jumps) > 1) + 1) if len(jumps) else ():
        first, last = max(0, run[0] - 1), min(run[-1] + JUMP_TAIL, len(q) - 1)
        inner = np.arange(first + 1, last)
        if len(inner):
            t = (inner - first) / (last - first)
            out[inner] = slerp(unit[first][None], unit[last][None], t, np.cos(1e-6))
    return out


def quaternion_angles(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Degrees between rows of unit quaternions, from the relative rotation's vector and scalar: exact for small angles, too."""
    a, b = np.moveaxis(p, -1, 0), np.moveaxis(q, -1, 0)
    w = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    x = a[0] * b[1] - a[1] * b[0] - a[2] * b[3] + a[3] * b[2]
    y = a[0] * b[2] + a[1] * b[3] - a[2] * b[0] - a[3] * b[1]
    z = a[0] * b[3] - a[1] * b[2] + a[2] * b[1] - a[3] * b[0]
    return 2 * np.degrees(np.arctan2(np.sqrt(x * x + y * y + z * z), np.abs(w)))


#: Digits of a degree that decide between paths.
COST_DIGITS = 9


def _units(q: np.ndarray) -> np.ndarray:
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def quaternion_distance(nominal: np.ndarray, measured: np.ndarray):
    """(nominal at the measured places, degrees): the cleaned nominal is resampled on the sphere to the measured length."""
    p, q = _units(without_jumps(nominal)), _units(measured)
    at = np.linspace(0, len(p) - 1, len(q)) if len(q) > 1 else np.array([len(p) - 1.0])
    low = np.floor(at).astype(int)
    high = np.minimum(np.ceil(at).astype(int), len(p) - 1)
    between = np.where((low == high)[:, None], p[low], slerp(p[low], p[high], at - low, 0.9995))
    return between, quaternion_angles(between, q)


def quaternion_dtw(nominal: np.ndarray, measured: np.ndarray):
    """The cheapest path by angles to COST_DIGITS digits, so that ties do not hang on a machine's last bit."""
    p, q = _units(without_jumps(nominal)), _units(measured)
    rows, columns, _, total = _cheapest(p, q, lambda a, b: np.round(quaternion_angles(a, b), COST_DIGITS))
    return rows, columns, quaternion_angles(p[rows], q[columns]), total


def pchip(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation of rows y at unit steps, or of each of several y, at fractional positions (Fritsch and Carlson's slopes)."""
    n = y.shape[-2]
    if n < 3:
        return along(y, at)
    delta = np.diff(y, axis=-2)
    left, right = delta[..., :-1, :], delta[..., 1:, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(left * right > 0, 2 * left * right / (left + right), 0.0)
    ends = []
    for a, b in ((delta[..., :1, :], delta[..., 1:2, :]), (delta[..., -1:, :], delta[..., -2:-1, :])):
        e = (3 * a - b) / 2
        e = np.where(e * a <= 0, 0.0, e)
        ends.append(np.where((a * b < 0) & (np.abs(e) > 3 * np.abs(a)), 3 * a, e))
    slope = np.concatenate([ends[0], inner, ends[1]], axis=-2)
    low = np.clip(np.floor(at).astype(int), 0, n - 2)
    s = (at - low)[:, None]
    y0, y1, slope0, slope1 = y[..., low, :], y[..., low + 1, :], slope[..., low, :], slope[..., low + 1, :]
    return (1 + 2 * s) * (1 - s) ** 2 * y0 + s * (1 - s) ** 2 * slope0 + s**2 * (3 - 2 * s) * y1 + s**2 * (s - 1) * slope1


def spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through rows y at unit steps, at fractional positions; the third derivative goes on over the second and the
    last but one point, and three points give a parabola, two a line."""
    n = len(y)
    if n < 4:
        base = np.vander(np.arange(n), increasing=True).astype(float)
        return np.vander(at, n, increasing=True) @ np.linalg.solve(base, y)
    # slopes s: s[i-1] + 4 s[i] + s[i+1] = 3 (y[i+1] - y[i-1]); the ends' equations are s[0] + 2 s[1] = (5 d[0] + d[1]) / 2
    d = np.diff(y, axis=0)
    lower, main, upper = np.ones(n), np.full(n, 4.0), np.ones(n)
    main[0], upper[0], main[-1], lower[-1] = 1.0, 2.0, 1.0, 2.0
    right = np.vstack([(5 * d[0] + d[1]) / 2, 3 * (d[:-1] + d[1:]), (5 * d[-1] + d[-2]) / 2])
    for i in range(1, n):  # elimination of a matrix of three diagonals
        f = lower[i] / main[i - 1]
        main[i] -= f * upper[i - 1]
        right[i] -= f * right[i - 1]
    slope = np.empty_like(right)
    slope[-1] = right[-1] / main[-1]
    for i in range(n - 2, -1, -1):
        slope[i] = (right[i] - upper[i] * slope[i + 1]) / main[i]
    low = np.clip(np.floor(at).astype(int), 0, n - 2)
    s = (at - low)[:, None]
    return (1 + 2 * s) * (1 - s) ** 2 * y[low] + s * (1 - s) ** 2 * slope[low] + s**2 * (3 - 2 * s) * y[low + 1] + s**2 * (s - 1) * slope[low + 1]


def resampled(y: np.ndarray, n: int) -> np.ndarray:
    return y if y.shape[-2] == n else pchip(y, np.linspace(0, y.shape[-2] - 1, n))


def min_max(x: np.ndarray) -> np.ndarray:
    low, span = x.min(-2, keepdims=True), np.ptp(x, axis=-2, keepdims=True)
    return (x - low) / np.where(span < 1e-9, 1.0, span)


def rotation_between(a: np.ndarray, b: np.ndarray, mirror_free: bool = True) -> np.ndarray:
    """Rotation R that best turns centred rows b onto centred rows a (R b = a), without a reflection unless allowed."""
    u, _, vt = np.linalg.svd(b.T @ a)
    r = vt.T @ u.T
    if mirror_free and np.linalg.det(r) < 0:
        vt[-1] *= -1
        r = vt.T @ u.T
    return r


def rotation_aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences centred, b turned onto a by the rotation found after resampling b to a's length."""
    same = resampled(b, len(a))
    ca, cs = a - a.mean(0), same - same.mean(0)
    return ca, (b - b.mean(0)) @ rotation_between(ca, cs).T


def _prepared(a, b, mode, normalise):
    return (min_max(a), min_max(b)) if normalise or mode == "joint" else (a, b)


def constrained_dtw(a: np.ndarray, b: np.ndarray, mode: str = "position", window: float = 0.15, best: float = np.inf, rotate: bool = False, normalise: bool = False) -> float:
    """Sum of point distances of the cheapest path inside a band around the diagonal; `best` if the path must exceed it."""
    a, b = _prepared(a, b, mode, normalise)
    if mode == "position":
        a, b = a - a[0], b - b[0]
        if rotate:
            a, b = rotation_aligned(a, b)
    n, m = len(a), len(b)
    reach = max(half_up(max(n, m) * window), abs(n - m))
    centre = np.floor(np.arange(1, n + 1) * m / n + 0.5).astype(int)
    column = np.arange(1, m + 1)
    inside = np.abs(column[None, :] - centre[:, None]) <= reach
    acc = accumulate(np.where(inside, distances(a, b), np.inf))
    return float(best) if (acc.min(1) > best).any() else float(acc[-1, -1])


#: Cells that constrained_dtw_many has computed in this process, for figures.
COUNTED = {"cells": 0}


def constrained_dtw_many(pairs: list, mode: str = "position", window: float = 0.15, rotate: bool = False, normalise: bool = False, cells: int = 2_000_000, best: np.ndarray | None = None) -> list[float]:
    """constrained_dtw of many pairs: pairs are padded to one size, and each diagonal is one step for all.

    With `best`, a figure to beat for each pair, pairs that can no longer come below or up to it leave the batch, and are infinite: every path
    crosses one of any two neighbouring diagonals."""
    out: list[float] = []
    limits = np.full(len(pairs), np.inf) if best is None else np.asarray(best, float)
    ready = []
    for a, b in pairs:
        a, b = _prepared(a, b, mode, normalise)
        if mode == "position":
            a, b = a - a[0], b - b[0]
            if rotate:
                a, b = rotation_aligned(a, b)
        ready.append((a, b))
    at = 0
    while at < len(ready):
        n = m = 0
        end = at
        while end < len(ready):  # as many pairs as fit
            wider = max(n, len(ready[end][0])), max(m, len(ready[end][1]))
            if end > at and wider[0] * wider[1] * (end - at + 1) > cells:
                break
            (n, m), end = wider, end + 1
        part = ready[at:end]
        x, y = np.zeros((len(part), n, part[0][0].shape[1])), np.zeros((len(part), m, part[0][1].shape[1]))
        for row, (a, b) in enumerate(part):
            x[row, : len(a)], y[row, : len(b)] = a, b
        sizes = np.array([(len(a), len(b)) for a, b in part])
        ns, ms = sizes[:, 0, None], sizes[:, 1, None]
        reach = np.maximum(np.floor(np.maximum(ns, ms) * window + 0.5), np.abs(ns - ms))
        centre = np.floor(np.arange(1, n + 1) * ms / ns + 0.5)
        inside = np.abs(np.arange(1, m + 1) - centre[:, :, None]) <= reach[:, :, None]
        cost = np.where(inside, np.sqrt(sum((x[:, :, None, d] - y[:, None, :, d]) ** 2 for d in range(x.shape[2]))), np.inf)
        out += _banded(cost, sizes, limits[at:end]).tolist()
        at = end
    return out


def _banded(cost: np.ndarray, sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The cheapest path's cost of each plane of local costs, by diagonals of which only two are kept."""
    count, n, m = cost.shape
    found, live = np.full(count, np.inf), np.arange(count)
    one = two = np.full((count, n + 1), np.inf)
    last = sizes.sum(axis=1) - 2
    bounded = np.isfinite(limits).any()
    for s, (i, j) in enumerate(_diagonals(n, m)):
        now = np.full((len(live), n + 1), np.inf)
        before = np.minimum(np.minimum(one[:, i], one[:, i + 1]), two[:, i])
        if s == 0:
            before[:, 0] = 0.0
        now[:, i + 1] = cost[live[:, None], i, j] + before
        COUNTED["cells"] += len(live) * len(i)
        ended = last[live] == s
        if ended.any():
            found[live[ended]] = now[ended, sizes[live[ended], 0]]
        stay = ~ended
        if bounded and s:
            stay &= np.minimum(now.min(axis=1), one.min(axis=1)) <= limits[live]
        if not stay.all():
            live, now, one = live[stay], now[stay], one[stay]
            if not len(live):
                break
        one, two = now, one
    return found


def resampled_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Frobenius distance after linear resampling to a's length and removal of the first points."""
    b = along(b, np.linspace(0, len(b) - 1, len(a)))
    return float(np.linalg.norm((a - a[0]) - (b - b[0])))


def _gap(a, b, mode):
    d = np.abs(a - b)
    return (np.minimum(d, 2 * np.pi - d) if mode == "joint" else d) ** 2


def kim_bound(a: np.ndarray, b: np.ndarray, mode: str = "position", rotate: bool = False, normalise: bool = False, translate: bool = False) -> float:
    """Largest distance between first points, last points, minima and maxima. Heuristic: it removes no translation unless `translate`."""
    if len(a) < 2 or len(b) < 2:
        return float("inf")
    a, b = _prepared(a, b, mode, normalise)
    b = resampled(b, len(a))
    if translate:
        a, b = a - a[0], b - b[0]
    if rotate and mode == "position":
        a, b = rotation_aligned(a, b)
    pairs = ((a[0], b[0]), (a[-1], b[-1]), (a.min(0), b.min(0)), (a.max(0), b.max(0)))
    return float(np.sqrt(max(_gap(x, y, mode).sum() for x, y in pairs)))


def bound_as_is(a: np.ndarray, b: np.ndarray, dims: int = 3) -> float:
    """Kim's bound of sequences of any lengths, as they are."""
    return float(of_pairs("bound_as_is", a[None], b[None], np.zeros(1, int), np.zeros(1, int), dims=dims)[0])


def moved_bound(a: np.ndarray, b: np.ndarray, dims: int = 3) -> float:
    """bound_as_is of sequences less their first points."""
    return bound_as_is(a - a[0], b - b[0], dims)


def keogh_bound(query: np.ndarray, candidate: np.ndarray, mode: str = "position", window: float = 0.15, rotate: bool = False, normalise: bool = False, translate: bool = False) -> float:
    """How far the query leaves the candidate's moving envelope."""
    query, candidate = _prepared(query, candidate, mode, normalise)
    candidate = resampled(candidate, len(query))
    if translate:
        query, candidate = query - query[0], candidate - candidate[0]
    if rotate and mode == "position":
        query, candidate = rotation_aligned(query, candidate)
    reach = half_up(len(query) * window)
    padded = lambda fill: np.pad(candidate, ((reach, reach), (0, 0)), constant_values=fill)
    view = np.lib.stride_tricks.sliding_window_view
    high, low = view(padded(-np.inf), 2 * reach + 1, 0).max(-1), view(padded(np.inf), 2 * reach + 1, 0).min(-1)
    over, under = query > high, query < low
    return float(np.sqrt((over * _gap(query, np.where(over, high, query), mode)).sum() + (under * _gap(query, np.where(under, low, query), mode)).sum()))


#: Pairs of one step of the measures of many pairs: what a step holds stays in the cache.
PAIRS_AT_ONCE = {"constrained_dtw": 1024, "kim_bound": 1 << 15, "moved_bound": 1 << 15, "bound_as_is": 1 << 15, "keogh_bound": 256, "resampled_distance": 512}
#: Diagonals after which pairs that cannot come up to their limit leave the batch.
LOOK_AGAIN = 8


def of_pairs(measure: str, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, best: np.ndarray | None = None, **options) -> np.ndarray:
    """constrained_dtw, kim_bound, moved_bound, bound_as_is, keogh_bound or resampled_distance of a[i] and b[j], sequences of one length a side; `best` as in
    constrained_dtw_many. What belongs to one sequence alone is made once, and pairs take steps together."""
    if options.get("rotate"):
        limits = {} if best is None else {"best": best}
        return np.array([globals()[measure](a[p], b[q], **options, **{k: v[at] for k, v in limits.items()}) for at, (p, q) in enumerate(zip(i, j))], float)
    made = {"constrained_dtw": _dtw_of, "kim_bound": _kim_of, "moved_bound": _moved_of, "bound_as_is": _extremes_of, "keogh_bound": _keogh_of, "resampled_distance": _resampled_of}[measure](a, b, **options)
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS_AT_ONCE[measure]):
        few = slice(s, s + PAIRS_AT_ONCE[measure])
        out[few] = made(i[few], j[few]) if best is None else made(i[few], j[few], best[few])
    return out


def _band(n: int, m: int, window: float) -> list[tuple[int, int]]:
    """First row and one past the last row of each diagonal inside the band of constrained_dtw, where they follow each other."""
    reach = max(half_up(max(n, m) * window), abs(n - m))
    rows = np.arange(n)
    turn = rows + np.floor(np.arange(1, n + 1) * m / n + 0.5).astype(int) - 1  # rises from row to row
    s = np.arange(n + m - 1)
    lo = np.maximum(np.searchsorted(turn, s - reach), np.maximum(0, s - m + 1))
    hi = np.minimum(np.searchsorted(turn, s + reach, side="right"), np.minimum(n, s + 1))
    return [(a, b) if a < b else (0, 0) for a, b in zip(lo.tolist(), hi.tolist())]


def _dtw_of(a, b, mode: str = "position", window: float = 0.15, rotate: bool = False, normalise: bool = False):
    a, b = _prepared(a, b, mode, normalise)
    if mode == "position":
        a, b = a - a[:, :1], b - b[:, :1]
    ends = _band(a.shape[1], b.shape[1], window)
    a, b = np.ascontiguousarray(a.transpose(2, 1, 0)), np.ascontiguousarray(b[:, ::-1].transpose(2, 1, 0))

    def run(i, j, limits=None):
        return _along_diagonals(np.take(a, i, axis=2), np.take(b, j, axis=2), ends, limits)  # pairs side by side in memory

    return run


def _along_diagonals(x: np.ndarray, y: np.ndarray, ends: list, limits: np.ndarray | None) -> np.ndarray:
    """The cheapest path's cost of every pair x, y (dimension, place, pair; y from its end) inside the rows `ends` of each diagonal. The rows move
    on by one at most, so what a diagonal reads beyond the ends of those before it is the one place that was made infinite."""
    d, n, count = x.shape
    m = y.shape[1]
    found, live = np.full(count, np.inf), np.arange(count)
    one, two, now = (np.full((n + 2, count), np.inf) for _ in range(3))
    cost, other = np.empty((n, count)), np.empty((n, count))
    for s, (lo, hi) in enumerate(ends):
        if lo == hi:
            now[:] = np.inf
        else:
            c, t, at = cost[: hi - lo], other[: hi - lo], m - 1 - s + lo
            np.subtract(x[0, lo:hi], y[0, at : at + hi - lo], out=c)
            np.multiply(c, c, out=c)
            for k in range(1, d):
                np.subtract(x[k, lo:hi], y[k, at : at + hi - lo], out=t)
                np.multiply(t, t, out=t)
                np.add(c, t, out=c)
            np.sqrt(c, out=c)
            if s:
                np.minimum(one[lo:hi], one[lo + 1 : hi + 1], out=t)
                np.minimum(t, two[lo:hi], out=t)
                np.add(c, t, out=now[lo + 1 : hi + 1])
            else:
                now[1] = c[0]
            now[lo], now[hi + 1] = np.inf, np.inf
        one, two, now = now, one, two
        if limits is not None and s % LOOK_AGAIN == LOOK_AGAIN - 1 and s < n + m - 2:
            before = ends[s - 1]
            least = np.minimum(one[lo + 1 : hi + 1].min(0, initial=np.inf), two[before[0] + 1 : before[1] + 1].min(0, initial=np.inf))
            stay = least <= limits
            if stay.sum() < 0.8 * len(live):
                live, limits = live[stay], limits[stay]
                x, y, one, two, now, cost, other = (np.compress(stay, z, axis=-1) for z in (x, y, one, two, now, cost, other))
                if not len(live):
                    return found
    found[live] = one[n]
    return found


def _kim_of(a, b, mode: str = "position", rotate: bool = False, normalise: bool = False, translate: bool = False):
    n = a.shape[1]
    if n < 2 or b.shape[1] < 2:
        return lambda i, j: np.full(len(i), np.inf)
    a, b = _prepared(a, b, mode, normalise)
    b = resampled(b, n)
    return _extremes_of(a - a[:, :1], b - b[:, :1], mode=mode) if translate else _extremes_of(a, b, mode=mode)


def _moved_of(a, b, dims: int = 3):
    return _extremes_of(a - a[:, :1], b - b[:, :1], dims)


def _extremes_of(a, b, dims: int | None = None, mode: str = "position"):
    """Largest distance between first points, last points, minima and maxima (of the first `dims` coordinates), whatever the lengths."""
    p, q = (np.ascontiguousarray(np.stack([x[:, 0], x[:, -1], x.min(1), x.max(1)])[:, :, :dims].transpose(0, 2, 1)) for x in (a, b))

    def run(i, j):
        best = np.zeros(len(i))
        for x, y in zip(p, q):
            np.maximum(best, sum(_gap(u[i], v[j], mode) for u, v in zip(x, y)), out=best)
        return np.sqrt(best)

    return run


def _extreme(x: np.ndarray, reach: int, pick) -> np.ndarray:
    """The extreme of the places within reach along axis 1, by windows that double."""
    n, width = x.shape[1], 2 * reach + 1
    fill = -np.inf if pick is np.maximum else np.inf
    w, size = np.pad(x, ((0, 0), (reach, reach), (0, 0)), constant_values=fill), 1
    while 2 * size <= width:
        w, size = pick(w[:, : w.shape[1] - size], w[:, size:]), 2 * size
    return pick(w[:, :n], w[:, width - size : width - size + n])


def _keogh_of(a, b, mode: str = "position", window: float = 0.15, rotate: bool = False, normalise: bool = False, translate: bool = False):
    n = a.shape[1]
    a, b = _prepared(a, b, mode, normalise)
    b = resampled(b, n)
    if translate:
        a, b = a - a[:, :1], b - b[:, :1]
    reach = half_up(n * window)
    high, low = _extreme(b, reach, np.maximum), _extreme(b, reach, np.minimum)

    def run(i, j):
        x = a[i]
        gap = _gap(x, np.minimum(np.maximum(x, low[j]), high[j]), mode)
        return np.sqrt(gap.reshape(len(i), -1).sum(1))

    return run


def _resampled_of(a, b):
    b = along(b, np.linspace(0, b.shape[1] - 1, a.shape[1]))
    a, b = a - a[:, :1], b - b[:, :1]

    def run(i, j):
        gap = a[i] - b[j]
        gap *= gap
        return np.sqrt(gap.reshape(len(i), -1).sum(1))

    return run


def smooth(x: np.ndarray, degree: int, width: int) -> np.ndarray:
    """Local polynomial smoothing of rows; end rows take the values of the first and the last full window's polynomial."""
    half = width // 2
    v = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    project = v @ np.linalg.pinv(v)
    out = np.empty(x.shape)
    windows = np.lib.stride_tricks.sliding_window_view(x, width, 0)
    out[half : len(x) - half] = windows @ project[half]
    out[:half], out[len(x) - half :] = (project @ x[:width])[:half], (project @ x[-width:])[half + 1 :]
    return out


def _odd_window(n: int) -> int:
    """33 at most, odd, and not above n."""
    return min(33, n if n % 2 else n - 1)


def velocity_embedding(points: np.ndarray, coarse: int, fine: int) -> np.ndarray:
    """Unit vector of the smoothed velocity's two resamplings; zeros under ten points."""
    if len(points) < 10:
        return np.zeros((coarse + fine) * points.shape[1] if points.ndim == 2 else (coarse + fine) * 3)
    path = smooth(points, 3, _odd_window(len(points)))
    speed = np.diff(path, axis=0) * (len(points) - 1)
    speed = smooth(speed, 2, _odd_window(len(speed)))
    parts = []
    for n in (coarse, fine):
        if n > 0:
            rows = np.vstack([speed, np.repeat(speed[-1:], n - len(speed), 0)]) if len(speed) <= n else along(speed, np.linspace(0, len(speed) - 1, n))
            parts.append(rows.T.ravel())
    v = np.concatenate(parts)
    size = np.linalg.norm(v)
    return v / size if size > 1e-10 else v


def mean_quaternion(outer: np.ndarray) -> np.ndarray:
    """Mean orientation from the 4x4 sum of outer products: its main eigenvector, with a non-negative first component."""
    q = np.linalg.eigh(outer)[1][:, -1]
    return -q if q[0] < 0 else q


def rigid_fit(count: float, sum_x: np.ndarray, sum_y: np.ndarray, sum_xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) with x R + t = y in the least-squares sense, from sums alone; sum_xy is the sum of x' y."""
    mx, my = sum_x / count, sum_y / count
    u, _, vt = np.linalg.svd(sum_xy - count * np.outer(mx, my))
    r = u @ vt
    return r, my - mx @ r
