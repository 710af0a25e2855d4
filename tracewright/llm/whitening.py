"""Embedding whitening by singular values of the centred rows, never of a covariance product.

Entries become integers (scaled, floored, shifted), so sums and deviations are exact. Each task centres its rows and folds
them, block by block, into one triangular factor; factors meet in a tree whose nodes are tasks of their own, and one factor of
(dimensions)^2 numbers reaches the driver. There Householder reflections make it bidiagonal, the dqds iteration finds the
singular values, and twisted factorisations of the shifted tridiagonal give the right singular vectors, that is the
components of the covariance: their eigenvalue is the squared singular value over the number of rows. Rows are then
projected in Arrow batches.

Defined cases: vectors that are null or empty, or hold null or non-finite entries, are dropped; rows with a null or repeated
id are rows like others; vectors of different lengths are fitted apart, each length with its own n, sums and components; components of no
variance (rank below `components`, one row alone, equal rows) have no whitened value and no row; an exact deviation that no
long can hold is null; a component's entry of largest size is positive; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Rows folded into a factor at once, and factors that one node of the tree joins.
BLOCK_ROWS, FAN_IN = 4096, 32
#: A singular value below this share of the largest is none.
NO_VARIANCE = 1e-11
EPS = np.finfo(float).eps


# ---- singular values and vectors of one triangular factor


def triangular(blocks: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of the stacked rows, square (rows of zeros complete a low one)."""
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): r = U B V', B with diagonal a and superdiagonal b, by Householder reflections from both sides."""
    m, n = r.astype(float).copy(), len(r)
    v = np.eye(n)
    for k in range(n):
        _reflect(m[k:, k:])
        if k < n - 2:
            w = _reflect(m[k:, k + 1 :].T)
            if w is not None:
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, 2 * w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflect(m: np.ndarray) -> np.ndarray | None:
    """Turn the first column of m, in place, into a multiple of the first unit vector; the unit reflection vector."""
    x = m[:, 0]
    if len(x) < 2 or not np.any(x[1:]):
        return None
    w = x / np.abs(x).max()
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    w /= np.linalg.norm(w)
    m -= np.outer(2 * w, w @ m)
    m[1:, 0] = 0
    return w


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values, falling, of the upper bidiagonal matrix with diagonal a and superdiagonal b.

    Differential quotient-difference sweeps with shifts from below; a shift that makes a quotient negative was too large
    and is tried again smaller. Small off-diagonal quotients split the problem."""
    found, todo = [], [(np.asarray(a, float) ** 2, np.asarray(b, float) ** 2, 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        guess = 0.0
        while len(q) > 1:
            small = np.flatnonzero(e <= EPS**2 * (shifted + np.minimum(q[:-1], q[1:])) + np.finfo(float).tiny)
            if len(small):
                cut = int(small[-1])
                if cut < len(e) - 1 or cut > 0 and len(small) > 1:
                    todo.append((q[: cut + 1], e[:cut], shifted))
                    q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                else:
                    found.append(shifted + q[-1])
                    q, e, guess = q[:-1], e[:-1], 0.0
                continue
            if q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            tried = guess
            while True:
                new_q, new_e, least = _sweep(q, e, tried)
                if least >= 0 or tried == 0:
                    break
                tried = tried / 4 if tried > EPS * q.max() else 0.0
            q, e, shifted, guess = new_q, new_e, shifted + tried, max(0.0, _below(new_q, new_e, least))
        found.extend(shifted + q)
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds transform and the least of its differences; negative or undefined differences say that the shift was too large."""
    qs, es = q.tolist(), e.tolist()
    d = least = qs[0] - shift
    for i in range(len(es)):
        qs[i], follow = d + es[i], qs[i + 1]
        if qs[i] <= 0:
            if shift:
                return q, e, -1.0
            es[i], d = 0.0, follow
        else:
            ratio = follow / qs[i]
            es[i], d = es[i] * ratio, d * ratio - shift
        least = min(least, d)
    qs[-1] = d
    return np.array(qs), np.array(es), least if least == least else -1.0


def _below(q: np.ndarray, e: np.ndarray, least: float) -> float:
    """A likely lower bound of the smallest value: the trailing two by two block's, and never above the least difference."""
    p, r, s = q[-2], q[-1], e[-1]
    half = (p + s + r) / 2
    corner = p * r / (half + np.sqrt(max(0.0, half * half - p * r))) if half > 0 else 0.0
    return 0.98 * min(corner, least) if least > 0 else 0.0


def twisted(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit right singular vector of the bidiagonal matrix for a squared singular value.

    The stationary factorisation from above and the progressive one from below of B'B - value meet where the twist is
    least; vectors of `others` (of near values) are taken out."""
    n = len(a)
    size = max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)
    d, l = (a * a).tolist(), (b / a[:-1]).tolist()
    tiny = EPS * EPS * size * size
    safe = lambda x: x if abs(x) > tiny else tiny
    down, s = [0.0] * (n - 1), [-value] * n
    for i in range(n - 1):
        down[i] = d[i] * l[i] / safe(s[i] + d[i])
        s[i + 1] = down[i] * l[i] * s[i] - value
    up, p = [0.0] * (n - 1), [d[-1] - value] * n
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * l[i] * l[i] + p[i + 1])
        up[i], p[i] = l[i] * t, p[i + 1] * t - value
    twist = np.abs(np.array(s) + np.array(p) + value)
    for r in np.argsort(twist, kind="stable"):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        z /= np.abs(z).max()
        z /= np.linalg.norm(z)
        for _ in range(2):
            for o in others:
                z -= (o @ z) * o
        left = np.linalg.norm(z)
        if left > 0.1:  # else the cluster's other vectors had it all: twist elsewhere
            return z / left
    return z


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance r'r / n, falling, without those of no variance."""
    a, b, v = bidiagonal(r)
    values = dqds(a, b)
    kept = [x for x in values[:most] if x > NO_VARIANCE * max(values[0], np.finfo(float).tiny)]
    vectors: list[np.ndarray] = []
    for k, x in enumerate(kept):
        near = [vectors[j] for j in range(k) if abs(kept[j] - x) <= 1e-3 * x]
        vectors.append(twisted(a, b, x * x, near))
    w = v @ np.array(vectors).T if vectors else np.zeros((len(r), 0))
    w /= np.linalg.norm(w, axis=0)
    w *= np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    return w, np.array(kept) ** 2 / n, float((r**2).sum() / n)


# ---- rows


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double), d (its length): the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"), F.size(v).alias("d")).where("d > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def _matrices(batch: pa.RecordBatch, v: int, d: int):
    """(length, row numbers, integer matrix) for each vector length of an Arrow batch."""
    lengths = batch.column(d).to_numpy()
    flat = np.floor(SCALE * batch.column(v).flatten().to_numpy()).astype(np.int64) + SHIFT
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[starts[rows][:, None] + np.arange(length)]


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """length -> (n, sum of each dimension) over all rows, as integers."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0, 1):
                had = total.setdefault(length, [0, np.zeros(length, np.int64)])
                had[0] += len(x)
                had[1] += x.sum(axis=0)
        for length, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(length, length)), pa.array(np.arange(length)), pa.array(np.full(length, n)), pa.array(s)], ["d", "at", "n", "s"])

    parts = rows.select("v", "d").mapInArrow(run, "d long, at long, n long, s long")
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for r in parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "at").collect():
        sums.setdefault(r.d, (r.n, np.zeros(r.d, np.int64)))[1][r.at] = r.s
    return sums


def factors(rows: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """length -> triangular factor of all centred rows of that length."""
    means = rows.sparkSession.sparkContext.broadcast({d: s / n for d, (n, s) in sums.items()})

    def run(batches):
        had: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _matrices(batch, 0, 1):
                for at in range(0, len(x), BLOCK_ROWS):
                    centred = x[at : at + BLOCK_ROWS] - means.value[length]
                    had[length] = triangular([had[length], centred] if length in had else [centred])
        yield pa.RecordBatch.from_arrays([pa.array(list(had), pa.int64()), pa.array([r.tobytes() for r in had.values()], pa.binary())], ["d", "r"])

    def join(key, table):
        d = key[0].as_py()
        r = triangular([np.frombuffer(x, float).reshape(d, d) for x in table.column("r").to_pylist()])
        return pa.table({"d": pa.array([d], pa.int64()), "r": pa.array([r.tobytes()], pa.binary()), "node": pa.array([key[1].as_py() // FAN_IN], pa.int64())})

    node = F.monotonically_increasing_id()  # one factor a length and task: the high half numbers tasks
    parts = rows.select("v", "d").mapInArrow(run, "d long, r binary").withColumn("node", F.shiftright(node, 33) * 1)
    parts = common.written(parts, "factors")
    count = int(parts.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]) + 1
    parts = parts.withColumn("node", F.floor(F.col("node") / FAN_IN))
    while count > 1:
        parts = parts.groupBy("d", "node").applyInArrow(join, "d long, r binary, node long")
        count = -(-count // FAN_IN)
    return {r.d: np.frombuffer(r.r, float).reshape(r.d, r.d) for r in parts.collect()}


class Fit:
    """n, sums, whitening directions (components over the roots of their eigenvalues) and shares of one vector length."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray, most: int = COMPONENTS):
        vectors, values, trace = components(r, n, most)
        self.n, self.sums = n, sums
        self.directions, self.explained = vectors / np.sqrt(values), values / trace if trace else values

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; None where no long can hold it."""
        far = max(int(self.n * x.max() - self.sums.min()), int(self.sums.max() - self.n * x.min()), 1) if len(x) else 1
        if len(self.sums) * far**2 < 1 << 63:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1)
        return [y if y < 1 << 63 else None for y in exact]


def whiten(df: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of df and component.

    Whitened rows are written once: the identity error is measured on them, over all rows, and is the same value in each row."""
    rows = usable(df, id_col, vector_col)
    spark = df.sparkSession
    sums = exact_sums(rows)
    found = factors(rows, sums) if sums else {}
    fits = {d: Fit(n, s, found[d], most) for d, (n, s) in sums.items()}
    shared = spark.sparkContext.broadcast(fits)  # a few vectors a length
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, d int, n long, deviation long, whitened array<double>, explained array<double>"
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for length, at, x in _matrices(batch, 1, 2):
                fit = shared.value[length]
                w = (x - fit.sums / fit.n) @ fit.directions
                columns = [batch.column(0).take(pa.array(at)), np.full(len(x), length), np.full(len(x), fit.n), fit.deviations(x), list(w), [fit.explained] * len(x)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, out.field(i).type) for i, c in enumerate(columns)], schema=out)

    white = common.written(rows.mapInArrow(run, schema), "whitened")
    errors = identity_errors(white)
    error = F.coalesce(*[F.when(F.col("d") == d, F.lit(x)) for d, x in errors.items()], F.lit(None).cast("double"))
    each = white.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), error.alias("identity_error"))


def identity_errors(white: DataFrame) -> dict[int, float]:
    """length -> largest entry of |covariance of the whitened rows - identity|, summed over all rows in two passes: means first."""

    def sums(batches, means):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            sizes = np.asarray(batch.column(1).value_lengths())
            flat, starts = batch.column(1).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for d in np.unique(lengths[sizes > 0]).tolist():
                at = np.flatnonzero(lengths == d)
                w = flat[starts[at][:, None] + np.arange(sizes[at[0]])]
                part = np.append(w.sum(axis=0), len(w)) if means is None else ((w - means[d]).T @ (w - means[d])).ravel()
                total[d] = total.get(d, 0) + part
        for d, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d)), pa.array(np.arange(len(x))), pa.array(x)], ["d", "at", "s"])

    def run(means=None):
        parts = white.select("d", "whitened").mapInArrow(lambda batches: sums(batches, means), "d long, at long, s double")
        out: dict[int, list] = {}
        for r in parts.groupBy("d", "at").agg(F.sum("s").alias("s")).orderBy("d", "at").collect():
            out.setdefault(r.d, []).append(r.s)
        return {d: np.array(x) for d, x in out.items()}

    totals = run()
    n = {d: x[-1] for d, x in totals.items()}
    products = run({d: x[:-1] / x[-1] for d, x in totals.items()})
    return {d: float(np.abs(x.reshape(int(len(x) ** 0.5), -1) / n[d] - np.eye(int(len(x) ** 0.5))).max()) for d, x in products.items()}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op11: each row's id, n and exact deviation."""
    return op11_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


BASE_SQL = """
WITH x AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT + 100000) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  e AS (SELECT rid, vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM x),
  s AS (SELECT i, sum(x) AS s, count(*) AS n FROM e GROUP BY i)
SELECT vec_id, n, sum((n::HUGEINT * x - s) * (n::HUGEINT * x - s))::BIGINT AS deviation FROM e JOIN s USING (i) GROUP BY rid, vec_id, n"""
