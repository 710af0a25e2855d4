"""Vectors against vectors in blocks: the k nearest rows of every query, or all distances, by array operations.

Both sides are dealt in blocks of bounded size, and each pair of blocks is one call that holds nothing else. A matrix product finds what
can be among the k nearest; only that is measured as vectors.dot and vectors.norm do it, term by term in order, so the distances are
those of the expressions to the last bit. A block hands on few rows a query, of equal distances no more than k."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.vectors import COSINE_GUARD
from . import series

#: Most bytes of vectors in a block of queries and of rows; fewest rows that are worth a block; entries of a matrix of all distances;
#: queries and rows of a product, which stays in the cache; queries and rows of a block whose pairs are all handed on.
QUERY_BYTES, ROW_BYTES, LEAST_ROWS, ENTRIES, QUERIES_AT_ONCE, ROWS_AT_ONCE, QUERIES_OF_PAIRS, ROWS_OF_PAIRS = 8 << 20, 24 << 20, 1000, 1 << 17, 64, 2048, 512, 2048
#: Most bytes of queries that go to all rows at once, and rows of a task that they meet.
MOST_SHARED_BYTES, ROWS_OF_TASK = 32 << 20, 10_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def measured(q: np.ndarray, r: np.ndarray, qn: np.ndarray, rn: np.ndarray, measure: str) -> np.ndarray:
    """Distances of the last axes of q and r, summed up in their order."""
    total = np.zeros(np.broadcast_shapes(q.shape[:-1], r.shape[:-1]))
    for j in range(q.shape[-1]):
        term = q[..., j] * r[..., j] if measure == "cosine" else q[..., j] - r[..., j]
        total += term if measure == "cosine" else term * term
    return 1 - total / (rn * qn + COSINE_GUARD) if measure == "cosine" else np.sqrt(total)


def _all(q: np.ndarray, r: np.ndarray, measures: list[str]) -> dict[str, np.ndarray]:
    """Several distances of every query and row, component by component."""
    shape = (len(q), len(r))
    start = {"chebyshev": 0.0, "smallest": np.inf}
    out = {m: np.full(shape, start.get(m, 0.0)) for m in measures}
    for j in range(q.shape[1]):
        gap = np.abs(q[:, j, None] - r[None, :, j])
        for m, total in out.items():
            if m == "euclidean":
                total += gap * gap
            elif m == "manhattan":
                total += gap
            elif m == "angular":
                turned = np.minimum(gap, 2 * np.pi - gap)
                total += turned * turned
            else:
                (np.maximum if m == "chebyshev" else np.minimum)(total, gap, out=total)
    return {m: np.sqrt(total) if m in ("euclidean", "angular") else total for m, total in out.items()}


#: Measures that all_distances() has, as in functions.vectors ('smallest' is the smallest difference).
MEASURES = ("euclidean", "manhattan", "chebyshev", "smallest", "angular")


def all_distances(queries: DataFrame, rows: DataFrame, measures: list[str]) -> DataFrame:
    """query_id, id and a column for each of MEASURES that is asked for: every query with every row, its own too."""
    if unknown := set(measures) - set(MEASURES):
        raise ValueError(unknown)
    kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, " + ", ".join(f"{m} double" for m in measures)

    def made(left: pa.Table, right: pa.Table):
        """Tables of a query with ROWS_AT_ONCE rows at most."""
        lw, rw = _widths(left, "query_vec"), _widths(right, "vec")
        for d in np.intersect1d(lw, rw):
            a, b = left.filter(pa.array(lw == d)), right.filter(pa.array(rw == d))
            x, y = _matrix(a.column("query_vec")), _matrix(b.column("vec"))
            for s in range(len(x)):
                for t in range(0, len(y), ROWS_AT_ONCE):
                    few = b.column("id").slice(t, ROWS_AT_ONCE).combine_chunks()
                    found = _all(x[s : s + 1], y[t : t + ROWS_AT_ONCE], measures)
                    yield pa.table({"query_id": a.column("query_id").take(pa.array(np.full(len(few), s))), "id": few, **{m: v.ravel() for m, v in found.items()}})

    asked = _usable(queries, "query_id", "query_vec")
    if asked.agg(F.coalesce(F.sum(_bytes("query_vec")), F.lit(0))).first()[0] <= MOST_SHARED_BYTES:  # queries go to the rows, and no row is shuffled more than once
        shared = rows.sparkSession.sparkContext.broadcast(asked.toArrow())

        def meet(batches):
            for batch in batches:
                for table in made(shared.value, pa.Table.from_batches([batch])):
                    yield from table.combine_chunks().to_batches()

        known = _usable(rows, "id", "vec")
        return known.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-known.count() // ROWS_OF_TASK)), "id").mapInArrow(meet, schema)
    q, r = _dealt(queries, rows, [], [], True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), **{m: pa.array([], pa.float64()) for m in measures}}
        return pa.concat_tables([pa.table(empty), *made(left, right)])

    return q.groupBy("q__", "r__").cogroup(r.groupBy("q__", "r__")).applyInArrow(run, schema)


def _usable(df: DataFrame, key: str, c: str, *others: str) -> DataFrame:
    return df.select(key, F.col(c).cast("array<double>").alias(c), *others).where(f"{c} is not null and not exists({c}, x -> x is null)")


def _bytes(c: str) -> Column:
    return F.size(c) * 8 + 32


def _widths(table: pa.Table, c: str) -> np.ndarray:
    return np.diff(table.column(c).combine_chunks().offsets.to_numpy()) if len(table) else np.zeros(0, int)


def _dealt(queries: DataFrame, rows: DataFrame, asked: list[str], extra: list[str], every_pair: bool) -> tuple[DataFrame, DataFrame]:
    """Queries and rows with the numbers q__ and r__ of the pairs of blocks that they belong to, by the bytes of both sides and, if every pair
    is handed on, by their number."""
    q, r = _usable(queries, "query_id", "query_vec", *asked), _usable(rows, "id", "vec", *extra)
    size = lambda df, c: df.agg(F.count("*"), F.coalesce(F.sum(_bytes(c)), F.lit(0))).first()
    (m, q_bytes), (n, r_bytes) = size(q, "query_vec"), size(r, "vec")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 2)
    q_blocks = max(1, -(-q_bytes // QUERY_BYTES))
    r_blocks = max(-(-r_bytes // ROW_BYTES), min(-(-tasks // q_blocks), n // LEAST_ROWS), 1)
    if every_pair:
        q_blocks, r_blocks = max(q_blocks, -(-m // QUERIES_OF_PAIRS)), max(r_blocks, -(-n // ROWS_OF_PAIRS))
    own = lambda c, m: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = q.withColumn("q__", own("query_id", q_blocks)).withColumn("r__", every(r_blocks))
    return q, r.withColumn("r__", own("id", r_blocks)).withColumn("q__", every(q_blocks))


def _at_most(x: np.ndarray, y: np.ndarray, distance: np.ndarray, k: int, ids: np.ndarray, slack: float):
    """(query, row, distance) without what is farther than a query's k-th, and of equal distances no more than k, by ids."""
    order = np.lexsort((ids[y], distance, x))
    x, y, distance = x[order], y[order], distance[order]
    place = np.arange(len(x))
    head = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    fresh = head | np.r_[True, distance[1:] != distance[:-1]] if len(x) else head
    start = np.maximum.accumulate(np.where(head, place, 0))
    kth = distance[np.minimum(start + k - 1, len(x) - 1)]  # of the next query, where there are fewer: then all stay
    own_kth = x[np.minimum(start + k - 1, len(x) - 1)] == x
    stay = (place - np.maximum.accumulate(np.where(fresh, place, 0)) < k) & (~own_kth | ~(distance > kth + 1.01 * slack))
    return x[stay], y[stay], distance[stay]


#: Components of vectors whose blocks are cut to tiles; queries and rows of a tile.
TILED_DIMS, QUERIES_OF_TILE, ROWS_OF_TILE = 4, 32, 256


def _tiles(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, least and greatest components of each tile): rows of v in tiles of `size` rows that lie together, halved along the widest side."""
    order, parts = np.arange(len(v)), [(0, len(v))]
    starts = []
    while parts:
        a, b = parts.pop()
        if b - a <= size:
            starts.append(a)
            continue
        some = v[order[a:b]]
        middle = max(1, -(-(b - a) // size) // 2) * size
        order[a:b] = order[a:b][np.argpartition(some[:, np.argmax(some.max(axis=0) - some.min(axis=0))], middle)]
        parts += [(a, a + middle), (a + middle, b)]
    starts = np.sort(np.array(starts, int))
    placed = v[order]
    return order, starts, np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)


def _few_by_tiles(q: np.ndarray, r: np.ndarray, barred, k: int, ids: np.ndarray, measure: str, slack: float):
    """_few() for vectors of few components: queries and rows lie in tiles, and a tile of queries meets the tiles of rows whose boxes come near enough.

    Distances by cosine are half the squared distances of unit vectors, so that boxes bound them, too."""
    qn, rn = _norms(q), _norms(r)
    x, y = (q / qn[:, None], r / rn[:, None]) if measure == "cosine" else (q, r)
    noise = 1e-12 + COSINE_GUARD / (qn.min() * rn.min()) if measure == "cosine" else 0.0
    q_order, q_starts, q_low, q_high = _tiles(x, QUERIES_OF_TILE)
    r_order, r_starts, r_low, r_high = _tiles(y, ROWS_OF_TILE)
    r_ends = np.r_[r_starts[1:], len(r)]
    sizes, out = r_ends - r_starts, []
    for t, a in enumerate(q_starts):
        mine = q_order[a : q_starts[t + 1] if t + 1 < len(q_starts) else len(q)]
        apart = np.sqrt((np.maximum(0, np.maximum(r_low - q_high[t], q_low[t] - r_high)) ** 2).sum(axis=1))
        apart = apart**2 / 2 - noise if measure == "cosine" else apart
        apart = apart * (1 - 1e-9) - 1e-12 * (measure == "cosine")  # a hair of slack, as both sides are rounded
        by = np.argsort(apart, kind="stable")
        # the nearest tiles, and then all that can come up to the k-th of what was found
        upto = min(len(by), int(np.searchsorted(np.cumsum(sizes[by]), 2 * k)) + 1)
        done, limit, hits = 0, np.full(len(mine), np.inf), []
        best = np.full((len(mine), 0), np.inf)
        while done < upto:
            which = by[done:upto]
            rows = np.concatenate([r_order[r_starts[w] : r_ends[w]] for w in which])
            for s in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[s : s + ROWS_AT_ONCE]
                far = measured(q[mine][:, None], r[some][None], qn[mine][:, None], rn[some][None], measure)
                far[barred(mine[:, None], some[None]) | np.isnan(far)] = np.inf
                best = np.concatenate([best, far], axis=1)
                best = np.partition(best, k - 1, axis=1)[:, :k] if best.shape[1] > k else best
                limit = best.max(axis=1) + 2 * slack if best.shape[1] == k else limit
                i, j = np.nonzero((far <= limit[:, None]) & (far < np.inf))
                hits.append((i, some[j], far[i, j]))
            done = upto
            upto = done + int(np.count_nonzero(apart[by[done:]] <= limit.max(initial=0)))
            upto = min(upto, done + 4 * max(1, done))  # farther tiles wait for what the nearer ones show
        i, j, far = (np.concatenate(h) for h in zip(*hits))
        stay = far <= limit[i]
        out.append(_at_most(mine[i[stay]], j[stay], far[stay], k, ids, slack))
    return tuple(np.concatenate(p) for p in zip(*out))


def _few(q: np.ndarray, r: np.ndarray, barred, k: int, ids: np.ndarray, measure: str, slack: float):
    """(query, row, distance) of all that can be among the k nearest of a query when distances within `slack` may tie; barred(i, j)
    says which pairs are none. The k-th of some rows is a bound for the others, which one matrix product compares with it."""
    qn, rn, (n, d) = _norms(q), _norms(r), r.shape
    least, large = qn.min(initial=np.inf) * rn.min(initial=np.inf), qn.max(initial=0) * rn.max(initial=0)
    if 0 < d <= TILED_DIMS and len(q) > QUERIES_OF_TILE and n > 4 * ROWS_OF_TILE and np.isfinite(large) and (measure != "cosine" or least > 1e-6):
        return _few_by_tiles(q, r, barred, k, ids, measure, slack)
    if measure == "cosine" and least > 1e-6:
        left, right, own = -q / qn[:, None], r / rn[:, None], np.zeros(len(q))
        noise = 1e-12 + COSINE_GUARD / least
    elif measure == "cosine":
        left, right, own, noise = -q, r, np.zeros(len(q)), 1e-12
    else:  # squared distances less the query's own square
        left, right, own = np.hstack([-2 * q, np.ones((len(q), 1))]), np.hstack([r, rn[:, None] ** 2]), qn**2
        noise = 1e-14 * (d + 2) * (qn.max(initial=0) + rn.max(initial=0)) ** 2
    finite = np.isfinite(left).all() and np.isfinite(right).all()

    def close(a: int, b: int, rows) -> np.ndarray:
        out = left[a:b] @ right[rows].T
        if measure == "cosine" and least <= 1e-6:
            out /= qn[a:b, None] * rn[None, rows] + COSINE_GUARD
        if not finite:
            out[np.isnan(out)] = np.inf
        return out

    some = np.arange(0, n, max(1, n // max(4 * k, int((40 * k * n) ** 0.5))))
    out = []
    for a in range(0, len(q), QUERIES_AT_ONCE):
        b = min(len(q), a + QUERIES_AT_ONCE)
        first = np.where(barred(np.arange(a, b)[:, None], some[None]), np.inf, close(a, b, some))
        limit = np.partition(first, k - 1, axis=1)[:, k - 1] if k < len(some) else np.full(b - a, np.inf)
        limit = limit + slack + 2 * noise if measure == "cosine" else (np.sqrt(np.maximum(0, limit + own[a:b]) + noise) + slack) ** 2 + 2 * noise - own[a:b]
        hits = []
        for t in range(0, n, ROWS_AT_ONCE):
            i, j = np.divmod(np.flatnonzero(close(a, b, slice(t, t + ROWS_AT_ONCE)) <= limit[:, None]), min(ROWS_AT_ONCE, n - t))
            stay = ~barred(a + i, t + j)
            i, j = a + i[stay], t + j[stay]
            hits.append((i, j, measured(q[i], r[j], qn[i], rn[j], measure)))
        out.append(_at_most(*(np.concatenate(h) for h in zip(*hits)), k, ids, slack))
    return tuple(np.concatenate(p) for p in zip(*out))


def nearest(left: pa.Table, right: pa.Table, k: int, slack: float) -> pa.Table:
    """query_id, id, distance of what can be among the k nearest rows of right(id, vec) by cosine for the queries of left(query_id, query_vec, most), no farther
    than `most`; vectors have one length."""
    if not len(left) or not len(right):
        return pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
    mine, theirs = _codes(left.column("query_id"), right.column("id"))
    ids = right.column("id").to_numpy()
    ids = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    i, j, far = _few(_matrix(left.column("query_vec")), _matrix(right.column("vec")), lambda i, j: mine[i] == theirs[j], k, ids, "cosine", slack)
    stay = ~(far > left.column("most").to_numpy()[i] + slack)
    return pa.table({"query_id": left.column("query_id").take(pa.array(i[stay])), "id": right.column("id").take(pa.array(j[stay])), "distance": pa.array(far[stay])})


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; nulls equal each other."""
    codes, _ = pd.factorize(pd.concat([left.to_pandas(), right.to_pandas()], ignore_index=True), use_na_sentinel=False)
    return codes[: len(left)], codes[len(left) :]


def distances(queries: DataFrame, rows: DataFrame, measure: str = "cosine", k: int | None = None, digits: int | None = None, apart: tuple[str, str] | None = None, same: list[str] = []) -> DataFrame:  # noqa: B006
    """query_id, id, distance of queries(query_id, query_vec) and rows(id, vec), by 'cosine' or 'euclidean': of all pairs, or of those
    that can be among the k nearest once distances are rounded to `digits` (the rounding is done here).

    The query's own id is left out, and so are pairs whose columns `apart` (of rows and queries) are equal. The columns
    `same` of both sides have to be equal: they come first in the result, and query ids may recur under others. A vector that is null or holds a null takes no part, nor do vectors of different lengths."""
    extra, asked = [*same, *([apart[0]] if apart else [])], [*same, *([apart[1]] if apart else [])]
    q, r = _dealt(queries, rows, asked, extra, k is None)
    kinds = [queries.schema["query_id"].dataType, rows.schema["id"].dataType]
    slack = 10.0**-digits if digits is not None else 0.0

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = pairs_of(left, right)
        for i, c in enumerate(same):
            table = table.add_column(i, c, pa.array([key[2 + i].as_py()] * len(table), key[2 + i].type))
        return table

    def pairs_of(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        lw, rw = _widths(left, "query_vec"), _widths(right, "vec")
        for d in np.intersect1d(lw, rw):
            a, b = left.filter(pa.array(lw == d)), right.filter(pa.array(rw == d))
            bars = [(*_codes(a.column("query_id"), b.column("id")), True)]
            bars += [(*_codes(a.column(apart[1]), b.column(apart[0])), True)] if apart else []

            def barred(i, j):
                out = False
                for x, y, equal in bars:  # noqa: B023
                    out = out | ((x[i] == y[j]) == equal)
                return out

            x, y = _matrix(a.column("query_vec")), _matrix(b.column("vec"))
            if k is not None:
                ids = b.column("id").to_numpy()
                ids = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
                i, j, far = _few(x, y, barred, k, ids, measure, slack)
                parts.append((a.column("query_id").take(pa.array(i)), b.column("id").take(pa.array(j)), far))
                continue
            qn, rn = _norms(x), _norms(y)
            for s in range(0, len(x), max(1, ENTRIES // len(y))):
                e = min(len(x), s + max(1, ENTRIES // len(y)))
                far = np.concatenate([measured(x[s:e, None], y[None, t : t + 4096], qn[s:e, None], rn[None, t : t + 4096], measure) for t in range(0, len(y), 4096)], axis=1)
                i, j = np.nonzero(~barred(np.arange(s, e)[:, None], np.arange(len(y))[None]))
                parts.append((a.column("query_id").take(pa.array(s + i)), b.column("id").take(pa.array(j)), far[i, j]))
        names = ["query_id", "id", "distance"]
        if not parts:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        return pa.concat_tables([pa.table(dict(zip(names, (p[0], p[1], pa.array(p[2]))))) for p in parts])

    keys = ["q__", "r__", *same]
    first = "".join(f"{c} {queries.schema[c].dataType.simpleString()}, " for c in same)
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, f"{first}query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double")
    return found.withColumn("distance", F.round("distance", digits)) if digits is not None else found


#: Rankings in blocks: queries and rows of a block, entries that a task puts in order at once, sampled rows for each range of a ranking, numbers of a part
#: of two rankings that meet.
QUERIES_OF_RANKS, ROWS_OF_RANKS, RANGE_ENTRIES, SAMPLED, PART_NUMBERS = 512, 1 << 14, 1 << 22, 32, 1 << 22
#: An entry of a ranking is one unsigned integer: the rounded distance in 31 bits, the row's number in the order of ids in 32, and whether it is
#: wanted. The largest distance stands for one that is not a number; more digits do not fit.
LARGEST, MOST_DIGITS = (1 << 31) - 1, 9


def _steps(q: np.ndarray, r: np.ndarray, digits: int) -> np.ndarray:
    """Cosine distances of every query and row in whole steps of `digits`. A matrix product gives nearly all; those that come near to
    the middle of two steps are measured term by term, so all are the steps of the measured distances."""
    qn, rn, scale = _norms(q), _norms(r), 10.0**digits
    with np.errstate(all="ignore"):
        large = qn.max(initial=0) * rn.max(initial=0) * (q.shape[1] + 1)
        if not np.isfinite(large):
            out = measured(q[:, None], r[None], qn[:, None], rn[None], "cosine") * scale
        else:
            out = q @ r.T
            out /= qn[:, None] * rn[None] + COSINE_GUARD
            np.subtract(1, out, out=out)
            out *= scale
            gap = np.abs(out - np.floor(out) - 0.5)
            i, j = np.divmod(np.flatnonzero(gap < scale * (1e-12 + 1e-15 * q.shape[1])), max(1, len(r)))
            out[i, j] = measured(q[i], r[j], qn[i], rn[j], "cosine") * scale
        lost = np.isnan(out)
        out = np.clip(np.floor(out + 0.5), 0, LARGEST - 1)
        out[lost] = LARGEST
    return out.astype(np.uint64)


def steps(distance: Column, digits: int) -> Column:
    """The whole steps of a measured distance, as _steps() has them."""
    near = F.floor(distance * F.lit(10.0**digits) + 0.5).cast("long")
    return F.when(F.isnan(distance), F.lit(LARGEST)).otherwise(F.least(F.greatest(near, F.lit(0)), F.lit(LARGEST - 1))).cast("long")


def numbered(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """(rows with `number`, a long in the order of ids; what to add to it for the id, or None where numbers are places among the ids)."""
    known = rows.where(F.col("id").isNotNull())
    if known.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        low, high = known.agg(F.min("id"), F.max("id")).first()
        if low is None or high - low < (1 << 32) - 1:
            return known.withColumn("number", F.col("id") - F.lit(low or 0).cast("long")), low or 0
    places = series.running_total(known.select("id").distinct(), [], ["id"], F.lit(1).cast("long"), "number")
    return known.join(places, "id"), None


def _entries(queries: DataFrame, rows: DataFrame, asked: list[str], extra: list[str], digits: int):
    """Both sides in blocks of bounded numbers, and a function of two blocks that gives, for some queries at once, their places in the left block, the
    places in the right block and the entries of all pairs (not wanted as yet, the query's own being the largest number)."""
    if digits > MOST_DIGITS:
        raise ValueError(digits)
    usable = lambda c: f"{c} is not null and not exists({c}, x -> x is null)"
    q = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), *asked).where(usable("query_vec"))
    r = rows.select("id", "number", F.col("vec").cast("array<double>").alias("vec"), *extra).where(usable("vec"))
    m, n = q.count(), r.count()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 2)
    q_blocks = max(1, -(-m // QUERIES_OF_RANKS))
    r_blocks = max(1, -(-n // ROWS_OF_RANKS), min(-(-tasks // q_blocks), n // LEAST_ROWS))
    own = lambda c, m: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = q.withColumn("q__", own("query_id", q_blocks)).withColumn("r__", every(r_blocks))
    r = r.withColumn("r__", own("id", r_blocks)).withColumn("q__", every(q_blocks))

    def entries(left: pa.Table, right: pa.Table):
        lw, rw = _widths(left, "query_vec"), _widths(right, "vec")
        if not len(right):
            return
        mine, theirs = _codes(left.column("query_id"), right.column("id"))
        for d in np.intersect1d(lw, rw):
            i, j = np.flatnonzero(lw == d), np.flatnonzero(rw == d)
            x, y = _matrix(left.column("query_vec").take(pa.array(i))), _matrix(right.column("vec").take(pa.array(j)))
            numbers = right.column("number").to_numpy()[j].astype(np.uint64)
            for s in range(0, len(i), QUERIES_AT_ONCE):
                some = i[s : s + QUERIES_AT_ONCE]
                made = _steps(x[s : s + QUERIES_AT_ONCE], y, digits) << np.uint64(33) | numbers << np.uint64(1)
                made[mine[some][:, None] == theirs[j][None]] = np.iinfo(np.uint64).max
                yield some, j, made

    return q.groupBy("q__", "r__").cogroup(r.groupBy("q__", "r__")), n, entries


NO_ENTRY = np.uint64(np.iinfo(np.uint64).max)


def ranks(queries: DataFrame, rows: DataFrame, digits: int = MOST_DIGITS, wanted: tuple[str, str] | None = None) -> DataFrame:
    """query_id, number, rank, nth, of: the places of rows(id, number, vec) in the rankings of queries(query_id, query_vec) by rounded cosine distance
    and number, the query itself left out. Only rows whose column wanted[0] equals the query's wanted[1] are given (all, if none are named); each is
    the nth of the query's `of` given rows.

    Pairs stay entries of packed arrays. A ranking is cut to ranges of about RANGE_ENTRIES, with bounds from a sample of the rows; a block
    hands on its entries of each range and how many it has in the ranges before, so each range knows its first place."""
    dealt, kind = _ranges(queries, rows, digits, wanted)

    def place(key: tuple, table: pa.Table) -> pa.Table:
        e, before, chosen, of = _placed(table)
        found = np.flatnonzero(e & np.uint64(1))
        made = {"number": _numbers(e[found]).astype(np.int64), "rank": before + 1 + found, "nth": chosen + 1 + np.arange(len(found)), "of": np.full(len(found), of)}
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(found), key[0].type), **{c: pa.array(v, pa.int64()) for c, v in made.items()}})

    return dealt.groupBy("query_id", "span").applyInArrow(place, f"query_id {kind}, number long, rank long, nth long, of long")


def _placed(table: pa.Table) -> tuple[np.ndarray, int, int, int]:
    """(the entries of a range in order, entries before it, wanted ones before it, wanted ones of the ranking)."""
    e = np.frombuffer(b"".join(table.column("entries").to_pylist()), "<u8").copy()
    e.sort()
    return e, *(int(table.column(c).to_numpy().sum()) for c in ("before", "chosen", "of"))


def _numbers(entries: np.ndarray) -> np.ndarray:
    return entries >> np.uint64(1) & np.uint64(0xFFFFFFFF)


def _ranges(queries: DataFrame, rows: DataFrame, digits: int, wanted: tuple[str, str] | None) -> tuple[DataFrame, str]:
    """(query_id, span, entries, before, chosen, of: each block's part of each range of the rankings, the type of query_id)."""
    extra, asked = ([wanted[0]], [wanted[1]]) if wanted else ([], [])
    both, n, entries = _entries(queries, rows, asked, extra, digits)
    ranges, sample = max(1, -(-n // RANGE_ENTRIES)), None
    if ranges > 1:
        picked = rows.where(F.col("vec").isNotNull()).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(min(SAMPLED * ranges, 8192))
        sample = picked.select("id", "number", F.col("vec").cast("array<double>").alias("vec")).where("not exists(vec, x -> x is null)").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(sample)
    kind = queries.schema["query_id"].dataType.simpleString()

    def bounds(left: pa.Table) -> list[np.ndarray]:
        """For each query, the first entries of all ranges but the first; the same wherever the query goes."""
        out = [np.zeros(0, np.uint64)] * len(left)
        for some, _, made in entries(left, shared.value) if ranges > 1 else ():
            made.sort(axis=1)
            for i, e in zip(some.tolist(), made):
                out[i] = np.unique(e[np.arange(1, ranges) * len(e) // ranges])
        return out

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        ends = bounds(left)
        flags = _codes(left.column(wanted[1]), right.column(wanted[0])) if wanted and len(right) else None
        if flags is not None:  # a missing value equals none
            flags[0][left.column(wanted[1]).is_null().to_numpy()] = -1
        at, spans, blobs, counts = [], [], [], []
        for some, j, made in entries(left, right):
            for i, e in zip(some.tolist(), made):
                e |= (flags[0][i] == flags[1][j]).astype(np.uint64) if flags is not None else np.uint64(1)
                e = e[e != NO_ENTRY]
                if len(ends[i]):
                    e.sort()
                cuts = np.r_[0, np.searchsorted(e, ends[i]), len(e)]
                chosen = np.r_[0, np.cumsum((e & np.uint64(1)).astype(np.int64))][cuts]
                for k in range(len(cuts) - 1):
                    at.append(i)
                    spans.append(k)
                    blobs.append(e[cuts[k] : cuts[k + 1]].tobytes())
                    counts.append((cuts[k], chosen[k], chosen[-1]))
        counts = np.array(counts, np.int64).reshape(-1, 3)
        columns = {"query_id": left.column("query_id").take(pa.array(at, pa.int64())), "span": pa.array(spans, pa.int32()), "entries": pa.array(blobs, pa.binary())}
        return pa.table({**columns, **{c: pa.array(counts[:, k]) for k, c in enumerate(("before", "chosen", "of"))}})

    return both.applyInArrow(deal, f"query_id {kind}, span int, entries binary, before long, chosen long, of long"), kind


def rank_correlations(queries: DataFrame, rows: DataFrame, others: tuple[DataFrame, DataFrame], digits: int = MOST_DIGITS) -> DataFrame:
    """query_id, correlation of the places that rows have in two rankings of each query, as ranks() gives them: by queries and rows, and by `others`, another
    pair of queries and rows with the same numbers. Rows of one ranking alone are left out.

    Both rankings leave their ranges as packed (number, place), in parts of PART_NUMBERS numbers; parts meet and hand on five sums."""
    kind, share = queries.schema["query_id"].dataType.simpleString(), np.uint64(PART_NUMBERS)

    def place(key: tuple, table: pa.Table) -> pa.Table:
        e, before, _, of = _placed(table)
        places = _numbers(e) << np.uint64(32) | np.arange(before + 1, before + 1 + len(e), dtype=np.uint64)
        places.sort()
        parts = (places >> np.uint64(32)) // share
        cuts = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(e)] if len(e) else np.zeros(1, int)
        blobs = [places[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        query = pa.array([key[0].as_py()] * len(blobs), key[0].type)
        return pa.table({"query_id": query, "part": pa.array(parts[cuts[:-1]].astype(np.int64)), "places": pa.array(blobs, pa.binary()), "of": pa.array([of] * len(blobs), pa.int64())})

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for table in (left, right):
            e = np.frombuffer(b"".join(table.column("places").to_pylist()), "<u8").copy()
            e.sort()
            middle = (table.column("of")[0].as_py() + 1) / 2 if len(table) else 0.0
            sides.append((e >> np.uint64(32), (e & np.uint64(0xFFFFFFFF)).astype(float) - middle))
        (m, x), (n, y) = sides
        if len(m) != len(n) or (m != n).any():
            _, i, j = np.intersect1d(m, n, assume_unique=True, return_indices=True)
            x, y = x[i], y[j]
        sums = (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
        return pa.table({"query_id": pa.array([key[0].as_py()], key[0].type), **{c: pa.array([float(v)]) for c, v in zip(("n", "x", "y", "xx", "yy", "xy"), sums)}})

    sides = [_ranges(*pair, digits, None)[0].groupBy("query_id", "span").applyInArrow(place, f"query_id {kind}, part long, places binary, of long") for pair in ((queries, rows), others)]
    sums = sides[0].groupBy("query_id", "part").cogroup(sides[1].groupBy("query_id", "part")).applyInArrow(meet, f"query_id {kind}, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")
    spread = lambda a: F.col(a + a) - F.col(a) * F.col(a) / F.col("n")
    return total.select("query_id", ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(F.sqrt(spread("x") * spread("y")), F.lit(0.0))).alias("correlation"))


def ranks_of(queries: DataFrame, rows: DataFrame, chosen: DataFrame, digits: int = MOST_DIGITS) -> DataFrame:
    """query_id, number, rank of the few pairs chosen(query_id, number) that stand in the rankings of ranks(): each block counts its entries below the
    entries of the chosen rows, so that no pair is handed on."""
    known = rows.select("number", F.col("vec").cast("array<double>").alias("vec"), "id").where("vec is not null and not exists(vec, x -> x is null)")
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).where("query_vec is not null and not exists(query_vec, x -> x is null)")
    met = chosen.select("query_id", "number").join(known, "number").join(asked, "query_id").where("size(vec) = size(query_vec) and id <> query_id")
    d = 1 - vectors.dot("vec", "query_vec") / (vectors.norm("vec") * vectors.norm("query_vec") + COSINE_GUARD)
    entry = F.shiftleft(steps(d, digits), 32).bitwiseOR(F.col("number"))
    marks = met.groupBy("query_id").agg(F.collect_set(entry).alias("marks"))
    both, _, entries = _entries(asked.join(marks, "query_id"), rows, ["marks"], [], digits)
    kind = queries.schema["query_id"].dataType.simpleString()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        at, marks, below = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lists = left.column("marks").to_pylist()
        for some, _, made in entries(left, right):
            made.sort(axis=1)
            for i, e in zip(some.tolist(), made):
                m = np.array(lists[i], np.int64)
                at += [i] * len(m)
                marks.append(m)
                below.append(np.searchsorted(e, m.astype(np.uint64) << np.uint64(1)))
        return pa.table({"query_id": left.column("query_id").take(pa.array(at, pa.int64())), "mark": pa.array(np.concatenate(marks)), "below": pa.array(np.concatenate(below).astype(np.int64))})

    counted = both.applyInArrow(count, f"query_id {kind}, mark long, below long")
    total = counted.groupBy("query_id", "mark").agg((F.sum("below") + 1).alias("rank"))
    return total.select("query_id", F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("number"), "rank")
