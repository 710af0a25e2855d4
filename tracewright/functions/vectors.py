"""Vectors and sequences as array columns; everything here stays in the JVM.

A vector is array<double>; a sequence is array<array<double>>, one inner array a point. Null input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against division by (almost) nothing; fixed values of the measures they belong to.
COSINE_GUARD, NORM_GUARD, EXTENT_GUARD, RANGE_GUARD = 1e-10, 1e-10, 1e-6, 1e-9


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column | str, body) -> Column:
    """body(c) with c computed once, null where c is null: a nested expression is bound to a lambda's variable instead of being repeated."""
    known = lambda v: F.when(v.isNotNull(), body(v))
    return known(F.col(c)) if isinstance(c, str) else F.get(F.transform(F.array(c), known), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x * x)))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scale(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x * by)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return norm(subtract(a, b))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return _sum(F.transform(subtract(a, b), F.abs))


def chebyshev(a: Column | str, b: Column | str) -> Column:
    return F.array_max(F.transform(subtract(a, b), F.abs))


def smallest_difference(a: Column | str, b: Column | str) -> Column:
    return F.array_min(F.transform(subtract(a, b), F.abs))


def edge_projection(p: Column | str, a: Column | str, b: Column | str) -> Column:
    """share and distance of a point's foot on the line through an edge's ends; the distance is infinite where the foot lies
    beyond an end. On an edge without length the share is 0."""

    def body(p: Column, a: Column, b: Column) -> Column:
        step, size = subtract(b, a), F.nullif(dot(subtract(b, a), subtract(b, a)), F.lit(0.0))
        share = F.coalesce(dot(subtract(p, a), step) / size, F.lit(0.0))
        foot = lambda t: norm(F.zip_with(subtract(p, a), step, lambda x, y: x - t * y))
        return bound(share, lambda t: F.struct(t.alias("share"), F.when((t >= 0) & (t <= 1), foot(t)).otherwise(F.lit(float("inf"))).alias("distance")))

    return bound(p, lambda x: bound(a, lambda y: bound(b, lambda z: body(x, y, z))))


def array_literal(a: Column | str) -> Column:
    """'{v1,v2,...}', the text form of an array in a relational database."""
    return F.concat(F.lit("{"), F.array_join(F.transform(col(a), lambda x: x.cast("string")), ",", "NULL"), F.lit("}"))


def angular(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of angle vectors whose components wrap at a full turn."""
    turn = 2 * F.pi()
    wrapped = F.zip_with(col(a), col(b), lambda x, y: F.least(F.abs(x - y), turn - F.abs(x - y)))
    return norm(wrapped)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b) + COSINE_GUARD)


def unit(a: Column | str) -> Column:
    """a at length one; vectors shorter than the guard stay as they are."""

    def body(v: Column) -> Column:
        return bound(norm(v), lambda n: F.when(n > NORM_GUARD, F.transform(v, lambda x: x / n)).otherwise(v))

    return bound(a, body)


def parse_vector(text: Column | str) -> Column:
    """array<double> from '[v1,v2,...]'."""
    return F.from_json(col(text), "array<double>")


def column_of(seq: Column | str, dim: int) -> Column:
    return F.transform(col(seq), lambda p: p[dim])


def min_max(seq: Column | str, dims: int) -> Column:
    """Each dimension of a sequence mapped to [0, 1]; a (nearly) constant dimension is only shifted."""


    def body(s: Column) -> Column:
        lows = F.array(*[F.array_min(column_of(s, d)) for d in range(dims)])
        highs = F.array(*[F.array_max(column_of(s, d)) for d in range(dims)])
        spans = F.zip_with(highs, lows, lambda h, low: F.when(h - low < RANGE_GUARD, F.lit(1.0)).otherwise(h - low))
        one = lambda p, low, span: F.array(*[(p[d] - low[d]) / span[d] for d in range(dims)])
        return bound(lows, lambda low: bound(spans, lambda span: F.transform(s, lambda p: one(p, low, span))))

    return bound(seq, body)


def relative_to_first(seq: Column | str) -> Column:
    return bound(seq, lambda s: bound(s[0], lambda first: F.transform(s, lambda p: subtract(p, first))))


def scaled_to_extent(seq: Column | str) -> Column:
    """A sequence divided by the largest distance of a point from the origin."""


    def body(s: Column) -> Column:
        extent = F.array_max(F.transform(s, norm))
        return bound(extent, lambda e: F.when(e > EXTENT_GUARD, F.transform(s, lambda p: scale(p, 1 / e))).otherwise(s))

    return bound(seq, body)


def resample(seq: Column | str, n: int) -> Column:
    """n points: linear interpolation at even steps; a sequence of n points or fewer repeats its last point instead."""


    def between(s: Column, low: Column, at: Column) -> Column:
        return F.zip_with(F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1)), lambda x, y: x + (y - x) * (at - low))

    def point(s: Column, i: Column) -> Column:
        at = i * (F.size(s) - 1) / F.lit(float(max(1, n - 1)))
        inner = bound(at, lambda a: bound(F.least(F.floor(a).cast("int"), F.size(s) - 1), lambda low: between(s, low, a)))
        return F.when(F.size(s) <= n, F.get(s, F.least(i, F.size(s) - 1))).otherwise(inner)

    return bound(seq, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(s, i)))


def flatten_by_dimension(seq: Column | str, dims: int) -> Column:
    return bound(seq, lambda s: F.concat(*[column_of(s, d) for d in range(dims)]))


def multi_scale(seq: Column | str, dims: int, coarse: int, fine: int) -> Column:
    """Unit vector of the coarse and the fine resampling, each dimension in a block."""
    sizes = [n for n in (coarse, fine) if n > 0]
    if not sizes:
        raise ValueError("coarse and fine are both zero")
    return unit(bound(seq, lambda s: F.concat(*[flatten_by_dimension(resample(s, n), dims) for n in sizes])))


def _or_zeros(seq: Column | str, vector: Column, width: int) -> Column:
    return F.when(F.coalesce(F.size(col(seq)), F.lit(0)) < 1, F.array_repeat(F.lit(0.0), width)).otherwise(vector)


def position_embedding(seq: Column | str, coarse: int, fine: int) -> Column:
    shape = scaled_to_extent(relative_to_first(seq))
    return _or_zeros(seq, multi_scale(shape, 3, coarse, fine), 3 * (coarse + fine))


def joint_embedding(seq: Column | str, coarse: int, fine: int, joints: int = 6) -> Column:
    return _or_zeros(seq, multi_scale(seq, joints, coarse, fine), joints * (coarse + fine))


def axis_embedding(seq: Column | str, coarse: int, fine: int) -> Column:
    """Orientation embedding of [x, y, z, w] quaternions by their unit rotation axes."""

    def axis(q: Column) -> Column:
        half = F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3]))))
        return bound(F.when(half == 0, F.lit(1.0)).otherwise(half), lambda s: F.array(q[0] / s, q[1] / s, q[2] / s))

    return _or_zeros(seq, multi_scale(relative_to_first(F.transform(col(seq), axis)), 3, coarse, fine), 3 * (coarse + fine))


#: Fixed scales of the metadata features.
MAX_LENGTH, MAX_DURATION, MAX_TWIST, MAX_ACCELERATION = 9000.0, 25.0, 3100.0, 10200.0
STATISTICS = ("min", "max", "mean", "median", "std")


def _centred(c: Column, half: float) -> Column:
    return (c + half) / (2 * half)


def movement_share(movement: Column | str, letter: str, word: str) -> tuple[Column, Column]:
    """(share of this movement, total): letters of the type string count one each and its word one more."""
    text = F.lower(col(movement))
    count = lambda x, w: F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) + text.contains(w).cast("int")
    total = count("l", "linear") + count("c", "circular")
    return F.when(total > 0, count(letter, word) / total).otherwise(F.lit(0.0)), total


def metadata_embedding(movement, length, duration, twist: dict, acceleration: dict) -> Column:
    """Unit vector of movement shares, length, duration and five statistics each of speed and acceleration."""
    parts = [movement_share(movement, "l", "linear")[0], movement_share(movement, "c", "circular")[0]]
    parts += [F.least(col(length) / MAX_LENGTH, F.lit(1.0)), F.least(col(duration) / MAX_DURATION, F.lit(1.0))]
    for stats, most in ((twist, MAX_TWIST), (acceleration, MAX_ACCELERATION)):
        parts += [col(stats[s]) / most if s == "std" else _centred(col(stats[s]), most) for s in STATISTICS]
    return unit(F.array(*[p.cast("double") for p in parts]))


def kim_bound(a: Column | str, b: Column | str, dims: int) -> Column:
    """Largest distance between the first points, last points, minima and maxima of two sequences of any lengths."""
    ends = [(F.get(col(a), F.lit(0)), F.get(col(b), F.lit(0))), (F.element_at(col(a), -1), F.element_at(col(b), -1))]
    for pick in (F.array_min, F.array_max):
        ends.append(tuple(F.array(*[pick(column_of(s, d)) for d in range(dims)]) for s in (a, b)))
    return F.greatest(*[euclidean(x, y) for x, y in ends])
