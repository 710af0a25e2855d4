"""Angular rates of orientation series, and orientations from rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ode
from ..functions import quaternions as q
from . import joins
from .series import along


#: Scalar parts and dot products this near to zero are half turns, for which both ways round are as long: the second one is taken.
HALF_TURN = 1e-12
#: Points of the series that are integrated side by side.
POINTS_AT_ONCE = 50_000


def angular_rates(rows: DataFrame, keys: list[str], at: str, quaternion: str, alias: str = "rate", ties: list[str] = [], unit: float = 1.0) -> DataFrame:  # noqa: B006
    """rows with the mean rate since the row before, in the frame of that row: twice the logarithm of the turn between, over the time.

    Times are subtracted before they are divided by `unit`, so whole ticks lose no digit; `ties` order rows of one time."""
    w = along(keys, [at, *ties])
    rows = rows.withColumn("q__", F.lag(quaternion).over(w)).withColumn("dt__", (F.col(at) - F.lag(at).over(w)) / F.lit(unit))
    turn = q.product(q.conjugate("q__"), quaternion)
    near = q.bound(turn, lambda t: F.when(t[0] < HALF_TURN, F.transform(t, lambda x: -x)).otherwise(t))  # the shorter way round
    rate = q.bound(q.logarithm(near), lambda v: F.array(*[2 * v[i] / F.col("dt__") for i in (1, 2, 3)]))
    return rows.withColumn(alias, F.when(F.col("q__").isNotNull() & (F.col("dt__") != 0), rate)).drop("q__", "dt__")


def turns(rows: DataFrame, keys: list[str], order: list, quaternion: str, alias: str = "turn") -> DataFrame:
    """rows with the turn since the row before: the inverse of that orientation times this one; null at the start."""
    before = F.lag(quaternion).over(along(keys, order))
    return rows.withColumn("q__", before).withColumn(alias, F.when(F.col("q__").isNotNull(), q.product(q.inverse("q__"), quaternion))).drop("q__")


def interpolated(samples: DataFrame, wanted: DataFrame, keys: list[str], at: str, quaternion: str, alias: str = "orientation") -> DataFrame:
    """wanted (keys, at) with the orientation between the nearest samples before and after, on the shorter arc; null outside."""
    some = samples.select(*keys, F.col(at).alias("s__"), F.col(quaternion).alias("q__"))
    before = joins.asof(wanted, some.select(*keys, "s__", F.col("s__").alias("a__"), F.col("q__").alias("p__")), at, "s__", keys, right_columns=["a__", "p__"])
    both = joins.asof(before, some.select(*keys, "s__", F.col("s__").alias("b__"), F.col("q__").alias("n__")), at, "s__", keys, "forward", right_columns=["b__", "n__"])
    share = F.when(F.col("b__") == F.col("a__"), F.lit(0.0)).otherwise((F.col(at) - F.col("a__")) / (F.col("b__") - F.col("a__")))
    between = F.when(F.col("a__").isNotNull() & F.col("b__").isNotNull(), q.slerp("p__", "n__", F.col("t__"), half_turn=HALF_TURN))
    return both.withColumn("t__", share).withColumn(alias, between).drop("a__", "b__", "p__", "n__", "t__")


def _times(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.concatenate([[p[0] * r[0] - p[1:] @ r[1:]], p[0] * r[1:] + r[0] * p[1:] + np.cross(p[1:], r[1:])])


def cumulative_product(rows: DataFrame, keys: list[str], order: str, quaternion: str, alias: str = "product") -> DataFrame:
    """rows with the product of all quaternions of the series up to each row. One series is one kernel call."""
    schema = T.StructType([*rows.schema.fields, T.StructField(alias, T.ArrayType(T.DoubleType()))])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, total = part.sort_values(order), np.array([1.0, 0, 0, 0])
        out = []
        for p in part[quaternion]:
            total = _times(total, np.asarray(p, float))
            out.append(total)
        return part.assign(**{alias: out})

    return rows.groupBy(*keys).applyInPandas(run, schema)


def integrated(rows: DataFrame, keys: list[str], at: str, rate: str, alias: str = "orientation") -> DataFrame:
    """rows with the orientation reached from the identity when each row's rate holds since the row before."""
    w = along(keys, [at])
    dt: Column = F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(0)).cast("double")
    r = F.coalesce(F.col(rate), F.array(*[F.lit(0.0)] * 3))
    step = q.exponential(F.concat(F.array(F.lit(0.0)), F.transform(r, lambda x: x * F.col("dt__") / 2)))
    return cumulative_product(rows.withColumn("dt__", dt).withColumn("step__", step), keys, at, "step__", alias).drop("dt__", "step__")


def _quaternion_slope(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Half the product of quaternions (first four columns of y) with body rates w."""
    a, x, b, c = y[:, 0], y[:, 1], y[:, 2], y[:, 3]
    return 0.5 * np.stack([-x * w[:, 0] - b * w[:, 1] - c * w[:, 2], a * w[:, 0] + b * w[:, 2] - c * w[:, 1], a * w[:, 1] + c * w[:, 0] - x * w[:, 2], a * w[:, 2] + x * w[:, 1] - b * w[:, 0]], axis=1)


def _unit_rows(y: np.ndarray) -> np.ndarray:
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def propagated(rows: DataFrame, quaternion: str, rate: str, inertia: str, times: str, torque=None, relative: float = 1e-10, alias: str = "motion") -> DataFrame:
    """rows with the motion of a free or driven rigid body: an array of (t, orientation, rate), one for each of its times.

    A row starts at the first of its times (array, rising or falling) with an orientation and a body rate, and has principal moments
    of inertia; Euler's equations are integrated with step control, all bodies of an Arrow batch side by side.
    torque(t, orientations, rates), on arrays with a row for each body, gives torques in the body frame; without it only the moments' ratios count. Rows with
    a null, or with a moment that is not positive, have none; a motion that cannot be followed on is not a number from there."""
    schema = "array<struct<t: double, orientation: array<double>, rate: array<double>>>"

    @F.pandas_udf(schema)
    def move(q0: pd.Series, w0: pd.Series, moments: pd.Series, at: pd.Series) -> pd.Series:
        usable = [i for i, four in enumerate(zip(q0, w0, moments, at)) if all(x is not None and len(x) for x in four) and min(four[2]) > 0 and np.any(four[0])]
        out: list = [None] * len(q0)
        if usable:
            pick = lambda s: np.array([np.asarray(s.iloc[i], float) for i in usable])
            i3 = pick(moments)
            ratio = np.stack([(i3[:, 1] - i3[:, 2]) / i3[:, 0], (i3[:, 2] - i3[:, 0]) / i3[:, 1], (i3[:, 0] - i3[:, 1]) / i3[:, 2]], axis=1)

            def slope(which, t, y):
                w = y[:, 4:]
                change = w[:, [1, 2, 0]] * w[:, [2, 0, 1]] * ratio[which]
                if torque is not None:
                    change = change + torque(t, _unit_rows(y[:, :4]), w) / i3[which]
                return np.hstack([_quaternion_slope(y, w), change])

            start = np.hstack([_unit_rows(pick(q0)), pick(w0)])
            stops = [np.asarray(at.iloc[i], float) for i in usable]
            for i, stop, states in zip(usable, stops, ode.solve(slope, start, stops, relative)):
                turned = _unit_rows(states[:, :4])
                out[i] = [{"t": float(t), "orientation": q_.tolist(), "rate": s[4:].tolist()} for t, q_, s in zip(stop, turned, states)]
        return pd.Series(out)

    return rows.withColumn(alias, move(quaternion, rate, inertia, times))


def integrated_by_spline(rows: DataFrame, keys: list[str], at: str, rate: str, start: list[float] = (1.0, 0.0, 0.0, 0.0), relative: float = 1e-10, alias: str = "orientation") -> DataFrame:
    """keys, at and the orientation at each of a series' distinct times, from body rates that a cubic spline joins.

    integrated() keeps each rate until the next; here the rate changes smoothly, and the equation is solved with step control, all series of an Arrow
    batch side by side, POINTS_AT_ONCE points at a time. Rows with a null or non-finite time or rate are left out; of several at a time the first rate in order counts."""
    known = rows.where(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")) & F.col(rate).isNotNull() & F.expr(f"size(`{rate}`) = 3 and forall(`{rate}`, x -> x is not null and abs(x) < double('Infinity'))"))
    once = known.groupBy(*keys, F.col(at).cast("double").alias("t__")).agg(F.min(F.col(rate).cast("array<double>")).alias("w__"))
    series_ = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t__", "w__"))).alias("s__"))  # a series is bounded by its recording
    begin = np.asarray(start, float) / np.linalg.norm(start)

    def integrate(times: list[np.ndarray], rates: list[np.ndarray]) -> list[np.ndarray]:
        pieces = [ode.cubic(t, w) for t, w in zip(times, rates)]
        offset = np.cumsum([0, *[len(p) for p in pieces]])
        table = np.concatenate(pieces)
        knots = np.concatenate([t[: len(p)] for t, p in zip(times, pieces)])
        spot = offset[:-1].copy()  # the piece that each series is in

        def slope(which, t, y):
            here = spot[which]
            last = offset[which + 1] - 1
            while True:
                go = (here < last) & (t > knots[np.minimum(here + 1, len(knots) - 1)])
                if not go.any():
                    break
                here = here + go
            while True:  # a rejected step goes back
                go = (here > offset[which]) & (t < knots[here])
                if not go.any():
                    break
                here = here - go
            spot[which] = here
            s = (t - knots[here])[:, None]
            c = table[here]
            return _quaternion_slope(y, c[:, 0] + s * (c[:, 1] + s * (c[:, 2] + s * c[:, 3])))

        return ode.solve(slope, np.tile(begin, (len(times), 1)), times, relative)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends, inner = column.offsets.to_numpy(), column.values
            all_t, all_w = inner.field("t__").to_numpy(zero_copy_only=False), inner.field("w__")
            all_w = all_w.values.to_numpy(zero_copy_only=False).reshape(-1, 3)[all_w.offsets[0].as_py() // 3 :]
            sizes, first = np.diff(ends), 0
            while first < len(sizes):  # as many series as have POINTS_AT_ONCE points together, the longest counting for all
                most = np.maximum.accumulate(sizes[first:]) * np.arange(1, len(sizes) - first + 1)
                last = first + max(1, int(np.searchsorted(most, POINTS_AT_ONCE, side="right")))
                parts = [slice(a, b) for a, b in zip(ends[first:last], ends[first + 1 : last + 1])]
                states = np.concatenate(integrate([all_t[p] for p in parts], [all_w[p] for p in parts]))
                which = pa.array(np.repeat(np.arange(first, last), sizes[first:last]))
                made = pa.ListArray.from_arrays(np.arange(0, 4 * len(states) + 1, 4, dtype=np.int32), pa.array(_unit_rows(states).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(which) for i in range(len(keys))], pa.array(all_t[ends[first] : ends[last]]), made], names=[*keys, at, alias])
                first = last

    schema = T.StructType([*[once.schema[c] for c in keys], T.StructField(at, T.DoubleType()), T.StructField(alias, T.ArrayType(T.DoubleType()))])
    return series_.select(*keys, "s__").mapInArrow(run, schema)
