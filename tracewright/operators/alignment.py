"""Alignment of measured with nominal trajectories, one grouped kernel call a trajectory (or segment).

Both sides are dealt by the trajectory id and met in one cogroup; ids already in place are not shuffled again. What a
kernel holds is one trajectory, whose points are bounded by its recording, never a group that grows with the corpus.
A trajectory that is no input for a kernel (one side without points, points that are not finite) yields one row that says so in
`status`, and the others go on; errors of the kernels themselves are raised. The memory of the alignments grows with the power
1.5 of the lengths: of two paths of 100,000 points about a gigabyte for dtw, frechet, lcss and qdtw; of 20,000 points under half of that for
sidtw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions import kernels as k

METRICS = ("point_to_curve", "point_to_pchip", "point_to_spline", "sidtw", "dtw", "frechet", "lcss", "qad", "qdtw")
_AXES = "xyzw"


def _rows(metric: str, x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, own: int):
    """(nominal points, measured points, distances, segment ids, overall value) of a metric on the first `own` coordinates;
    the others, such as the time, come along."""
    a, b = x[:, :own], y[:, :own]
    if metric == "point_to_curve":
        foot, d, _ = k.point_to_polyline(a, b)
        return foot, y, d, ys, d.mean()
    if metric in ("point_to_pchip", "point_to_spline"):  # the nominal path as a cubic curve
        foot, d, _ = curves.nearest(a, b, metric.removeprefix("point_to_"))
        return foot, y, d, ys, d.mean()
    if metric == "sidtw":
        _, _, d, ix, iy, row = k.selective_dtw(a, b)
        # the nominal segment of the row, but the measured one along the first row
        segs = np.where(row == 0, ys[np.minimum(np.ceil(iy).astype(int), len(ys) - 1)], xs[row])
        segs[-1] = xs[-1]
        return k.along(x, ix), k.along(y, iy), d, segs, d.mean()
    if metric == "qad":
        between, d = k.quaternion_distance(a, b)
        return between, y, d, ys, d.mean()
    if metric == "lcss":
        i, j, d, score, _ = k.lcss(a, b)
        return x[i], y[j], d, ys[j], score
    i, j, d, total = {"dtw": k.dtw, "frechet": k.discrete_frechet, "qdtw": k.quaternion_dtw}[metric](a, b)
    return x[i], y[j], d, ys[j] if metric == "qdtw" else xs[i], total if metric == "frechet" else d.mean()


def _problem(metric: str, x: np.ndarray, y: np.ndarray) -> str:
    """Why two paths are no input for a kernel, or nothing."""
    if not len(x) or not len(y):
        return "one side has no points"
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return "points that are not finite"
    return "an orientation of length zero" if metric in ("qad", "qdtw") and not (x.any(axis=1).all() and y.any(axis=1).all()) else ""


def distances_of(metric: str, x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, dims: int) -> np.ndarray:
    """The distances that align() gives for one pair, none for a pair that it cannot align."""
    return np.zeros(0) if _problem(metric, x[:, :dims], y[:, :dims]) else _rows(metric, x, y, xs, ys, dims)[2]


def align(nominal: DataFrame, measured: DataFrame, metric: str, dims: int = 3, traj: str = "traj_id", granularity: str = "trajectory", carried: int = 0) -> DataFrame:
    """Deviations of each pair on the metric's path: traj_id, seg_id, points_order, distance, nominal, measured, value, status.

    Both inputs have traj_id, seg_id, ord and v (array<double>); granularity 'segment' aligns each segment by itself. The
    distance takes the first `dims` coordinates; `carried` more are interpolated with the points (a time, say)."""
    if metric not in METRICS:
        raise ValueError(metric)
    keys = [traj, "seg_id"] if granularity == "segment" else [traj]
    kind = dict(nominal.dtypes)
    schema = f"{traj} {kind[traj]}, seg_id {kind['seg_id']}, points_order long, distance double, nominal array<double>, measured array<double>, value double, status string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ord"), right.sort_values("ord")
        x, y = (np.vstack(side.v)[:, : dims + carried].astype(float) if len(side) else np.zeros((0, dims)) for side in (left, right))
        problem = _problem(metric, x[:, :dims], y[:, :dims])
        if problem:
            return pd.DataFrame([{**dict.fromkeys(columns), **dict(zip(keys, key)), "status": problem}])[columns]
        px, py, d, segs, value = _rows(metric, x, y, left.seg_id.to_numpy(), right.seg_id.to_numpy(), dims)
        return pd.DataFrame({traj: key[0], "seg_id": segs, "points_order": np.arange(1, len(d) + 1), "distance": d, "nominal": list(px), "measured": list(py), "value": float(value), "status": "ok"})[columns]

    need = [traj, "seg_id", "ord", "v"]
    return nominal.select(*need).groupBy(*keys).cogroup(measured.select(*need).groupBy(*keys)).applyInPandas(run, schema)


def without_jumps(orientations: DataFrame, traj: str = "traj_id") -> DataFrame:
    """orientations(traj_id, ord, v) with `cleaned`: unit quaternions in which runs of large steps, and what follows them at once, are arcs.

    Rows with a null, non-finite or zero orientation stay as they are and are looked past."""
    kind = dict(orientations.dtypes)
    schema = f"{traj} {kind[traj]}, ord {kind['ord']}, v array<double>, cleaned array<double>"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord").reset_index(drop=True)
        usable = [i for i, v in enumerate(part.v) if v is not None and len(v) == 4 and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
        out: list = list(part.v)
        if usable:
            q = k.without_jumps(np.vstack([np.asarray(part.v[i], float) for i in usable]))
            for i, row in zip(usable, q / np.linalg.norm(q, axis=1, keepdims=True)):
                out[i] = row.tolist()
        return part.assign(cleaned=out)[[traj, "ord", "v", "cleaned"]]

    return orientations.select(traj, "ord", "v").groupBy(traj).applyInPandas(run, schema)


def failed(deviations: DataFrame, traj: str = "traj_id") -> DataFrame:
    """traj_id, seg_id and status of what could not be aligned."""
    return deviations.where("status <> 'ok'").select(traj, "seg_id", "status")


def pair_distances(pairs: DataFrame, a: str, b: str, measure: str = "constrained_dtw", alias: str = "distance", best: str | None = None, **options) -> DataFrame:
    """pairs with the distance of two sequence columns (array<array<double>>), computed batch by batch where the pairs are.

    measure: constrained_dtw, kim_bound, keogh_bound or resampled_distance of the kernels, with their options. Rows with
    a null or empty sequence get null. `best` names a column with a figure that constrained_dtw has to keep to: above it, it may be infinite."""
    kernel = getattr(k, measure)
    together = measure == "constrained_dtw" and "best" not in options

    def found(x: pd.Series, y: pd.Series, limits) -> pd.Series:
        rows = [i for i, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None and len(p) and len(q)]
        both = [(np.vstack(x.iloc[i]).astype(float), np.vstack(y.iloc[i]).astype(float)) for i in rows]
        some = {} if limits is None else {"best": limits.fillna(np.inf).to_numpy(float)[rows]}
        values = k.constrained_dtw_many(both, **options, **some) if together else [kernel(p, q, **options) for p, q in both]
        out = np.full(len(x), None, object)
        out[rows] = values
        return pd.Series(out, dtype="Float64").astype(object).where(lambda s: s.notna(), None)

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return found(x, y, None)

    @F.pandas_udf("double")
    def distance_within(x: pd.Series, y: pd.Series, limit: pd.Series) -> pd.Series:
        return found(x, y, limit)

    return pairs.withColumn(alias, distance(a, b) if best is None else distance_within(a, b, F.col(best).cast("double")))


def resampled_sequences(rows: DataFrame, seq: str, n: int, method: str = "pchip", alias: str = "resampled") -> DataFrame:
    """rows with a sequence's n points at even steps: 'linear', shape-preserving cubic 'pchip', or cubic 'spline'. Empty stays empty."""
    at = {"linear": k.along, "pchip": k.pchip, "spline": k.spline}[method]

    @F.pandas_udf("array<array<double>>")
    def resample(s: pd.Series) -> pd.Series:
        some = [np.vstack(x).astype(float) if x is not None and len(x) else None for x in s]
        return pd.Series([None if x is None else [] if y is None else at(y, np.linspace(0, len(y) - 1, n)).tolist() for x, y in zip(s, some)])

    return rows.withColumn(alias, resample(seq))


def velocity_embeddings(rows: DataFrame, seq: str, coarse: int, fine: int, alias: str = "velocity_embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        empty = np.zeros((0, 3))
        return pd.Series([k.velocity_embedding(np.vstack(x).astype(float) if x is not None and len(x) else empty, coarse, fine) for x in s])

    return rows.withColumn(alias, embed(seq))
