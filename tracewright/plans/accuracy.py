"""Accuracy evaluation: pending trajectories, poses in the robot frame, every metric, summaries per segment and trajectory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quaternions as q
from ..operators import alignment, joins, summary

POSITION_METRICS, ORIENTATION_METRICS = ("point_to_curve", "sidtw", "dtw", "frechet", "lcss"), ("qad", "qdtw")


def in_robot_frame(poses: DataFrame, matrices: DataFrame, date: str = "recording_date") -> DataFrame:
    """poses(…, position, orientation [w,x,y,z], date) with position, orientation and angles in the robot frame.

    matrices(valid_from, offset, instrument_to_robot) are dated; a pose takes the newest that is not younger than it."""
    dated = joins.asof(poses, matrices, date, "valid_from", right_columns=["offset", "instrument_to_robot"])
    turned = dated.withColumn("orientation", q.tracker_to_instrument("orientation"))
    posed = turned.withColumn("t__", q.matmul4(q.homogeneous("orientation", "position"), "offset"))
    moved = posed.withColumn("p__", q.position_part("t__")).withColumn("o__", q.from_rotation(q.rotation_part("t__"))).withColumn("tool_angles", q.euler_fixed_xyz("o__"))
    out = moved.withColumn("position", q.transform_point("instrument_to_robot", "p__")).withColumn("orientation", q.transform_quaternion("instrument_to_robot", "o__"))
    return out.withColumn("angles", q.euler_fixed_xyz("orientation")).drop("p__", "o__", "t__", "offset", "instrument_to_robot")


def evaluate(nominal: DataFrame, measured: DataFrame, metrics: tuple[str, ...] = POSITION_METRICS, granularity: str = "trajectory", done: DataFrame | None = None, dims: int = 3) -> dict[str, tuple[DataFrame, DataFrame]]:
    """metric -> (info, deviations), lazily, over all trajectories that are not done yet; positions have `dims` coordinates."""
    if done is not None:
        nominal, measured = (joins.pending(df, done, "traj_id") for df in (nominal, measured))
    out = {}
    for metric in metrics:
        deviations = alignment.align(nominal, measured, metric, 4 if metric in ORIENTATION_METRICS else dims, granularity=granularity)
        out[metric] = (summary.info(deviations.where("status = 'ok'"), "distance"), deviations)
    return out


def all_metrics(results: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The whole-trajectory rows of every metric."""
    return summary.cross_metric({m: info.where(F.col("traj_id").cast("string") == F.col("seg_id")) for m, (info, _) in results.items()})


FIGURES = ("min_distance", "max_distance", "average_distance", "standard_deviation")


def whole_summaries(nominal: DataFrame, measured: DataFrame, metrics: tuple[str, ...] = POSITION_METRICS, by_segment: tuple[str, ...] = (), dims: int = 3, traj: str = "traj_id") -> DataFrame:
    """all_metrics() of evaluate() in one pass: metric, traj_id and the four figures of every trajectory, also of metrics by segment
    (named <metric>_by_segment), whose distances are pooled.

    Both sides of a trajectory are read once for all metrics, and only its figures leave the kernel, no row a point."""
    kind = dict(nominal.dtypes)[traj]

    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by("ord")
        v = table.column("v").combine_chunks()
        points = np.array(v.to_pylist(), dtype=float).reshape(len(table), -1)[:, :dims] if len(table) else np.zeros((0, dims))
        return points, table.column("seg_id").to_numpy()

    def distances(metric: str, x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        return alignment.distances_of(metric, x, y, xs, ys, dims)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (x, xs), (y, ys) = side(left), side(right)
        found = {metric: distances(metric, x, y, xs, ys) for metric in metrics}
        for metric in by_segment:
            parts = [distances(metric, x[xs == g], y[ys == g], xs[xs == g], ys[ys == g]) for g in dict.fromkeys(xs.tolist())]
            found[f"{metric}_by_segment"] = np.concatenate(parts) if parts else np.zeros(0)
        found = {m: d for m, d in found.items() if len(d)}
        figures = [(d.min(), d.max(), d.mean(), d.std(ddof=1) if len(d) > 1 else 0.0) for d in found.values()]
        columns = {c: pa.array([float(f[i]) for f in figures], pa.float64()) for i, c in enumerate(FIGURES)}
        return pa.table({"metric": pa.array(list(found), pa.string()), traj: pa.array([key[0].as_py()] * len(found), key[0].type), **columns})

    need = [traj, "seg_id", "ord", "v"]
    schema = f"metric string, {traj} {kind}, " + ", ".join(f"{c} double" for c in FIGURES)
    return nominal.select(*need).groupBy(traj).cogroup(measured.select(*need).groupBy(traj)).applyInArrow(run, schema)
