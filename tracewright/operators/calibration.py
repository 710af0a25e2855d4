"""Rigid calibration and mean orientations: sums are aggregated in Spark, only a 3x3 or 4x4 matrix reaches the driver or kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k


def rigid_transforms(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """keys, rotation (array of 9, row by row), translation, n: the transform x R + t of source points onto target points.

    One partial aggregation of 16 sums a group; the decomposition sees the sums only."""
    s, t = F.col(source), F.col(target)
    sums = [F.count("*").cast("double").alias("n__")] + [F.sum(s[i]).alias(f"x{i}__") for i in range(3)] + [F.sum(t[i]).alias(f"y{i}__") for i in range(3)]
    sums += [F.sum(s[i] * t[j]).alias(f"c{i}{j}__") for i in range(3) for j in range(3)]
    rows = pairs.groupBy(*keys).agg(*sums)
    packed = rows.select(*keys, F.array(*[F.col(c) for c in rows.columns if c.endswith("__")]).alias("sums"), F.col("n__").cast("long").alias("n"))

    @F.pandas_udf("rotation array<double>, translation array<double>")
    def fit(sums: pd.Series) -> pd.DataFrame:
        out = [k.rigid_fit(v[0], np.array(v[1:4]), np.array(v[4:7]), np.array(v[7:16]).reshape(3, 3)) for v in sums]
        return pd.DataFrame({"rotation": [r.ravel() for r, _ in out], "translation": [t for _, t in out]})

    return packed.withColumn("f__", fit("sums")).select(*keys, "f__.rotation", "f__.translation", "n")


def transformed(point, rotation, translation):
    """Expression p R + t for a row-by-row rotation of nine numbers."""
    p, r, t = (F.col(c) if isinstance(c, str) else c for c in (point, rotation, translation))
    return F.array(*[p[0] * r[j] + p[1] * r[3 + j] + p[2] * r[6 + j] + t[j] for j in range(3)])


def calibration_errors(pairs: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """n, mean, max and rms distance that the fitted transform leaves, for each group."""
    fits = rigid_transforms(pairs, keys, source, target)
    moved = pairs.join(fits, keys) if keys else pairs.crossJoin(F.broadcast(fits))  # without keys there is one fit
    d = moved.withColumn("m__", transformed(source, "rotation", "translation"))
    e = F.sqrt(sum((F.pow(F.col("m__")[i] - F.col(target)[i], 2) for i in (1, 2)), F.pow(F.col("m__")[0] - F.col(target)[0], 2)))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rms_error"))


def rest_points(points: DataFrame, keys: list[str], vector: str, deviations: float = 2.0) -> DataFrame:
    """Mean point of each group without components that lie over `deviations` standard deviations from their mean."""
    v = F.col(vector)
    first = points.groupBy(*keys).agg(*[f(v[i]).alias(f"{n}{i}__") for i in range(3) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    near = [F.abs(v[i] - F.col(f"m{i}__")) <= deviations * F.col(f"s{i}__") + 1e-12 for i in range(3)]
    rows = points.join(first, keys).where(near[0] & near[1] & near[2])
    return rows.groupBy(*keys).agg(F.array(*[F.avg(v[i]) for i in range(3)]).alias(vector), F.count("*").alias("n"))


def mean_orientations(rows: DataFrame, keys: list[str], quaternion: str, method: str = "eigen") -> DataFrame:
    """Mean quaternion of each group: normalised arithmetic mean, or main eigenvector of the summed outer products."""
    q = F.col(quaternion)
    if method == "arithmetic":
        means = rows.groupBy(*keys).agg(F.array(*[F.avg(q[i]) for i in range(4)]).alias("m__"))
        n = F.sqrt(F.aggregate("m__", F.lit(0.0), lambda s, x: s + x * x))
        return means.select(*keys, F.transform("m__", lambda x: x / n).alias(quaternion))
    sums = rows.groupBy(*keys).agg(F.array(*[F.sum(q[i] * q[j]) for i in range(4) for j in range(4)]).alias("o__"))

    @F.pandas_udf("array<double>")
    def main(outer: pd.Series) -> pd.Series:
        return pd.Series([k.mean_quaternion(np.array(o).reshape(4, 4)) for o in outer])

    return sums.select(*keys, main("o__").alias(quaternion))


def unwrap_near_half_turn(rows: DataFrame, keys: list[str], angles: list[str], margin: float = 5.0) -> DataFrame:
    """Angles in degrees of a series that comes within `margin` of a half turn have their negatives raised by a full turn."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    for c in angles:
        close = F.max((F.abs(F.abs(c) - 180) < margin).cast("int")).over(w) == 1
        rows = rows.withColumn(c, F.when(close & (F.col(c) < 0), F.col(c) + 360).otherwise(F.col(c)))
    return rows
