"""Deviation summaries per segment and trajectory, prediction errors and their report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import series


def info(deviations: DataFrame, value: str, traj: str = "traj_id", seg: str = "seg_id", prefix: str = "") -> DataFrame:
    """min, max, average and standard deviation for every segment, and one row for the trajectory whose segment id is the
    trajectory id. One aggregation over grouping sets; nulls do not count."""
    rows = deviations.select(F.col(traj).alias(traj), F.col(seg).cast("string").alias(seg), F.col(value).alias("value__"))
    sets = rows.groupingSets([[traj, seg], [traj]], traj, seg).agg(*stats.four_numbers("value__", prefix), F.grouping(seg).alias("whole__"))
    return sets.withColumn(seg, F.when(F.col("whole__") == 1, F.col(traj).cast("string")).otherwise(F.col(seg))).drop("whole__")


def overview(rows: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    v = F.col(value)
    figures = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), stats.deviation(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = series.midpoint_percentiles(rows, keys, value, [50]).withColumnRenamed("p50", "median")
    figures = figures.join(middle, keys, "left") if keys else figures.crossJoin(F.broadcast(middle))  # one row each
    return figures.select(*keys, "n", "mean", "median", "std", "min", "max")


def prediction_errors(rows: DataFrame, actual: str, predicted: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *stats.errors(actual, predicted))


def average_ranks(rows: DataFrame, keys: list[str], c: str, alias: str) -> DataFrame:
    """rows with the average rank of c in its group: ties share the mean of their places. Null values get none.

    Values are counted, ranked in ranges, and met again by value, so no group is sorted in one task."""
    counted = rows.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("m__"))
    placed = series.running_total(counted, keys, [c], F.col("m__"), "upto__").select(*keys, c, (F.col("upto__") - (F.col("m__") - 1) / 2).alias(alias))
    return rows.join(placed, [*keys, c], "left")


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, "ra__"), keys, b, "rb__")
    return ranked.groupBy(*keys).agg(F.corr("ra__", "rb__").alias("spearman"))


def roll_up(segments: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over segments with a finite value."""
    return segments.groupBy(*keys).agg(stats.weighted_mean(value, weight).alias(value))


def series_header(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Points, start, end and sampling frequency (points per unit of time) of each series."""
    span = F.max(at) - F.min(at)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end"), F.when(span > 0, F.count("*") / span).alias("frequency"))


def cross_metric(tables: dict[str, DataFrame]) -> DataFrame:
    """The summaries of several metrics under each other with the metric's name."""
    out = None
    for name, df in tables.items():
        named = df.withColumn("metric", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def documents(deviations: DataFrame, key: str, order: str, value: str, factor: float = 0.001) -> DataFrame:
    """One nested document a trajectory: min, max, mean and all values in order, scaled (millimetres to metres)."""
    scaled = F.col(value) * factor
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), scaled.alias("v"))))
    return deviations.groupBy(key).agg(F.min(scaled).alias("min"), F.max(scaled).alias("max"), F.avg(scaled).alias("mean"), F.transform(ordered, lambda s: s.v).alias("values"))


def top_labels(rows: DataFrame, keys: list[str], score: Column, label: str, k: int = 5) -> DataFrame:
    """The k labels with the best scores of each group with their rank, smaller label first on a tie."""
    scored = rows.select(*keys, label, score.alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), label)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def finite_means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each value column the mean over the rows where it is finite, and their number n_<column>."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return rows.groupBy(*keys).agg(*[f for c in values for f in (F.avg(finite(c)).alias(c), F.count(finite(c)).alias(f"n_{c}"))])


def best_by(rows: DataFrame, keys: list[str], score: Column, label: str) -> DataFrame:
    """The row label with the best score of each group, smaller label on a tie."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(label, score.alias("score")), F.struct(score, F.lit(0))).alias("b__")).select(*keys, "b__.*")
