"""Summary expressions whose definitions differ between systems, fixed here once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col


def deviation(c: Column | str) -> Column:
    """Sample standard deviation; 0 for a single value."""
    c = col(c)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def four_numbers(c: Column | str, prefix: str = "") -> list[Column]:
    c = col(c)
    return [F.min(c).alias(f"{prefix}min_distance"), F.max(c).alias(f"{prefix}max_distance"), F.avg(c).alias(f"{prefix}average_distance"), deviation(c).alias(f"{prefix}standard_deviation")]


def errors(actual: Column | str, predicted: Column | str) -> list[Column]:
    """mae, rmse and max_error."""
    e = col(actual) - col(predicted)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error")]


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean weighted over the rows that have a finite value and a weight; null without any."""
    value, weight = col(value), col(weight)
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & weight.isNotNull()
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0.0))
