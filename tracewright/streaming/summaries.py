"""Running deviation summaries of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def windowed_info(stream: DataFrame, at: str, value: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """min, max, average and deviation per window and keys; state older than the watermark is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window, slide), *keys).agg(*stats.four_numbers(value)).select("window.start", "window.end", *keys, "min_distance", "max_distance", "average_distance", "standard_deviation")


def write_appending(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path)
