"""A bounded, repeatable sample of labelled documents as sparse hashed features, for the two classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def sample_ids(labels: DataFrame, label: str, usable, per_class: tuple[int, int], id_col: str = "doc_id") -> DataFrame:
    """sample_id, y of at most per_class[y] labelled ids of each class, those with the smallest hash of their id.

    The choice does not depend on partitioning; `usable` is a condition on the id. Null ids and labels other than 0 and 1
    are left out; of a repeated id the largest label counts. The rows are fetched, so later joins broadcast a known size."""
    wanted = labels.select(F.col(f"`{id_col}`").alias("sample_id"), F.col(f"`{label}`").cast("int").alias("y"))
    wanted = wanted.where(F.col("y").isin(0, 1) & F.col("sample_id").isNotNull()).where(usable(F.col("sample_id")))
    wanted = wanted.groupBy("sample_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.col("sample_id").cast("string")), F.col("sample_id")]
    rows = [r for y, n in enumerate(per_class) for r in wanted.where(F.col("y") == y).orderBy(*order).limit(n).collect()]
    return labels.sparkSession.createDataFrame(rows, wanted.schema)


def sampled_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sample_id, text, y of the documents of sample_ids(), one row an id, written once so that the corpus is scanned once.

    Of the rows of a repeated id that with the smallest text hash counts, so the sample is bounded in rows, too."""
    rows = docs.select(F.col(f"`{id_col}`").alias("sample_id"), F.coalesce(common.text_column(docs, text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "sample_id").groupBy("sample_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return common.written(rows.select("sample_id", "least.text", "y").repartition(16), "sampled")


#: Most bytes of features that come to the driver, half of them for each class; as arrays there they take about three times that.
FEATURE_BYTES = 128 << 20


def sparse_rows(rows: DataFrame, features: Callable, most: int = FEATURE_BYTES):
    """(y, row starts, feature ids, feature values) of sampled_rows().

    Features are made on the executors and written; `features()` returns texts (bytes) -> [(ids, values)]. Of each class
    rows come to the driver in the order of the hash of their id until their features have half of `most` bytes."""

    def kernel():
        make = features()

        def step(batch):
            found = make(common.bytes_of(batch.column(1)))
            return [batch.column(0), batch.column(2), [np.asarray(i, "<i4").tobytes() for i, _ in found], [np.asarray(v, "<f4").tobytes() for _, v in found]]

        return step

    kind = dict(rows.dtypes)["sample_id"]
    sparse = common.written(common.map_texts(rows, ["sample_id", "text", "y"], f"sample_id {kind}, y int, ids binary, vals binary", kernel), "features")
    upto = F.sum(F.length("ids") + F.length("vals")).over(Window.partitionBy("y").orderBy(F.xxhash64(F.col("sample_id").cast("string")), "sample_id"))
    fitting = sparse.select("sample_id", "y", upto.alias("upto")).where(F.col("upto") <= most // 2).select("sample_id")  # as many rows as were sampled at most
    got = sorted(sparse.join(F.broadcast(fitting), "sample_id").collect(), key=lambda r: (str(r.sample_id), bytes(r.ids)))
    ids = [np.frombuffer(r.ids, "<i4") for r in got]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    none = [np.zeros(0, np.int32)]
    return (
        np.array([r.y for r in got], np.float64),
        starts,
        np.concatenate(ids or none),
        np.concatenate([np.frombuffer(r.vals, "<f4") for r in got] or none).astype(np.float64),
    )


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i+1]] for each i; empty rows give 0."""
    total = np.concatenate([[0.0], np.cumsum(values)]) if values.ndim == 1 else np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def platt(logits: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps with smoothed targets."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, a, b = np.where(y > 0, high, low), 1.0, 0.0
    scale = max(1e-9, float(np.std(logits))) if len(logits) else 1.0
    x = logits / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a - step[0] / size, b - step[1] / size
    return float(a / scale), float(b)
