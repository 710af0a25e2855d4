"""Series of any length, dealt to ranges: framed windows with halo rows, runs, and running products by block scans.

The operators of series.py sort a whole series in one task, which is right for recordings. Here rows are dealt once to ranges of (keys, order),
as many as there are shuffle partitions, and the ranges are written; one row a range says where it starts. A framed window needs
the neighbours of each range, so its outermost rows are copied to the ranges beside it (however short those are). A running result is made within
ranges, and what earlier ranges of the series come to is put before it.

`order` must tell the rows of a series apart; null keys are a series of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions import quaternions as q
from ..sources.scratch import settled


def ranges(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with range__ and place__, their place among all in the order of keys and order; range__, from__, rows__ of each range)."""
    number = F.monotonically_increasing_id()  # of a sorted partition: its number, and the places within
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("m__", number)
    dealt = settled(dealt.withColumn("range__", F.shiftright("m__", 33).cast("int")).withColumn("in__", F.col("m__").bitwiseAND((1 << 33) - 1)).drop("m__"))
    sizes = sorted(dealt.groupBy("range__").count().collect())  # a row a range
    starts = np.concatenate([[0], np.cumsum([r[1] for r in sizes])]).tolist()
    table = dealt.sparkSession.createDataFrame([(r[0], starts[i], r[1]) for i, r in enumerate(sizes)], "range__ int, from__ long, rows__ long")
    placed = dealt.join(F.broadcast(table), "range__").withColumn("place__", F.col("from__") + F.col("in__"))
    return placed.select(*[f"`{c}`" for c in rows.columns], "range__", "place__"), table


def framed(rows: DataFrame, keys: list[str], order: list[str], before: int, after: int, made: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows with the columns of made(w), functions over windows w along each series that reach at most `before` rows back and `after` ahead.

    Copies of rows at the ends of a range go to every range that their reach touches, and are dropped again."""
    placed, table = ranges(rows, keys, order)
    spans = [(r["from__"], r["from__"] + r["rows__"], r["range__"]) for r in table.collect()]
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for a, b, k in spans]) if spans else F.array().cast("array<struct<a: bigint, b: bigint, k: int>>")
    p = F.col("place__")
    touched = F.filter(every, lambda s: (s["a"] <= p + before) & (s["b"] > p - after) & (s["k"] != F.col("range__")))
    edge = placed.join(F.broadcast(table), "range__").where((p < F.col("from__") + after) | (p >= F.col("from__") + F.col("rows__") - before)).drop("from__", "rows__")
    halo = edge.withColumn("to__", F.explode(F.transform(touched, lambda s: s["k"]))).withColumn("range__", F.col("to__")).drop("to__").withColumn("own__", F.lit(False))
    w = Window.partitionBy("range__", *keys).orderBy("place__")
    both = placed.withColumn("own__", F.lit(True)).unionByName(halo)
    return both.select("*", *[c.alias(name) for name, c in made(w).items()]).where("own__").drop("own__", "range__", "place__")


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """rows with the total of value up to and with each, of series of any length."""
    placed, _ = ranges(rows.withColumn("add__", value), keys, order)
    return _running(placed, keys, "add__", alias).drop("add__", "range__", "place__")


def _running(placed: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    totals = placed.groupBy(*keys, "range__").agg(F.sum(value).alias("sum__"))
    earlier = F.sum("sum__").over(Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"{k}__of") for k in keys], F.col("range__").alias("r__"), F.coalesce(earlier, F.lit(0)).alias("carry__"))
    inside = F.sum(value).over(Window.partitionBy("range__", *keys).orderBy("place__").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("range__") == F.col("r__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__of"))
    out = placed.withColumn("inside__", F.coalesce(inside, F.lit(0))).join(totals, same)
    return out.withColumn(alias, F.col("inside__") + F.col("carry__")).drop("inside__", "carry__", "r__", *[f"{k}__of" for k in keys])


def islands(rows: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Flagged rows with island, the number of their run of neighbours that are all flagged, in series of any length."""
    flagged = rows.withColumn("flag__", F.coalesce(flag, F.lit(False)))
    start = lambda w: {"start__": (F.col("flag__") & ~F.coalesce(F.lag("flag__").over(w), F.lit(False))).cast("long")}
    marked = framed(flagged, keys, order, 1, 0, start)
    return running(marked, keys, order, F.col("start__"), "island").where("flag__").drop("flag__", "start__")


def _products(table: np.ndarray) -> np.ndarray:
    """Running Hamilton products of rows, by doubling: the product of 2, 4, 8 ... rows up to each."""
    out, step = table.copy(), 1
    while step < len(out):
        a, b = out[:-step], out[step:]
        w = a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(axis=1, keepdims=True)
        v = a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])
        out = np.vstack([out[:step], np.hstack([w, v])])
        step *= 2
    return out


def cumulative_product(rows: DataFrame, keys: list[str], order: list[str], quaternion: str, alias: str = "product") -> DataFrame:
    """rows with the product of all quaternions of the series up to each row: products within ranges, then those of its earlier ranges before them.

    A series that lies in one range needs nothing from others, so the products that are put in order number at most two a range."""
    placed, _ = ranges(rows, keys, order)
    schema = T.StructType([*placed.schema.fields, T.StructField("local__", T.ArrayType(T.DoubleType()))])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("place__")
        values = np.array(table.column(quaternion).to_pylist(), float).reshape(-1, 4)
        return table.append_column("local__", pa.array(list(_products(values)), pa.list_(pa.float64())))

    local_rows = settled(placed.groupBy("range__", *keys).applyInArrow(local, schema))
    last = local_rows.groupBy(*keys, "range__").agg(F.max_by("local__", "place__").alias("whole__"))
    parts = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("range__", "whole__"))).alias("parts__")).where("size(parts__) > 1")
    start = F.struct(F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("p"), F.array().cast("array<struct<r: int, before: array<double>>>").alias("out"))
    step = lambda s, x: F.struct(q.product(s["p"], x["whole__"]).alias("p"), F.concat(s["out"], F.array(F.struct(x["range__"].alias("r"), s["p"].alias("before")))).alias("out"))
    carried = parts.select(*[F.col(k).alias(f"{k}__of") for k in keys], F.explode(F.aggregate("parts__", start, step)["out"]).alias("c__"))
    same = F.col("range__") == F.col("c__.r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__of"))
    out = local_rows.join(carried, same, "left")
    product = F.when(F.col("c__").isNull(), F.col("local__")).otherwise(q.product("c__.before", "local__"))
    return out.withColumn(alias, product).select(*[f"`{c}`" for c in rows.columns], alias)
