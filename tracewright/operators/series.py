"""Ordered-series operators over (series key, order column) rows: one shuffle by the key each, shared by what follows on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.scratch import settled


def along(keys: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def points_order(w: WindowSpec) -> Column:
    return F.row_number().over(w).cast("long")


def difference(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c).over(w)


def step_length(coordinates: list[str], w: WindowSpec) -> Column:
    return F.sqrt(sum((F.pow(difference(c, w), 2) for c in coordinates[1:]), F.pow(difference(coordinates[0], w), 2)))


def moving(agg: Column, w: WindowSpec, before: int, after: int) -> Column:
    return agg.over(w.rowsBetween(-before, after))


def moving_median(c: str, w: WindowSpec, width: int) -> Column:
    """Median of `width` rows around each; an even width reaches one row further back than ahead."""
    return moving(F.expr(f"percentile(`{c}`, 0.5)"), w, width // 2, width - width // 2 - 1)


def moving_mean(c: str, w: WindowSpec, width: int) -> Column:
    return moving(F.avg(c), w, width // 2, width - width // 2 - 1)


def envelope(c: str, w: WindowSpec, reach: int) -> tuple[Column, Column]:
    return moving(F.min(c), w, reach, reach), moving(F.max(c), w, reach, reach)


def islands(rows: DataFrame, flag: Column, keys: list[str], order: list) -> DataFrame:
    """Flagged rows with island, the number of their run of neighbours that are all flagged."""
    w = along(keys, order)
    rows = rows.withColumn("flag__", F.coalesce(flag, F.lit(False)))
    starts = F.col("flag__") & ~F.coalesce(F.lag("flag__").over(w), F.lit(False))
    rows = rows.withColumn("start__", starts.cast("int"))
    return rows.withColumn("island", F.sum("start__").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).where("flag__").drop("flag__", "start__")


def changes(c: str, w: WindowSpec) -> Column:
    """True where a value differs from that of the row before."""
    return F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))


def near_changes(rows: DataFrame, c: str, keys: list[str], order: list, reach: int) -> DataFrame:
    """Rows within `reach` rows of a change of the column."""
    w = along(keys, order)
    marked = rows.withColumn("change__", changes(c, w).cast("int"))
    return marked.where(F.col("change__") >= 0).withColumn("near__", F.max("change__").over(w.rowsBetween(-reach, reach))).where("near__ = 1").drop("change__", "near__")


def every_nth(rows: DataFrame, n: int, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("k__", F.row_number().over(along(keys, order))).where(F.col("k__") % n == (1 if n > 1 else 0)).drop("k__")


def groups_of(size: int, w: WindowSpec) -> Column:
    """0 for the first `size` rows, 1 for the next, and so on."""
    return F.floor((F.row_number().over(w) - 1) / size).cast("long")


def inner_segments(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows between the first segment (kept) and the last (dropped), by segment number."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("last__", F.max(number).over(w)).where(F.col(number) < F.col("last__")).drop("last__")


def without_lead_in(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows without segment 0 and without the last segment, which may be cut off."""
    return inner_segments(rows, keys, number).where(F.col(number) != 0)


def standstill(rows: DataFrame, step: str, keys: list[str], order: list, most: float = 0.15) -> DataFrame:
    """Rows of the first run of small steps of each series; small is below min(most, mean + 2 deviations)."""
    whole = Window.partitionBy(*keys)
    limit = F.least(F.lit(most), F.avg(step).over(whole) + 2 * F.coalesce(F.stddev_samp(step).over(whole), F.lit(0.0)))
    rows = rows.withColumn("limit__", limit)
    return islands(rows, F.col(step) < F.col("limit__"), keys, order).where("island = 1").drop("island", "limit__")


def path_kind(length: Column, chord: Column, tolerance: float = 0.03) -> Column:
    """'linear' if the path is as long as its chord within the tolerance, else 'spline'."""
    return F.when(F.abs(length - chord) <= tolerance * chord, F.lit("linear")).otherwise(F.lit("spline"))


def modal_bin(rows: DataFrame, keys: list[str], c: str, width: float) -> DataFrame:
    """The fullest bin of each group: bin (lower edge) and n; the lower bin on a tie."""
    bins = rows.groupBy(*keys, (F.floor(F.col(c) / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin")))
    return bins.groupBy(*keys).agg(best.alias("b__")).select(*keys, "b__.bin", "b__.n")


def most_frequent(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The most frequent combination of values of each group, and its count; the smallest combination on a tie."""
    counted = rows.groupBy(*keys, *values).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), *values)
    return counted.withColumn("k__", F.row_number().over(w)).where("k__ = 1").drop("k__")


def points_between(events: DataFrame, keys: list[str], order: list, coordinates: list[str], count: Column) -> DataFrame:
    """Nominal points: for each row and the next one of its series `count` (at least one) points at even steps on the line
    between, with segment (from 1), point (from 1) and the coordinates."""
    w = along(keys, order)
    rows = events.select(*keys, F.row_number().over(w).cast("long").alias("segment"), count.cast("int").alias("count__"), *[F.struct(F.col(c).alias("a"), F.lead(c).over(w).alias("b")).alias(c) for c in coordinates], F.lead(F.lit(1)).over(w).alias("next__"))
    rows = rows.where("next__ = 1 and count__ >= 1").withColumn("i__", F.explode(F.sequence(F.lit(0), F.col("count__") - 1)))
    share = F.when(F.col("count__") > 1, F.col("i__") / (F.col("count__") - 1)).otherwise(F.lit(1.0))  # a single point is the last one
    return rows.select(*keys, "segment", (F.col("i__") + 1).cast("long").alias("point"), *[(F.col(f"{c}.a") + share * (F.col(f"{c}.b") - F.col(f"{c}.a"))).alias(c) for c in coordinates])


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """rows with the total of value over the rows of their group up to and with them. Groups of any size are split: rows are
    dealt to ranges of (keys, order), and the totals of a group's earlier ranges, a row for each, are added.

    `order` must tell the rows of a group apart."""
    ranged = settled(rows.withColumn("add__", value).repartitionByRange(*keys, *order).withColumn("range__", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "range__").agg(F.sum("add__").alias("sum__"))
    earlier = F.sum("sum__").over(Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"{k}__of") for k in keys], F.col("range__").alias("r__"), F.coalesce(earlier, F.lit(0)).alias("before__"))
    inside = F.sum("add__").over(Window.partitionBy("range__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("range__") == F.col("r__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__of"))
    out = ranged.withColumn("inside__", inside).join(totals, same)
    return out.select(*[f"`{c}`" for c in rows.columns], (F.col("inside__") + F.col("before__")).alias(alias))


#: Accuracy of the sketch that brackets percentiles; groups of up to SMALL_GROUP values are looked at whole; groups whose brackets are broadcast.
SKETCH, SMALL_GROUP, FEW_GROUPS = 10_000, 20_000, 5_000


def midpoint_percentiles(rows: DataFrame, keys: list[str], c: str, percents: list[float]) -> DataFrame:
    """p<percent> columns: the i-th of n sorted values stands at (i - 1/2) / n, with linear steps between. Exact, by selection.

    A mergeable sketch of each group gives brackets that hold the wanted places for certain (its rank error is a SKETCH-th of the group at most). One pass then
    counts the values below each bracket where they are and keeps the few inside, value by value; only those are put in order."""
    v = rows.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("v__"))
    margin = 2.5 / SKETCH
    shares = [min(1.0, max(0.0, p / 100 + side * margin)) for p in percents for side in (-1, 1)]
    sketch = v.groupBy(*keys).agg(F.count("*").alias("n__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"), F.percentile_approx("v__", shares, SKETCH).alias("q__"))
    one = lambda i, low, high: F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"))
    end = lambda k, column: F.col(column) if shares[k] in (0.0, 1.0) else F.col("q__")[k]
    whole = F.array(one(-1, F.col("lo__"), F.col("hi__")))
    narrow = F.array(*[one(i, end(2 * i, "lo__"), end(2 * i + 1, "hi__")) for i in range(len(percents))])
    sketch = sketch.select(*[F.col(k).alias(f"{k}__of") for k in keys], "n__", F.when(F.col("n__") <= SMALL_GROUP, whole).otherwise(narrow).alias("b__"))
    few = sketch.limit(FEW_GROUPS + 1).collect()  # of many groups none is large, and a join by key deals them evenly
    if len(few) <= FEW_GROUPS:
        sketch = F.broadcast(rows.sparkSession.createDataFrame(few, sketch.schema))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}__of"))
        met = v.join(sketch, same)
    else:
        met = v.crossJoin(sketch)
    spot = F.transform(F.filter("b__", lambda b: F.col("v__") <= b["high"]), lambda b: F.struct(b["i"].alias("i__"), F.when(F.col("v__") >= b["low"], F.col("v__")).alias("x__")))
    counted = met.select(*keys, "n__", F.explode(spot).alias("s__")).groupBy(*keys, "n__", "s__.i__", "s__.x__").agg(F.count("*").alias("m__"))  # those below are one row
    upto = counted.withColumn("upto__", F.sum("m__").over(Window.partitionBy(*keys, "i__").orderBy(F.col("x__").asc_nulls_first())))
    out = []
    for i, p in enumerate(percents):
        at = F.greatest(F.lit(1.0), F.least(F.col("n__").cast("double"), p / 100 * F.col("n__") + 0.5))
        low = F.floor(at)
        mine = F.col("i__").isin(-1, i) & F.col("x__").isNotNull()
        covers = lambda k: mine & (F.col("upto__") >= k) & (F.col("upto__") - F.col("m__") < k)  # noqa: E731, B023
        a = F.max(F.when(covers(low), F.col("x__")))
        b = F.max(F.when(covers(F.least(low + 1, F.col("n__"))), F.col("x__")))
        out.append((a + (b - a) * F.max(at - low)).alias(f"p{p:g}".replace(".", "_")))
    return upto.groupBy(*keys).agg(*out)
