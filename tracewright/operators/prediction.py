"""Error prediction from retrieved neighbours, feature neighbours, and constant predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, vectors
from ..sources.scratch import settled
from . import blocks, ranking, sequence_blocks, series

#: Added to a distance before it is inverted to a weight.
DISTANCE_GUARD = 1e-6
#: Fixed scale of the speed features of the feature neighbours (the metadata embedding uses another).
FEATURE_TWIST = 3200.0


def from_neighbours(found: DataFrame, targets: DataFrame, target: str, n: int, weight: str = "score", rrf_power: int = 1) -> DataFrame:
    """query_id, mean, weighted, n: mean and weighted mean of the stored target over the first n neighbours that have one.

    found(query_id, id, rank, and score or distance). weight 'score' uses score to the power rrf_power, 'distance' its inverse."""
    w = F.pow("rrf_score", F.lit(float(rrf_power))) if weight == "score" else 1 / (F.col("distance") + DISTANCE_GUARD)
    known = targets.where(F.col(target).isNotNull() & ~F.isnan(target)).select("id", F.col(target).alias("t__"))
    rows = found.join(known, "id").withColumn("w__", w)
    best = ranking.top_k(rows, ["query_id"], ["rank", "id"], n, "k__")
    return best.groupBy("query_id").agg(F.avg("t__").alias("mean"), stats.weighted_mean("t__", "w__").alias("weighted"), F.count("*").alias("n"))


def decomposed(segment_predictions: DataFrame, segments: DataFrame, value: str = "weighted") -> DataFrame:
    """query_id, prediction: predictions of a trajectory's segments, weighted by segment length; missing ones are ignored.

    segments(segment_id, query_id, length)."""
    rows = segments.join(segment_predictions.withColumnRenamed("query_id", "segment_id"), "segment_id", "left")
    return rows.groupBy("query_id").agg(stats.weighted_mean(value, "length").alias("prediction"))


def clamp01(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def features(twist: dict, acceleration: dict, length: str, duration: str, movement: str | None = None):
    """Feature vector of a trajectory: scaled statistics of speed and acceleration, length, duration and movement share; missing ones are 0."""
    parts = []
    for columns, most in ((twist, FEATURE_TWIST), (acceleration, vectors.MAX_ACCELERATION)):
        for s in vectors.STATISTICS:
            c = F.col(columns[s])
            parts.append(clamp01(c / most if s == "std" else (c + most) / (2 * most)))
    parts += [clamp01(F.col(length) / vectors.MAX_LENGTH), clamp01(F.col(duration) / vectors.MAX_DURATION)]
    parts.append(vectors.movement_share(movement, "l", "linear")[0] if movement else F.lit(0.0))
    return F.array(*[F.coalesce(F.nanvl(p.cast("double"), F.lit(0.0)), F.lit(0.0)) for p in parts])


def feature_neighbours(queries: DataFrame, rows: DataFrame, k: int, same_parent: bool = True, digits: int | None = None) -> DataFrame:
    """query_id, id, distance, rank of the k nearest feature vectors.

    queries(query_id, query_vec[, query_parent]), rows(id, vec, target[, parent]); rows without a target, the query
    itself and, with same_parent, rows of its trajectory are left out."""
    usable = rows.where(F.col("target").isNotNull())
    apart = ("parent", "query_parent") if same_parent and "parent" in rows.columns else None
    best = ranking.top_k(blocks.distances(queries, usable, "euclidean", k, digits, apart), ["query_id"], ["distance", "id"], k)
    return best.join(usable.select("id", "target"), "id").select("query_id", "id", "target", "distance", "rank")


def reranked_by_dtw(neighbours: DataFrame, sequences: DataFrame, **rerank) -> DataFrame:
    """feature_neighbours() in the order of constrained DTW: rank is the new place, distance the DTW distance; target stays. sequences(id, seq)."""
    done = staged_rerank(neighbours.select("query_id", "id", F.col("rank").alias("rank_s1"), "target"), sequences, **rerank)
    return done.select("query_id", "id", "target", F.col("dtw_dist").alias("distance"), F.col("rank_s2").alias("rank"))


def predictions_at(neighbours: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k, mean, weighted for several k out of one neighbour list."""
    rows = neighbours.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    return rows.groupBy("query_id", "k").agg(F.avg("target").alias("mean"), stats.weighted_mean("target", 1 / (F.col("distance") + DISTANCE_GUARD)).alias("weighted"))


def constant_predictors(rows: DataFrame, target: str) -> DataFrame:
    """predictor ('mean', 'median'), value, n and the errors of predicting it for every row. Two aggregations, one row joined back."""
    known = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("t__"))
    values = known.agg(F.avg("t__").alias("mean")).crossJoin(F.broadcast(series.midpoint_percentiles(known, [], "t__", [50]).withColumnRenamed("p50", "median")))
    each = values.select(F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).alias("value")) for p in ("mean", "median")])).alias("p__"))
    return known.crossJoin(F.broadcast(each.select("p__.*"))).groupBy("predictor", "value").agg(F.count("*").alias("n"), *stats.errors("t__", "value"))


def neighbour_coverage(neighbours: DataFrame, errors: DataFrame) -> DataFrame:
    """Correlation between the distance of a query's nearest neighbour and its prediction error. errors(query_id, error)."""
    nearest = neighbours.groupBy("query_id").agg(F.min("distance").alias("distance"))
    return nearest.join(errors, "query_id").agg(F.count("*").alias("n"), F.corr("distance", "error").alias("correlation"))


def split(candidates: DataFrame, sequences: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates without sequences, sequences(id, seq), queries(query_id, query_seq)): candidates that carry both sequences give them up,
    one an id; for others the queries' are those of their ids in `sequences`."""
    if sequences is None:
        return candidates.drop("query_seq", "seq"), candidates.select("id", "seq").dropDuplicates(["id"]), candidates.select("query_id", "query_seq").dropDuplicates(["query_id"])
    return candidates, sequences.select("id", "seq"), sequences.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq"))


def staged_rerank(candidates: DataFrame, sequences: DataFrame | None = None, kim_share: float | Column = 1.0, keogh_most: int = 500, window: float = 0.2, mode: str = "position", normalise: bool = False, half_up: bool = False) -> DataFrame:
    """candidates(query_id, id, rank_s1, …) with dtw_dist, rank_s2 and rank_change after two lower-bound filters. sequences(id, seq), unless the candidates carry query_seq and seq.

    kim_share of a query's candidates (rounded up, or half up) survive the first bound, keogh_most of those the second; the rest
    keep an infinite distance and their first-stage order. The bounds are heuristic for position sequences, so near ones may be
    lost; exact_rerank() loses none. Only ids, bounds and ranks are put in order; sequences meet the pairs that a stage compares."""
    q = Window.partitionBy("query_id")

    def measured(pairs: DataFrame, measure: str, alias: str, **options) -> DataFrame:
        return sequence_blocks.listed(pairs, sequences, queries, measure, alias, mode=mode, normalise=normalise, **options)

    candidates, sequences, queries = split(candidates, sequences)
    candidates, left = settled(candidates), lambda c: F.lit(None).cast("double").alias(c)
    limit = F.count("*").over(q) * (kim_share if isinstance(kim_share, Column) else F.lit(kim_share))
    limit = F.floor(limit + 0.5) if half_up else F.ceil(limit)
    rows = measured(candidates, "kim_bound", "kim__")
    rows = rows.withColumn("k__", F.row_number().over(q.orderBy("kim__", "rank_s1"))).withColumn("stay__", F.col("k__") <= limit)
    rows = settled(rows.drop("k__", "kim__"))  # what has left is put aside, and only the others are compared further
    out = rows.where("not stay__").drop("stay__")
    second = measured(rows.where("stay__").drop("stay__"), "keogh_bound", "keogh__", window=window)
    second = second.withColumn("k__", F.row_number().over(q.orderBy(F.col("keogh__").asc_nulls_last(), "rank_s1"))).drop("keogh__")
    second = settled(second)
    out = out.unionByName(second.where(F.col("k__") > keogh_most).drop("k__"))
    third = measured(second.where(F.col("k__") <= keogh_most).drop("k__"), "constrained_dtw", "d__", window=window)
    rows = third.unionByName(out.select("*", left("d__"))).withColumn("dtw_dist", F.coalesce("d__", F.lit(float("inf")))).drop("d__")
    rows = ranking.rank_by(rows, ["query_id"], ["dtw_dist", "rank_s1"], "rank_s2")
    return rows.withColumn("rank_change", F.col("rank_s1") - F.col("rank_s2"))


#: Lists of up to so many candidates are compared whole by the full distance.
SMALL_LIST = 500


def adaptive_rerank(candidates: DataFrame, sequences: DataFrame | None = None, **options) -> DataFrame:
    """staged_rerank that filters only queries with more than SMALL_LIST candidates: nine tenths pass the first bound, SMALL_LIST the second."""
    share = F.when(F.count("*").over(Window.partitionBy("query_id")) <= SMALL_LIST, F.lit(1.0)).otherwise(F.lit(0.9))
    return staged_rerank(candidates, sequences, kim_share=share, keogh_most=SMALL_LIST, **options)


#: How many times more candidates each round of exact_rerank looks at than all before it.
GROWTH = 4


def exact_rerank(candidates: DataFrame, k: int, sequences: DataFrame | None = None, window: float = 0.2, dims: int = 3) -> DataFrame:
    """The k candidates of each query with the smallest constrained DTW of positions: query_id, id, dtw_dist, rank_s2, dtw_calls.

    A path pairs both last points and pairs every extreme with something inside the other's extent, so Kim's bound of the
    moved, not resampled sequences never exceeds the distance. Candidates are looked at in the order of that bound, in rounds of growing size. A
    round gets the k-th distance of each query so far: candidates whose bound is over it are skipped, with all after them, and
    an alignment is given up as soon as no path can come up to it. Nothing else can be among the k nearest. Ids, bounds and distances are
    what rounds hand on; sequences only meet the pairs of a round."""
    candidates, sequences, queries = split(candidates, sequences)
    ordered = sequence_blocks.listed(candidates.select("query_id", "id"), sequences, queries, "moved_bound", "bound__", dims=dims)
    ordered = settled(ranking.rank_by(ordered, ["query_id"], ["bound__", "id"], "order__"))
    most = ordered.agg(F.coalesce(F.max("order__"), F.lit(0))).first()[0]
    done, upto, best = None, 0, None
    while upto < most or done is None:
        first, upto = upto, max(k, GROWTH * upto)
        part = ordered.where((F.col("order__") > first) & (F.col("order__") <= upto))
        if best is not None:  # a hair of slack, as both sides are rounded
            limits = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("dtw_dist")).alias("limit__"))
            part = part.join(limits, "query_id", "left").where(F.col("limit__").isNull() | (F.col("bound__") <= F.col("limit__") * (1 + 1e-9) + 1e-9))
        else:
            part = part.withColumn("limit__", F.lit(None).cast("double"))
        part = part.select("query_id", "id", (F.col("limit__") * (1 + 1e-9) + 1e-9).alias("limit__"))
        fresh = sequence_blocks.listed(part, sequences, queries, "constrained_dtw", "dtw_dist", best="limit__", window=window)
        fresh = settled(fresh.select("query_id", "id", "dtw_dist"))
        done = fresh if done is None else done.unionByName(fresh)
        best = settled(ranking.top_k(done, ["query_id"], ["dtw_dist", "id"], k, "rank_s2"))
    calls = done.groupBy("query_id").agg(F.count("*").alias("dtw_calls"))
    return best.join(calls, "query_id").select("query_id", "id", "dtw_dist", "rank_s2", "dtw_calls")


def savings(reranked: DataFrame) -> DataFrame:
    """query_id, candidates, dtw_calls, saved_percent: how many full distances the bounds spared."""
    done = F.sum((F.col("dtw_dist") < float("inf")).cast("long"))
    return reranked.groupBy("query_id").agg(F.count("*").alias("candidates"), done.alias("dtw_calls"), (100 * (1 - done / F.count("*"))).alias("saved_percent"))
