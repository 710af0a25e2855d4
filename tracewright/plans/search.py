"""Two-stage search with prediction, and validation sweeps over modalities and weights, each one plan without loops over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, blocks, prediction, ranking
from ..operators.vector_index import CosineIndex
from ..sources import tables


def first_stage(queries: DataFrame, rows: DataFrame, modalities: list[str], k: int, weights: DataFrame | None = None, digits: int | None = None, indexes: dict[str, CosineIndex] | None = None, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rankings of each modality, fused ranking). queries(query_id, <modality>), rows(id, <modality>); null vectors are left out.

    A modality with an index (of the same rows) is searched in it, in `probes` cells of each query; others, and all by default, exactly."""
    long = None
    for m in modalities:
        q = queries.where(F.col(m).isNotNull()).select("query_id", F.col(m).alias("query_vec"))
        r = rows.where(F.col(m).isNotNull()).select("id", F.col(m).alias("vec"))
        found = indexes[m].search(q, k, probes, digits) if indexes and m in indexes else ranking.cosine_top_k(q, r, k, digits)
        ranked = found.select("query_id", "id", "distance", "rank").withColumn("modality", F.lit(m))
        long = ranked if long is None else long.unionByName(ranked)
    return long, ranking.reciprocal_rank_fusion(long, weights)


def two_stage(queries: DataFrame, rows: DataFrame, modalities: list[str], sequences: DataFrame, k: int = 10, weights: DataFrame | None = None, indexes: dict[str, CosineIndex] | None = None, probes: int | None = None, **rerank) -> DataFrame:
    """Fused candidates of each query reranked by constrained DTW. sequences(id, seq)."""
    _, fused = first_stage(queries, rows, modalities, k, weights, indexes=indexes, probes=probes)
    best = fused.where(F.col("rank") <= k).withColumnRenamed("rank", "rank_s1")
    return prediction.staged_rerank(best, sequences, **rerank)


def experiment_data(points: DataFrame, metadata: DataFrame, query_ids: DataFrame, traj: str = "traj_id", seg: str = "seg_id") -> dict[str, DataFrame]:
    """What an experiment reads, each out of one scan: `queries` and `candidates` (whole trajectories with sequence and metadata;
    queries are no candidates), and the `segments` of either with their sequences.

    points(traj_id, seg_id, ord, v), metadata with both ids; metadata whose segment id is the trajectory id is of the whole one."""
    whole = tables.sequences(points, [traj]).join(tables.at_level(metadata, "trajectory", traj, seg).drop(seg), traj)
    ids = query_ids.select(F.col(query_ids.columns[0]).alias(traj)).distinct()
    parts = tables.sequences(points, [traj, seg]).join(tables.at_level(metadata, "segment", traj, seg), [traj, seg], "left")
    return {"queries": whole.join(ids, traj, "left_semi"), "candidates": whole.join(ids, traj, "left_anti"), "segments": parts.join(ids.withColumn("is_query", F.lit(True)), traj, "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))}


def predict(found: DataFrame, targets: DataFrame, target: str, n: int, rank: str = "rank_s2", rrf_power: int = 1) -> DataFrame:
    return prediction.from_neighbours(found.withColumn("rank", F.col(rank)), targets, target, n, "score", rrf_power)


def validation(rankings: DataFrame, weight_modes: DataFrame, reference: DataFrame, truth: DataFrame, ks: list[int], counts: DataFrame | None = None) -> DataFrame:
    """query_id, mode, k, recall, precision, mrr: fused rankings of every weight mode against a reference and the ground truth.

    rankings(query_id, modality, id, rank); weight_modes(mode, modality, weight). A mode is a key of every step, so all modes
    run in one plan. With counts(query_id, truths), truth only needs to hold what the rankings have."""
    weighted = rankings.join(F.broadcast(weight_modes.where("weight <> 0")), "modality")
    fused = weighted.groupBy("query_id", "mode", "id").agg(F.sum(F.col("weight") / (ranking.RRF_K + F.col("rank"))).alias("rrf_score"))
    fused = ranking.rank_by(fused, ["query_id", "mode"], [F.desc("rrf_score"), "id"])
    each = fused.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    marked = each.join(truth.withColumn("is_truth", F.lit(1)), ["query_id", "id"], "left").join(reference.select("query_id", "id", F.col("rank").alias("ref_rank")), ["query_id", "id"], "left")
    n = truth.groupBy("query_id").agg(F.count("*").alias("truths")) if counts is None else counts
    inside = F.col("rank") <= F.col("k")
    scored = marked.groupBy("query_id", "mode", "k").agg(
        F.sum(F.when(inside, F.col("is_truth"))).alias("hits"), F.sum((inside & (F.col("ref_rank") <= F.col("k"))).cast("int")).alias("common"),
        F.avg(F.when(F.col("is_truth") == 1, 1 / F.col("rank"))).alias("mrr"),
    )
    return scored.join(n, "query_id").select("query_id", "mode", "k", (F.coalesce("hits", F.lit(0)) / F.least("truths", "k")).alias("recall"), (F.col("common") / F.col("k")).alias("precision"), "mrr")


def embedding_sweep(rows: DataFrame, configs: list[tuple[str, int, int]], kinds: dict, velocity: str | None = None) -> DataFrame:
    """config, modality, vec of every row under every (name, coarse, fine), with the row's id (and level and parent, if it has them).

    kinds: modality -> function of (coarse, fine) that gives a vector expression over the row's columns, such as position,
    joint or orientation sequences or figures of the metadata; `velocity` names the sequence column of velocity embeddings."""
    keys = ["id", *[c for c in ("level", "parent") if c in rows.columns]]
    each = [F.struct(F.lit(name).alias("config"), F.lit(kind).alias("modality"), vector(coarse, fine).alias("vec")) for name, coarse, fine in configs for kind, vector in kinds.items()]
    out = rows.select(*keys, F.explode(F.array(*each)).alias("e__")).select("e__.config", "e__.modality", *keys, "e__.vec") if each else None
    for name, coarse, fine in configs if velocity else ():
        part = alignment.velocity_embeddings(rows, velocity, coarse, fine, "vec").select(F.lit(name).alias("config"), F.lit("velocity").alias("modality"), *keys, "vec")
        out = part if out is None else out.unionByName(part)
    return out


def sweep_search(embedded: DataFrame, is_query, k: int, digits: int | None = None) -> DataFrame:
    """config, modality, level, query_id, id, distance, rank: the nearest rows of the same configuration, modality and level for
    every row of embedding_sweep() that meets is_query; rows of the query's own trajectory (parent) are left out."""
    same = ["config", "modality", "level"]
    asked = embedded.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("parent").alias("query_parent"), *same)
    scored = blocks.distances(asked, embedded, "cosine", k, digits, ("parent", "query_parent"), same)
    return ranking.top_k(scored, [*same, "query_id"], ["distance", "id"], k)
