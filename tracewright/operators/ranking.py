"""Exact top-k search, fusion of rankings, and measures of ranking quality.

A stated query set is compared with all rows in one pass: queries are broadcast only while they have `MAX_BROADCAST_BYTES`
at most (they are measured first), else both sides are dealt in blocks of bounded size and joined block by block; each task
reduces its pairs to k rows a query before the shuffle by query (window group limit). Whole rankings are made in ranges, so
that no task holds all rows of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import blocks, series

#: Most bytes of a broadcast query set; of a block of queries; rows of a block.
MAX_BROADCAST_BYTES, BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 8 << 20, 50_000
RRF_K = 60.0


def rank_by(rows: DataFrame, keys: list[str], order: list, alias: str = "rank") -> DataFrame:
    return rows.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, alias: str = "rank") -> DataFrame:
    return rank_by(rows, keys, order, alias).where(F.col(alias) <= k)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: eight for a number, the length of texts, all components of vectors and sequences."""
    size = F.lit(8)
    for c, kind in df.dtypes:
        c = F.col(f"`{c}`")
        if kind.startswith("array<array"):
            size = size + F.coalesce(F.aggregate(c, F.lit(0), lambda s, x: s + 16 + 8 * F.coalesce(F.size(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 + 8 * F.greatest(F.size(c), F.lit(0))
        else:
            size = size + (F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8))
    return size


def pairs(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query with every row. Queries of MAX_BROADCAST_BYTES at most go to the rows; of more, both sides are dealt in
    blocks by their sizes, and each pair of blocks is a key of its own."""
    size = queries.agg(F.coalesce(F.sum(row_bytes(queries)), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        return rows.crossJoin(F.broadcast(queries))
    return _block_pairs(queries, rows, -(-size // BLOCK_BYTES), -(-max(1, rows.count()) // BLOCK_ROWS))


def _block_pairs(queries: DataFrame, rows: DataFrame, query_blocks: int, row_blocks: int) -> DataFrame:
    plain = lambda df: [f"`{c}`" for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    own = lambda df, n: F.pmod(F.xxhash64(*plain(df)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("query_block__", own(queries, query_blocks)).withColumn("row_block__", every(row_blocks))
    r = rows.withColumn("row_block__", own(rows, row_blocks)).withColumn("query_block__", every(query_blocks))
    return r.join(q, ["query_block__", "row_block__"]).drop("query_block__", "row_block__")


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, digits: int | None = None, allowed: Column | None = None) -> DataFrame:
    """queries(query_id, query_vec), rows(id, vec) -> query_id, id, distance, rank; the query itself is left out.

    Norms are computed once a row, not once a pair. Ties go to the smaller id; `digits` rounds before ranking."""
    few = cosine_distances(queries, rows, digits, allowed) if allowed is not None else blocks.distances(queries, rows, "cosine", k, digits)
    return top_k(few, ["query_id"], ["distance", "id"], k)


def cosine_ranking(queries: DataFrame, rows: DataFrame, digits: int | None = None, allowed: Column | None = None) -> DataFrame:
    """All rows of cosine_top_k, ranked in ranges of (query, distance). Where the first few are wanted, that is cheaper."""
    scored = cosine_distances(queries, rows, digits, allowed)
    return series.running_total(scored, ["query_id"], ["distance", "id"], F.lit(1).cast("long"), "rank")


def cosine_distances(queries: DataFrame, rows: DataFrame, digits: int | None = None, allowed: Column | None = None) -> DataFrame:
    """query_id, id, distance of every allowed pair, in no order."""
    if allowed is None:
        return blocks.distances(queries, rows, "cosine", digits=digits)
    q = queries.withColumn("qn__", vectors.norm("query_vec"))
    r = rows.withColumn("rn__", vectors.norm("vec"))
    both = pairs(q, r).where(allowed)
    d = 1 - vectors.dot("vec", "query_vec") / (F.col("rn__") * F.col("qn__") + vectors.COSINE_GUARD)
    return both.select("query_id", "id", (F.round(d, digits) if digits is not None else d).alias("distance"))


def cosine_ranks(queries: DataFrame, rows: DataFrame, digits: int, wanted: tuple[str, str]) -> DataFrame:
    """query_id, rank, nth, of: the ranks that cosine_ranking gives to the rows whose column wanted[0] equals the query's wanted[1]; each row is the
    nth of the query's `of` such rows. All pairs are ranked in packed blocks, and only these come out."""
    return blocks.ranks(queries, blocks.numbered(rows)[0], digits, wanted).select("query_id", "rank", "nth", "of")


def cosine_ranks_of(queries: DataFrame, rows: DataFrame, chosen: DataFrame, digits: int) -> DataFrame:
    """query_id, id, rank: the ranks that cosine_ranking gives to the few pairs chosen(query_id, id). Rows are counted where they are, none is ranked."""
    known, first = blocks.numbered(rows)
    ids = known.select("id", "number").distinct()
    found = blocks.ranks_of(queries, known, chosen.select("query_id", "id").distinct().join(ids, "id"), digits)
    return found.select("query_id", (F.col("number") + first).alias("id"), "rank") if first is not None else found.join(ids, "number").select("query_id", "id", "rank")


def cosine_rank_correlations(queries: DataFrame, rows: DataFrame, first: str, second: str, digits: int) -> DataFrame:
    """query_id, correlation of a query's two rankings by the vectors `first` and `second` of queries(query_id, ...) and rows(id, ...)."""
    known = blocks.numbered(rows)[0]
    side = lambda c: (queries.select("query_id", F.col(c).alias("query_vec")), known.select("id", "number", F.col(c).alias("vec")))
    return blocks.rank_correlations(*side(first), side(second), digits)


def telling_distances(queries: DataFrame, rows: DataFrame, k: int, digits: int, found: DataFrame) -> DataFrame:
    """query_id, id, distance of the k nearest rows of each query, its farthest one (the nearest to the opposite vector) and the pairs found(query_id, id):
    enough for relevance_of_distance(), which needs the smallest and largest distance, and for an ideal order of k."""
    near = cosine_top_k(queries, rows, k, digits).select("query_id", "id")
    turned = queries.select("query_id", F.transform("query_vec", lambda x: -x).alias("query_vec"))
    far = cosine_top_k(turned, rows, 1, digits).select("query_id", "id")
    pairs = near.unionByName(far).unionByName(found.select("query_id", "id")).distinct()
    r, q = rows.withColumn("rn__", vectors.norm("vec")), queries.withColumn("qn__", vectors.norm("query_vec"))
    d = 1 - vectors.dot("vec", "query_vec") / (F.col("rn__") * F.col("qn__") + vectors.COSINE_GUARD)
    return pairs.join(r, "id").join(q, "query_id").select("query_id", "id", F.round(d, digits).alias("distance"))


def reciprocal_rank_fusion(rankings: DataFrame, weights: DataFrame | None = None, k: float = RRF_K, carry: list[str] = [], first: str | None = None) -> DataFrame:  # noqa: B006
    """rankings(query_id, modality, id, rank) -> query_id, id, rrf_score, rank. weights(modality, weight): a zero weight drops
    the modality before the join, a missing one counts as one. `carry` names columns of the rankings that come along: those
    of modality `first` where it has the id, else of any other."""
    if weights is not None:
        rankings = rankings.join(F.broadcast(weights), "modality", "left").where("weight is null or weight <> 0")
        weight = F.coalesce("weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    along = [F.coalesce(F.max(F.when(F.col("modality") == first, F.col(c))), F.max(c)).alias(c) for c in carry]
    fused = rankings.groupBy("query_id", "id").agg(F.sum(weight / (k + F.col("rank"))).alias("rrf_score"), *along)
    return rank_by(fused, ["query_id"], [F.desc("rrf_score"), "id"])


def truths_of_groups(asked: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(those of pairs(query_id, id) that are truths; query_id and how many truths it has, one at least) where the truths of asked(query_id, group) are the
    other rows of its group in members(id, group), to which the query belongs. The truths of a query need not be listed for that."""
    sizes = members.groupBy("group").agg((F.count("*") - 1).alias("truths"))
    counts = asked.join(sizes, "group").where("truths > 0").select("query_id", "truths")
    own = asked.select("query_id", F.col("group").alias("group__"))
    listed = pairs.select("query_id", "id").distinct().join(members, "id").join(own, "query_id").where("group = group__ and id <> query_id")
    return listed.select("query_id", "id"), counts


def recall_at(ranking: DataFrame, truth: DataFrame, k: int, capped: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """hits over min(k, truths) (capped) or over truths, for each query of truth(query_id, id); with counts(query_id, truths), for each of those, and truth
    only needs to hold what the ranking has."""
    if counts is None:
        counts = truth.groupBy("query_id").agg(F.count("*").alias("truths"))
    first = ranking.where(F.col("rank") <= k).select("query_id", "id")
    hits = truth.join(first, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    both = counts.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "truths")
    return both.withColumn("recall", F.col("hits") / (F.least("truths", F.lit(k)) if capped else F.col("truths")))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the first k that two rankings have in common."""
    both = a.where(F.col("rank") <= k).select("query_id", "id").join(b.where(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"])
    return both.groupBy("query_id").agg((F.count("*") / k).alias("precision"))


def reciprocal_ranks(ranking: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Mean of 1/rank and mean rank over the truths found (not over the first only); without truth, the ranking holds nothing else."""
    found = ranking if truth is None else truth.join(ranking.select("query_id", "id", "rank"), ["query_id", "id"])
    return found.groupBy("query_id").agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"))


def ndcg(ranking: DataFrame, relevance: str, k: int, exponential: bool = False, relevances: DataFrame | None = None) -> DataFrame:
    """NDCG of the first k rows against the ideal order of all rows of the query.

    Of the ranking only the first k rows are looked at; `relevances`(query_id, id, relevance) has those of all rows, if the
    ranking has not. The ideal order is a top k of relevances, so nothing else is ranked."""
    every = ranking if relevances is None else relevances
    ideal = top_k(every.select("query_id", "id", F.col(relevance).alias("rel__")), ["query_id"], [F.desc("rel__"), "id"], k, "place__")
    found = ranking.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("place__"), *([F.col(relevance).alias("rel__")] if relevances is None else []))
    if relevances is not None:
        few = found.select("query_id", "id", "place__")
        found = every.select("query_id", "id", F.col(relevance).alias("rel__")).join(few, ["query_id", "id"])
    both = found.select("query_id", "rel__", "place__", F.lit(1).alias("found__")).unionByName(ideal.select("query_id", "rel__", "place__", F.lit(0).alias("found__")))
    gain = (F.pow(F.lit(2.0), F.col("rel__")) - 1) if exponential else F.col("rel__")
    share = lambda found: F.sum(F.when(F.col("found__") == found, gain / F.log2(F.col("place__") + 1.0)))
    return both.groupBy("query_id").agg(F.coalesce(share(1) / F.nullif(share(0), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def relevance_of_distance(rows: DataFrame, distance: str, variant: str = "scaled") -> DataFrame:
    """relevance in (0, 1]: 1/(1+d/max d), 1/(1+d), or 1 - min-max scaled d with floors."""
    d, top, low = F.col(distance), F.col("top__"), F.col("low__")
    if variant != "plain":
        rows = rows.join(rows.groupBy("query_id").agg(F.max(distance).alias("top__"), F.min(distance).alias("low__")), "query_id")
    value = {
        "scaled": 1 / (1 + d / F.when(top > 0, top).otherwise(F.lit(1.0))),
        "plain": 1 / (1 + d),
        "min_max": F.greatest(F.lit(1e-6), 1 - (d - low) / F.greatest(F.lit(1e-6), top - low)),
    }[variant]
    return rows.withColumn("relevance", value).drop("top__", "low__")


def relevance_of_truths(truth: DataFrame, found: DataFrame, distance: str, variant: str = "scaled") -> DataFrame:
    """truth(query_id, id) with the relevance of its distance in found; 0 where it was not found."""
    scored = relevance_of_distance(found, distance, variant).select("query_id", "id", "relevance")
    return truth.join(scored, ["query_id", "id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def relevance_of_groups(asked: DataFrame, members: DataFrame, found: DataFrame, distance: str, variant: str = "scaled") -> DataFrame:
    """relevance_of_truths() of the truths that truths_of_groups() has. A query's few found rows go with it to the members of its group, which are dealt to
    as many parts as tasks, so the listed pairs are not shuffled."""
    scored = relevance_of_distance(found, distance, variant).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))
    known = scored.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "relevance"))).alias("known__"))
    parts = max(asked.sparkSession.sparkContext.defaultParallelism, 2)
    q = asked.join(known, "query_id", "left").withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = members.withColumn("part__", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(parts)).cast("int"))
    both = q.join(r, ["group", "part__"]).where("id <> query_id")
    return both.select("query_id", "id", F.coalesce(F.try_element_at("known__", F.col("id")), F.lit(0.0)).alias("relevance"))


def coverage(reference: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """How deep the ranking must be read to hold the reference's first k: coverage_point, expansion, and rank shifts."""
    both = reference.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("ref__")).join(ranking.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    shift = F.abs(F.col("rank") - F.col("ref__"))
    return both.groupBy("query_id").agg(
        F.max("rank").alias("coverage_point"), (F.max("rank") / k).alias("expansion"), (F.sum((F.col("rank") <= k).cast("long")) / k).alias("recall"),
        F.avg(shift).alias("mean_shift"), F.expr(f"percentile(abs(rank - ref__), 0.5)").alias("median_shift"),
    )


def truth_coverage(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    found = truth.join(ranking.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return found.groupBy("query_id").agg(
        F.max("rank").alias("coverage_point"), (F.max("rank") / F.count("*")).alias("expansion"), F.avg("rank").alias("mean_rank"),
        F.expr("percentile(rank, 0.5)").alias("median_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
    )


def coverage_of_ranks(ranks: DataFrame) -> DataFrame:
    """truth_coverage() of the rows that cosine_ranks() gives; their median rank is that of the middle one or two of them."""
    middle = (F.col("nth") == F.floor((F.col("of") + 1) / 2)) | (F.col("nth") == F.floor(F.col("of") / 2) + 1)
    return ranks.groupBy("query_id").agg(
        F.max("rank").alias("coverage_point"), (F.max("rank") / F.count("*")).alias("expansion"), F.avg("rank").alias("mean_rank"),
        F.avg(F.when(middle, F.col("rank"))).alias("median_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
    )


def prefix_for_common(reference: DataFrame, ranking: DataFrame, k: int = 50) -> DataFrame:
    """Smallest prefix of the ranking that holds every id of the reference's first k that it ranks at all."""
    both = reference.where(F.col("rank") <= k).select("query_id", "id").join(ranking.select("query_id", "id", "rank"), ["query_id", "id"])
    return both.groupBy("query_id").agg(F.max("rank").alias("prefix"))


def composite(row_columns: dict[str, float]) -> Column:
    """Weighted sum of metric columns."""
    return sum((F.col(c) * w for c, w in list(row_columns.items())[1:]), F.col(next(iter(row_columns))) * next(iter(row_columns.values())))


def hash_sample(rows: DataFrame, key: str, seed: str | int, n: int) -> DataFrame:
    """n rows in the order of md5(key and seed): repeatable on any system that has MD5."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def stable_unique(rows: DataFrame, value: str, order: str) -> DataFrame:
    """value, first (the smallest order at which it stands), place (from 1, in the order of first appearance), one row a distinct value."""
    firsts = rows.groupBy(value).agg(F.min(order).alias("first"))  # distinct values, not rows, are put in order
    return series.running_total(firsts, [], ["first", value], F.lit(1).cast("long"), "place")


#: Pair subsets of a distance table.
SUBSETS = ("all", "minimum", "maximum", "smallest", "largest", "nearest", "farthest")


def pair_subset(scored: DataFrame, subset: str = "nearest", limit: float | int | None = None) -> DataFrame:
    """scored(query_id, id, distance) cut to a subset: distances of at least ('minimum') or at most ('maximum') limit, the
    limit smallest or largest of each query, or its nearest or farthest row; ties to the smaller id."""
    if subset not in SUBSETS:
        raise ValueError(subset)
    if subset == "all":
        return scored
    if subset in ("minimum", "maximum"):
        return scored.where(F.col("distance") >= limit if subset == "minimum" else F.col("distance") <= limit)
    order = F.col("distance").asc() if subset in ("smallest", "nearest") else F.col("distance").desc()
    return top_k(scored, ["query_id"], [order, "id"], int(limit) if subset in ("smallest", "largest") else 1).drop("rank")
