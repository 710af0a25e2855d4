"""Connected components of a link table by alternating large-star and small-star rounds of DataFrame joins.

Every round is written to the shared folder in place of the one before, so neither the plan nor the cost of a lost
executor grows with the rounds.
Stars are found by a partial aggregation (smallest neighbour of each node); a hub of any degree is therefore never
gathered in one place, and the join back to its links is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) of non-null comparable ids, either way round -> (node, root): root is the smallest id reachable.
    Nodes without links do not appear. An empty table gives an empty result."""
    state_path: list[str] = []
    edges = common.written(_canonical(links), "links", state_path)
    seen = None
    for _ in range(max_rounds):
        edges = common.written(_canonical(_small_star(_large_star(edges))), "links", state_path)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _canonical(links: DataFrame) -> DataFrame:
    """Each link once, smaller id first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node u with smallest closed neighbour m: link every larger neighbour of u to m."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, edges.a == low.u).select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node u with smallest smaller neighbour m: link u and its smaller neighbours to m."""
    edges = _canonical(edges)
    low = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    pulled = edges.join(low, edges.b == low.u).select(F.col("m").alias("a"), edges.a.alias("b"))
    return pulled.union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
