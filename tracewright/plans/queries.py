"""Registered queries: every operator applied to the test tables, with its DuckDB SQL where SQL can say it.

Events stand for one-dimensional series and for three-dimensional trajectories (value, hour of day, id mod 100), with the
even event ids as nominal and the odd ones as measured points, users as trajectories and event types as segments;
embeddings are searched as they are and in two halves; orders and customers carry features and prediction targets.
Stated query sets are the rows whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quaternions as q
from ..functions import stats, vectors
from ..operators import alignment, blocks, calibration, dealt, joins, kinematics, prediction, proximity, ranking, sequence_blocks, series, summary
from ..operators.vector_index import CosineIndex
from ..sources import tables
from ..sources.scratch import scratch_path, settled
from . import accuracy, recurrences, search
from .store import EmbeddingStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader) under its own name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


def micros(c: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def hour(c: str = "ts"):
    return F.pmod(F.floor(micros(c) / 1_000_000), F.lit(86400)) / 3600.0


def _events(t):
    return t("events").withColumn("at", micros())


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _halves(t):
    v = _vectors(t)
    return v.select("id", "label", F.slice("vec", 1, 32).alias("head"), F.slice("vec", 33, 32).alias("tail"))


def _asked(rows, *columns):
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), *columns)


def _points(t, rest: int | None = None):
    e = t("events")
    e = e if rest is None else e.where(F.col("event_id") % 2 == rest)
    e = e.withColumn("hour", hour()).withColumn("z", (F.col("event_id") % 100).cast("double"))
    return tables.points(e, "user_id", "event_type", ["ts", "event_id"], ["value", "hour", "z"])


def _of_c(name: str, c):
    """A function of the C library: Java's sine and cosine differ from it in the last bit of one value in a hundred, which would decide
    whether a step of exactly the limit of orientations without jumps is a jump."""
    f = getattr(math, name)

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(f)

    return apply(c)


def _orientations(t, rest: int):
    e = t("events").where(F.col("event_id") % 2 == rest)
    # smooth turns about a slowly tilting axis, so that angles are well defined
    a = F.radians(F.col("value") % 100)
    e = e.withColumn("w", _of_c("cos", a / 2)).withColumn("s", _of_c("sin", a / 2)).select("*", (F.col("s") * 0.6).alias("x"), (F.col("s") * 0.8).alias("y"), F.lit(0.0).alias("zq"))
    return tables.points(e, "user_id", "event_type", ["ts", "event_id"], ["w", "x", "y", "zq"])


HOUR_SQL = "(floor(epoch_us(ts) / 1000000)::BIGINT % 86400) / 3600.0"
VEC_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
COS = "round(1 - list_dot_product(b.{c}, a.{c}) / (sqrt(list_dot_product(b.{c}, b.{c})) * sqrt(list_dot_product(a.{c}, a.{c})) + 1e-10), 9)"


def _topk_sql(c: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
      SELECT a.id AS query_id, b.id, {COS.format(c=c)} AS distance FROM h a, h b WHERE a.id % 50 = 0 AND a.id <> b.id)) WHERE rank <= {k})"""


HALVES_SQL = f"{VEC_SQL}, h AS (SELECT id, label, vec, vec[1:32] AS head, vec[33:64] AS tail FROM v)"
FUSED_SQL = f"""{HALVES_SQL}, {_topk_sql('head', 20, 'ra')}, {_topk_sql('tail', 20, 'rb')},
  u AS (SELECT query_id, id, 'head' AS modality, rank FROM ra UNION ALL SELECT query_id, id, 'tail', rank FROM rb),
  f AS (SELECT query_id, id, round(sum(1.0 / (60.0 + rank)), 12) AS rrf_score FROM u GROUP BY ALL),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM f)"""


def _rankings(t):
    h = _halves(t)
    return search.first_stage(_asked(h, "head", "tail"), h, ["head", "tail"], 20, digits=9)[0]


def _fused(t):
    rows = _rankings(t).groupBy("query_id", "id").agg(r(F.sum(1.0 / (60.0 + F.col("rank"))), 12).alias("rrf_score"))
    return ranking.rank_by(rows, ["query_id"], [F.desc("rrf_score"), "id"])


def _truth(t):
    v = _vectors(t)
    return joins.same_group(v.where("id % 50 = 0"), v, "id", "label").select(F.col("query").alias("query_id"), F.col("match").alias("id"))


TRUTH_SQL = "truth AS (SELECT a.id AS query_id, b.id FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 50 = 0)"
FULL_SQL = f"{HALVES_SQL}, {_topk_sql('vec', 1000000000, 'full_rank')}"


def _ranked(asked, rows, k):
    """The first k rows of every query, or all of them."""
    return ranking.cosine_top_k(asked, rows, k, 9) if k else ranking.cosine_ranking(asked, rows, 9)


def _full(t, k=None):
    v = _vectors(t)
    return _ranked(_asked(v, F.col("vec").alias("query_vec")), v.select("id", "vec"), k)


def _labels(t):
    """(asked(query_id, group), members(id, group)): rows of one label are each other's truths."""
    v = _vectors(t).select("id", F.col("label").alias("group"))
    return _asked(v, "group"), v


def _truth_ranks(t):
    """The ranks of every query's truths, the other rows of its label."""
    v = _vectors(t)
    return ranking.cosine_ranks(_asked(v, F.col("vec").alias("query_vec"), F.col("label").alias("query_label")), v, 9, ("label", "query_label"))


# --- search and fusion ---------------------------------------------------------------------------------------------


@query(f"WITH {HALVES_SQL}, {_topk_sql('vec', 10, 'top')} SELECT query_id, id, distance, rank FROM top")
def cosine_topk(t):
    return _full(t, 10)


@query(f"WITH {HALVES_SQL}, {_topk_sql('vec', 10, 'top')} SELECT query_id, id, distance, rank FROM top")
def cosine_index_topk(t):
    """The ten nearest out of a stored index to which a tenth of the rows was appended; every cell may be visited, so nothing is lost."""
    v = _vectors(t).select("id", "vec")
    index = CosineIndex.build(v.where("id % 10 <> 9"), scratch_path(v.sparkSession, "cosine-index"))
    index.append(v.where("id % 10 = 9"))
    return index.search(_asked(v, F.col("vec").alias("query_vec")), 10, digits=9).select("query_id", "id", "distance", "rank")


@query(f"WITH {FUSED_SQL} SELECT query_id, id, rrf_score, rank FROM fused")
def rrf_fusion(t):
    return _fused(t)


@query(f"""WITH {HALVES_SQL}, {_topk_sql('head', 20, 'ra')}, {_topk_sql('tail', 20, 'rb')}
  SELECT query_id, id, round(sum(w / (60.0 + rank)), 9) AS rrf_score FROM (SELECT query_id, id, rank, 0.7 AS w FROM ra UNION ALL SELECT query_id, id, rank, 1.0 FROM rb) GROUP BY ALL""")
def rrf_fusion_weighted(t):
    h = _halves(t)
    weights = h.sparkSession.createDataFrame([("head", 0.7), ("other", 0.0)], "modality string, weight double")  # tail counts as one
    fused = search.first_stage(_asked(h, "head", "tail"), h, ["head", "tail"], 20, weights, 9)[1]
    return fused.select("query_id", "id", r("rrf_score", 9).alias("rrf_score"))


@query(f"""WITH {FUSED_SQL}, k AS (SELECT f.*, v.label::DOUBLE AS t, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fused f JOIN v USING (id))
  SELECT query_id, round(avg(t), 6) AS mean, round(sum(t * rrf_score) / sum(rrf_score), 6) AS weighted, count(*) AS n FROM k WHERE n <= 5 GROUP BY query_id""")
def prognosis_weighted(t):
    targets = _vectors(t).select("id", F.col("label").cast("double").alias("label"))
    return prediction.from_neighbours(_fused(t), targets, "label", 5).select("query_id", r("mean").alias("mean"), r("weighted").alias("weighted"), "n")


@query(f"""WITH {HALVES_SQL}, {_topk_sql('vec', 10, 'top')} SELECT query_id, round(avg(label), 6) AS mean, round(sum(label / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS weighted, count(*) AS n
  FROM top JOIN v USING (id) GROUP BY query_id""")
def prognosis_inverse_distance(t):
    targets = _vectors(t).select("id", F.col("label").cast("double").alias("label"))
    return prediction.from_neighbours(_full(t, 10), targets, "label", 10, "distance").select("query_id", r("mean").alias("mean"), r("weighted").alias("weighted"), "n")


@query(f"""WITH {HALVES_SQL}, {_topk_sql('vec', 10, 'top')}, p AS (SELECT query_id, sum(label / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS w FROM top JOIN v USING (id) GROUP BY query_id)
  SELECT label AS query_id, round(sum((query_id + 1) * w) / sum(query_id + 1), 6) AS prediction FROM p JOIN v ON v.id = p.query_id GROUP BY label""")
def decomposed_prediction(t):
    v = _vectors(t)
    each = prediction.from_neighbours(_full(t, 10), v.select("id", F.col("label").cast("double").alias("label")), "label", 10, "distance")
    segments = v.where("id % 50 = 0").select(F.col("id").alias("segment_id"), F.col("label").alias("query_id"), (F.col("id") + 1).alias("length"))
    return prediction.decomposed(each, segments).select("query_id", r("prediction").alias("prediction"))


@query(f"""WITH {FULL_SQL}, m AS (SELECT truth.query_id, f.rank FROM truth LEFT JOIN full_rank f ON f.query_id = truth.query_id AND f.id = truth.id AND f.rank <= 50),
  {TRUTH_SQL} SELECT query_id, count(rank) AS hits, count(*) AS truths, round(count(rank)::DOUBLE / least(count(*), 50), 6) AS recall FROM m GROUP BY query_id""".replace(", m AS", f", {TRUTH_SQL}, m AS").replace(f",\n  {TRUTH_SQL} SELECT", " SELECT"))
def recall_at_k(t):
    near = settled(_full(t, 50))
    truth, counts = ranking.truths_of_groups(*_labels(t), near)
    return ranking.recall_at(near, truth, 50, counts=counts).select("query_id", "hits", "truths", r("recall").alias("recall"))


@query(f"WITH {FULL_SQL}, {TRUTH_SQL} SELECT query_id, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank FROM truth JOIN full_rank USING (query_id, id) GROUP BY query_id")
def mrr_mean_rank(t):
    return ranking.reciprocal_ranks(_truth_ranks(t)).select("query_id", r("mrr").alias("mrr"), r("mean_rank").alias("mean_rank"))


@query(f"""WITH {FULL_SQL}, {TRUTH_SQL}, j AS (SELECT query_id, id, rank FROM truth JOIN full_rank USING (query_id, id))
  SELECT query_id, max(rank) AS coverage_point, round(max(rank)::DOUBLE / count(*), 6) AS expansion, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, min(rank) AS min_rank, max(rank) AS max_rank FROM j GROUP BY query_id""")
def truth_coverage(t):
    return ranking.coverage_of_ranks(_truth_ranks(t)).select("query_id", "coverage_point", r("expansion").alias("expansion"), r("mean_rank").alias("mean_rank"), r("median_rank").alias("median_rank"), "min_rank", "max_rank")


HEAD_RANK_SQL = f"{FULL_SQL}, {_topk_sql('head', 1000000000, 'head_rank')}"


def _head(t, k=None):
    h = _halves(t)
    return _ranked(_asked(h, F.col("head").alias("query_vec")), h.select("id", F.col("head").alias("vec")), k)


def _head_ranks(t, chosen):
    h = _halves(t)
    return ranking.cosine_ranks_of(_asked(h, F.col("head").alias("query_vec")), h.select("id", F.col("head").alias("vec")), chosen, 9)


@query(f"""WITH {HEAD_RANK_SQL}, j AS (SELECT a.query_id, a.rank AS ra, b.rank AS rb FROM full_rank a JOIN head_rank b USING (query_id, id) WHERE a.rank <= 10)
  SELECT query_id, max(rb) AS coverage_point, round(max(rb) / 10.0, 6) AS expansion, round(count(*) FILTER (rb <= 10) / 10.0, 6) AS recall, round(avg(abs(rb - ra)), 6) AS mean_shift, round(median(abs(rb - ra)), 6) AS median_shift FROM j GROUP BY query_id""")
def coverage_points(t):
    near = settled(_full(t, 10))
    c = ranking.coverage(near, _head_ranks(t, near), 10)
    return c.select("query_id", "coverage_point", *[r(x).alias(x) for x in ("expansion", "recall", "mean_shift", "median_shift")])


@query(f"WITH {HEAD_RANK_SQL} SELECT query_id, round(count(*) / 10.0, 6) AS precision FROM (SELECT * FROM full_rank WHERE rank <= 10) a JOIN (SELECT * FROM head_rank WHERE rank <= 10) b USING (query_id, id) GROUP BY query_id")
def precision_at_k(t):
    return ranking.overlap_at(_full(t, 10), _head(t, 10), 10).select("query_id", r("precision").alias("precision"))


@query(f"WITH {HEAD_RANK_SQL} SELECT query_id, max(b.rank) AS prefix FROM (SELECT * FROM full_rank WHERE rank <= 50) a JOIN head_rank b USING (query_id, id) GROUP BY query_id")
def prefix_for_common_top50(t):
    near = settled(_full(t, 50))
    return ranking.prefix_for_common(near, _head_ranks(t, near), 50)


def _ndcg_sql(gain: str, relevance: str) -> str:
    return f"""WITH {HEAD_RANK_SQL}, j AS (SELECT query_id, h.id, h.rank, {relevance} AS rel FROM head_rank h JOIN full_rank f USING (query_id, id)),
  o AS (SELECT *, {gain} AS g, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS ideal FROM j)
  SELECT query_id, round(sum(g / log2(rank + 1.0)) FILTER (rank <= 10) / sum(g / log2(ideal + 1.0)) FILTER (ideal <= 10), 6) AS ndcg FROM o GROUP BY query_id"""


def _ndcg(t, variant, exponential):
    v, head = _vectors(t), settled(_head(t, 10))
    distances = ranking.telling_distances(_asked(v, F.col("vec").alias("query_vec")), v.select("id", "vec"), 10, 9, head)
    rel = ranking.relevance_of_distance(distances, "distance", variant).select("query_id", "id", r("relevance", 9).alias("relevance"))
    return ranking.ndcg(head, "relevance", 10, exponential, rel).select("query_id", r("ndcg").alias("ndcg"))


@query(_ndcg_sql("rel", "round(1 / (1 + f.distance / max(f.distance) OVER (PARTITION BY query_id)), 9)"))
def ndcg_linear(t):
    return _ndcg(t, "scaled", False)


@query(_ndcg_sql("pow(2, rel) - 1", "round(greatest(1e-6, 1 - (f.distance - min(f.distance) OVER (PARTITION BY query_id)) / greatest(1e-6, max(f.distance) OVER (PARTITION BY query_id) - min(f.distance) OVER (PARTITION BY query_id))), 9)"))
def ndcg_exponential(t):
    return _ndcg(t, "min_max", True)


@query(f"""WITH {HEAD_RANK_SQL}, a AS (SELECT query_id, f.rank AS x, h.rank AS y FROM full_rank f JOIN head_rank h USING (query_id, id))
  SELECT query_id, round(corr(x, y), 6) AS spearman FROM a GROUP BY query_id""")
def spearman_of_rankings(t):
    # ids break ties, so both ranks are places already, and their correlation is Spearman's
    h = _vectors(t).withColumn("head", F.slice("vec", 1, 32))
    both = ranking.cosine_rank_correlations(_asked(h, "vec", "head"), h, "vec", "head", 9)
    return both.select("query_id", r("correlation").alias("spearman"))


@query("""WITH x AS (SELECT o_orderpriority AS p, round(o_totalprice / 1000) AS a, o_custkey % 37 AS b FROM orders),
  k AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY a) + (count(*) OVER (PARTITION BY p, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY p ORDER BY b) + (count(*) OVER (PARTITION BY p, b) - 1) / 2.0 AS rb FROM x)
  SELECT p AS priority, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY p""")
def spearman(t):
    rows = t("orders").select(F.col("o_orderpriority").alias("priority"), F.round(F.col("o_totalprice") / 1000).alias("a"), (F.col("o_custkey") % 37).alias("b"))
    return summary.spearman(rows, ["priority"], "a", "b").select("priority", r("spearman").alias("spearman"))


@query(f"""WITH {FUSED_SQL}, {TRUTH_SQL}, w(mode, modality, weight) AS (VALUES ('both', 'head', 0.5), ('both', 'tail', 0.5), ('head', 'head', 1.0)),
  g AS (SELECT query_id, mode, id, round(sum(weight / (60.0 + rank)), 12) AS s FROM u JOIN w USING (modality) GROUP BY ALL),
  e AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY s DESC, id) AS rank FROM g),
  ks(k) AS (VALUES (5), (10)), {_topk_sql('vec', 20, 'refr')},
  m AS (SELECT e.query_id, mode, k, e.rank, tr.id IS NOT NULL AS is_truth, rf.rank AS ref FROM e CROSS JOIN ks LEFT JOIN truth tr ON tr.query_id = e.query_id AND tr.id = e.id LEFT JOIN refr rf ON rf.query_id = e.query_id AND rf.id = e.id),
  n AS (SELECT query_id, count(*) AS truths FROM truth GROUP BY query_id)
  SELECT query_id, mode, k, round(count(*) FILTER (rank <= k AND is_truth)::DOUBLE / least(max(truths), k), 6) AS recall, round(count(*) FILTER (rank <= k AND ref <= k)::DOUBLE / k, 6) AS precision,
   round(avg(1.0 / rank) FILTER (is_truth), 6) AS mrr FROM m JOIN n USING (query_id) GROUP BY query_id, mode, k""")
def validation_sweep(t):
    modes = t("nation").sparkSession.createDataFrame([("both", "head", 0.5), ("both", "tail", 0.5), ("head", "head", 1.0), ("head", "tail", 0.0)], "mode string, modality string, weight double")
    rankings = settled(_rankings(t))
    truth, counts = ranking.truths_of_groups(*_labels(t), rankings)
    rows = search.validation(rankings, modes, _full(t, 20), truth, [5, 10], counts)
    return rows.select("query_id", "mode", "k", *[r(c).alias(c) for c in ("recall", "precision", "mrr")])


@query(f"""WITH {VEC_SQL} SELECT a.id AS query, b.id AS match FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 50 = 0""")
def same_group_gt(t):
    v = _vectors(t)
    return joins.same_group(v.where("id % 50 = 0"), v, "id", "label")


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey::VARCHAR, '42')), o_orderkey LIMIT 50")
def hash_sample_md5(t):
    return ranking.hash_sample(t("orders"), "o_orderkey", 42, 50).select("o_orderkey")


@query("""WITH m AS (SELECT o_orderpriority AS mode, o_orderstatus AS label, 0.6 * avg(o_totalprice) + 0.4 * max(o_totalprice) AS score FROM orders GROUP BY ALL)
  SELECT mode, arg_max(label, score) AS label, round(max(score), 4) AS score FROM m GROUP BY mode""")
def composite_score(t):
    means = t("orders").groupBy(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("label")).agg(F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("m"))
    best = summary.best_by(means, ["mode"], ranking.composite({"a": 0.6, "m": 0.4}), "label")
    return best.select("mode", "label", r("score", 4).alias("score"))


# --- joins, filters, sources, sinks --------------------------------------------------------------------------------


@query("""SELECT l.event_id, l.user_id, r.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(t):
    e = t("events")
    signups = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup_id"))
    return joins.asof(e.where("event_type = 'purchase'"), signups, "ts", "ts", ["user_id"]).select("event_id", "user_id", "signup_id")


@query("""SELECT l.event_id, coalesce(r.event_id, l.event_id) AS calibration_id FROM (SELECT *, ts::DATE AS day FROM events WHERE event_type = 'purchase') l
  ASOF LEFT JOIN (SELECT user_id, ts::DATE AS day, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY ALL) r ON l.user_id = r.user_id AND l.day = r.day AND l.ts > r.ts""")
def asof_same_day_strict(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    others = e.where("event_type <> 'purchase'").groupBy("user_id", "day", "ts").agg(F.max("event_id").alias("other_id"))
    rows = joins.asof_or_self(e.where("event_type = 'purchase'"), others, "ts", "ts", ["user_id", "day"], "event_id", "other_id", "calibration_id")
    return rows.select("event_id", "calibration_id")


NEAREST_SQL = """WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, epoch_us(ts) AS at, max(event_id) AS near_id FROM events WHERE event_type = 'click' GROUP BY ALL),
  p AS (SELECT l.event_id, r.near_id, abs(l.at - r.at) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.at - r.at), r.at) AS k FROM l LEFT JOIN r USING (user_id))"""


def _nearest(t, within=None):
    e = _events(t)
    clicks = e.where("event_type = 'click'").groupBy("user_id", "at").agg(F.max("event_id").alias("near_id"))
    return joins.nearest(e.where("event_type = 'purchase'"), clicks, "at", "at", ["user_id"], within=within).select("event_id", "near_id")


@query(NEAREST_SQL + " SELECT event_id, near_id FROM p WHERE k = 1")
def nearest_join(t):
    return _nearest(t)


@query(NEAREST_SQL + " SELECT event_id, CASE WHEN gap <= 43200000000 THEN near_id END AS near_id FROM p WHERE k = 1")
def window_pairing(t):
    return _nearest(t, F.col("gap__") <= 43_200_000_000)


@query("""WITH l AS (SELECT event_id, epoch_us(ts) AS m FROM events WHERE event_type = 'purchase'), r AS (SELECT epoch_us(ts) AS m, max(event_id) AS near_id FROM events WHERE event_type = 'click' GROUP BY ALL),
  b AS (SELECT l.event_id, l.m, r.near_id AS p, r.m AS pm FROM l ASOF LEFT JOIN r ON l.m >= r.m), f AS (SELECT l.event_id, r.near_id AS n, r.m AS nm FROM l ASOF LEFT JOIN r ON l.m <= r.m)
  SELECT event_id, CASE WHEN n IS NULL OR m - pm <= nm - m THEN p ELSE n END AS near_id FROM b JOIN f USING (event_id)""")
def nearest_without_keys(t):
    """The click of any user nearest to each purchase."""
    e = _events(t)
    clicks = e.where("event_type = 'click'").groupBy("at").agg(F.max("event_id").alias("near_id"))
    return joins.nearest(e.where("event_type = 'purchase'"), clicks, "at", "at").select("event_id", "near_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def anti_join_pending(t):
    done = t("orders").select(F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("c_custkey"))  # null where nothing is done
    return joins.pending(t("customer").select("c_custkey"), done, "c_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -950)")
def exclude_whole_groups(t):
    c = t("customer")
    return joins.exclude_groups(c.select("c_custkey", "c_nationkey"), c.where("c_acctbal < -950"), "c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(t):
    ids = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi(t("orders"), ids, "o_custkey").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
  UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def replace_by_key(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    fresh = joins.semi(o, t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").withColumn("o_orderstatus", F.lit("X"))
    return joins.replace_by_key(o, fresh, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0)
  SELECT o_orderkey FROM s UNION ALL SELECT o_orderkey FROM f WHERE o_orderdate NOT IN (SELECT o_orderdate FROM s)""")
def append_only_new(t):
    o = t("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return joins.append_new(o.where("o_orderstatus = 'O'"), o.where("o_orderkey % 3 = 0"), "o_orderdate").select("o_orderkey")


@query("""WITH x AS (SELECT o_orderkey, (1700000000 + o_custkey * 700000)::BIGINT::VARCHAR AS id, (1700000000 + o_custkey * 700000)::BIGINT::VARCHAR || '_' || (o_orderkey % 9)::VARCHAR AS seg, strftime(o_orderdate, '%d.%m.%Y') AS d, 'record_' || strftime(o_orderdate, '%Y%m%d') || '_a.mat' AS f FROM orders)
  SELECT o_orderkey, regexp_matches(id, '^[1-9][0-9]{9}$') AS valid, regexp_extract(seg, '_(\\d+)$', 1)::INTEGER AS number, regexp_replace(seg, '_(\\d+)$', '') AS parent, strftime(strptime(d, '%d.%m.%Y'), '%Y%m%d') AS compact, regexp_extract(f, 'record_([^_]*)_', 1) = '19950301' AS on_date FROM x""")
def identifiers_and_dates(t):
    o = t("orders")
    key = (F.lit(1700000000) + F.col("o_custkey") * 700000).cast("long").cast("string")
    x = o.select("o_orderkey", key.alias("id"), F.concat(key, F.lit("_"), (F.col("o_orderkey") % 9).cast("string")).alias("seg"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("d"), F.concat(F.lit("record_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_a.mat")).alias("f"))
    return x.select("o_orderkey", tables.is_trajectory_id("id").alias("valid"), tables.segment_number("seg").alias("number"), tables.parent_of("seg").alias("parent"), tables.compact_date("d").alias("compact"), tables.recorded_on("f", "19950301").alias("on_date"))


@query("SELECT user_id AS traj_id, count(*) AS n, round(sum(value), 4) AS total, round(arg_min(value, ts), 6) AS first_value FROM events GROUP BY user_id")
def sequences_by_trajectory(t):
    s = tables.sequences(_points(t), ["traj_id"])
    return s.select("traj_id", "n", r(F.aggregate("seq", F.lit(0.0), lambda a, p: a + p[0]), 4).alias("total"), r(F.col("seq")[0][0]).alias("first_value"))


@query("""WITH ids AS (SELECT DISTINCT user_id::VARCHAR AS id FROM events UNION SELECT DISTINCT event_type FROM events UNION SELECT 'none')
  SELECT id, (SELECT count(*) FROM events WHERE user_id::VARCHAR = ids.id OR event_type = ids.id) AS n FROM ids""")
def sequences_by_mixed_ids(t):
    e = t("events")
    ids = e.select(F.col("user_id").cast("string").alias("id")).union(e.select("event_type")).distinct()
    ids = ids.unionByName(e.sparkSession.createDataFrame([("none",)], "id string"))
    return tables.counts_of(ids, _points(t)).select("id", "n")


@query("""WITH p AS (SELECT user_id::VARCHAR AS traj, user_id || '_' || event_type AS seg, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events), ids AS (SELECT DISTINCT traj AS id FROM p UNION SELECT DISTINCT seg FROM p UNION SELECT 'none_x'),
  b AS (SELECT traj AS id, value, ord FROM p UNION ALL SELECT seg, value, ord FROM p) SELECT id, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(arg_max(value, ord), 6) AS last FROM ids LEFT JOIN b USING (id) GROUP BY id""")
def sequences_of_trajectories_and_segments(t):
    """The sequence of every trajectory and of every segment, whose id holds its trajectory's: length, total and last value."""
    p = _points(t).withColumn("seg_id", F.concat_ws("_", F.col("traj_id").cast("string"), "seg_id"))
    ids = p.select(F.col("traj_id").cast("string").alias("id")).union(p.select("seg_id")).distinct()
    ids = ids.unionByName(ids.sparkSession.createDataFrame([("none_x",)], "id string"))
    total = F.aggregate("seq", F.lit(0.0), lambda a, v: a + v[0])
    return tables.sequences_of(ids, p).select("id", "n", r(total, 4).alias("total"), r(F.try_element_at("seq", F.lit(-1))[0]).alias("last"))


@query("SELECT event_type, min(event_id) AS first, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY 1")
def stable_unique(t):
    return ranking.stable_unique(t("events"), "event_type", "event_id").select("event_type", "first", "place")


@query("SELECT user_id AS traj_id, count(DISTINCT event_type) AS segments FROM events GROUP BY user_id")
def segment_counts(t):
    return tables.segment_counts(_points(t))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def parse_vector_text(t):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","), F.lit("]"))
    return t("embeddings").select("vec_id", r(F.aggregate(vectors.parse_vector(text), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# --- aggregations --------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS traj_id, CASE WHEN grouping(event_type) = 1 THEN user_id::VARCHAR ELSE event_type END AS seg_id, min(value) AS min_distance, max(value) AS max_distance, round(avg(value), 10) AS average_distance,
  round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS standard_deviation FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def segment_summary_grouping_sets(t):
    e = t("events").select(F.col("user_id").alias("traj_id"), F.col("event_type").alias("seg_id"), "value")
    i = summary.info(e, "value")
    return i.select("traj_id", "seg_id", "min_distance", "max_distance", r("average_distance", 10).alias("average_distance"), r("standard_deviation").alias("standard_deviation"))


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def overview_statistics(t):
    o = summary.overview(t("orders").withColumnRenamed("o_orderpriority", "priority"), "o_totalprice", ["priority"])
    return o.select("priority", "n", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r("std", 4).alias("std"), "min", "max")


def _hazen_sql(p: float, name: str) -> str:
    at = f"greatest(1.0, least(n::DOUBLE, {p} / 100.0 * n + 0.5))"
    lo = f"s[floor({at})::BIGINT]"
    return f"round({lo} + (s[least(floor({at}) + 1, n)::BIGINT] - {lo}) * ({at} - floor({at})), 6) AS {name}"


@query(f"WITH g AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, {_hazen_sql(25, 'p25')}, {_hazen_sql(50, 'p50')}, {_hazen_sql(90, 'p90')}, {_hazen_sql(95, 'p95')} FROM g")
def percentile_hazen(t):
    rows = series.midpoint_percentiles(t("events"), ["event_type"], "value", [25, 50, 90, 95])
    return rows.select("event_type", *[r(c).alias(c) for c in ("p25", "p50", "p90", "p95")])


PREVIOUS_SQL = "WITH p AS (SELECT user_id, event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"


def _previous(t):
    w = series.along(["user_id"], ["ts", "event_id"])
    return t("events").withColumn("prev", F.lag("value").over(w))


@query(PREVIOUS_SQL + " SELECT event_type, count(*) AS n, round(avg(abs(value - prev)), 6) AS mae, round(sqrt(avg((value - prev) * (value - prev))), 6) AS rmse, round(max(value - prev), 6) AS max_signed FROM p WHERE prev IS NOT NULL GROUP BY 1".replace("round(max(value - prev), 6) AS max_signed", "round(max(abs(value - prev)), 6) AS max_error"))
def mae_rmse(t):
    rows = summary.prediction_errors(_previous(t), "value", "prev", ["event_type"])
    return rows.select("event_type", "n", *[r(c).alias(c) for c in ("mae", "rmse", "max_error")])


@query(PREVIOUS_SQL + " SELECT event_type, round(corr(value, prev), 6) AS pearson FROM p WHERE prev IS NOT NULL GROUP BY 1")
def pearson(t):
    return _previous(t).where("prev is not null").groupBy("event_type").agg(r(F.corr("value", "prev")).alias("pearson"))


@query("""WITH v AS (SELECT avg(o_totalprice) AS mean, median(o_totalprice) AS median FROM orders), p AS (SELECT 'mean' AS predictor, mean AS value FROM v UNION ALL SELECT 'median', median FROM v)
  SELECT predictor, round(value, 4) AS value, count(*) AS n, round(avg(abs(o_totalprice - value)), 4) AS mae, round(sqrt(avg((o_totalprice - value) * (o_totalprice - value))), 4) AS rmse, round(max(abs(o_totalprice - value)), 4) AS max_error FROM orders, p GROUP BY predictor, value""")
def naive_baseline(t):
    rows = prediction.constant_predictors(t("orders"), "o_totalprice")
    return rows.select("predictor", r("value", 4).alias("value"), "n", *[r(c, 4).alias(c) for c in ("mae", "rmse", "max_error")])


@query("SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def length_weighted_roll_up(t):
    rows = summary.roll_up(t("events").withColumn("w", F.col("event_id") % 7 + 1), ["event_type"], "value", "w")
    return rows.select("event_type", r("value").alias("value"))


@query("WITH b AS (SELECT event_type, floor(value / 5.0) * 5.0 AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, arg_max(bin, (n, -bin)) AS bin, max(n) AS n FROM b GROUP BY 1")
def modal_bin(t):
    return series.modal_bin(t("events"), ["event_type"], "value", 5.0)


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c) WHERE k = 1")
def most_frequent(t):
    return series.most_frequent(t("customer"), ["c_nationkey"], ["c_mktsegment"])


@query("SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS \"end\", round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0), 6) AS frequency FROM events GROUP BY 1")
def series_header(t):
    h = summary.series_header(_events(t), "user_id", "at")
    return h.select("user_id", "n", "start", "end", r(F.col("frequency") * 86_400_000_000.0).alias("frequency"))


@query("SELECT user_id, round(min(value) * 0.001, 9) AS min, round(max(value) * 0.001, 9) AS max, round(avg(value) * 0.001, 12) AS mean, count(*) AS n FROM events GROUP BY 1")
def metric_documents(t):
    d = summary.documents(_events(t).withColumn("k", F.struct("at", "event_id")), "user_id", "k", "value")
    return d.select("user_id", r("min", 9).alias("min"), r("max", 9).alias("max"), r("mean", 12).alias("mean"), F.size("values").cast("long").alias("n"))


@query("SELECT o_orderstatus AS status, 'price' AS metric, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'customer', round(avg(o_custkey), 4) FROM orders GROUP BY 1")
def cross_metric_union(t):
    o = t("orders").withColumnRenamed("o_orderstatus", "status")
    mean = lambda c: o.groupBy("status").agg(r(F.avg(c), 4).alias("mean"))
    return summary.cross_metric({"price": mean("o_totalprice"), "customer": mean("o_custkey")})


# --- ordered series ------------------------------------------------------------------------------------------------

BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


def _w():
    return series.along(["user_id"], ["ts", "event_id"])


@query(f"SELECT event_id, row_number() {BY_USER}) AS points_order, round(value - lag(value) {BY_USER}), 6) AS diff, round((value - lag(value) {BY_USER})) / nullif((epoch_us(ts) - lag(epoch_us(ts)) {BY_USER})) / 3600000000.0, 0), 4) AS speed FROM events")
def first_difference(t):
    e, w = _events(t), _w()
    d = series.difference("value", w)
    return e.select("event_id", series.points_order(w).alias("points_order"), r(d).alias("diff"), r(d / F.nullif(series.difference("at", w) / 3_600_000_000.0, F.lit(0.0)), 4).alias("speed"))


@query(f"SELECT event_id, round(sqrt(pow(value - lag(value) {BY_USER}), 2) + pow(event_id % 100 - lag(event_id % 100) {BY_USER}), 2)), 6) AS step FROM events")
def step_lengths(t):
    e = t("events").withColumn("z", F.col("event_id") % 100)
    return e.select("event_id", r(series.step_length(["value", "z"], _w())).alias("step"))


@query(f"SELECT event_id, round(median(value) {BY_USER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m4, round(median(value) {BY_USER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m5 FROM events")
def moving_median(t):
    w = _w()
    return t("events").select("event_id", r(series.moving_median("value", w, 4)).alias("m4"), r(series.moving_median("value", w, 5)).alias("m5"))


@query(f"SELECT event_id, round(avg(value) {BY_USER} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING), 9) AS mean FROM events")
def moving_mean(t):
    return t("events").select("event_id", r(series.moving_mean("value", _w(), 50), 9).alias("mean"))


@query(f"SELECT event_id, min(value) {BY_USER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS low, max(value) {BY_USER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS high FROM events")
def moving_minmax_envelope(t):
    low, high = series.envelope("value", _w(), 5)
    return t("events").select("event_id", low.alias("low"), high.alias("high"))


@query(f"""WITH f AS (SELECT *, value > 50 AS flag FROM events), s AS (SELECT *, (flag AND NOT coalesce(lag(flag) {BY_USER}), false))::INT AS st FROM f)
  SELECT event_id, (sum(st) {BY_USER} ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM s QUALIFY flag""")
def gaps_islands(t):
    return series.islands(t("events"), F.col("value") > 50, ["user_id"], ["ts", "event_id"]).select("event_id", "island")


@query(f"SELECT event_id, coalesce(event_type <> lag(event_type) {BY_USER}), false) AS changed FROM events")
def segment_changes(t):
    return t("events").select("event_id", series.changes("event_type", _w()).alias("changed"))


@query(f"""WITH c AS (SELECT *, coalesce(event_type = 'signup' AND lag(event_type) {BY_USER}) <> 'signup' OR event_type <> 'signup' AND lag(event_type) {BY_USER}) = 'signup', false)::INT AS ch FROM events),
  n AS (SELECT *, max(ch) {BY_USER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM c) SELECT event_id FROM n WHERE near = 1""")
def rows_near_changes(t):
    e = t("events").withColumn("phase", F.col("event_type") == "signup")
    return series.near_changes(e, "phase", ["user_id"], ["ts", "event_id"], 3).select("event_id")


@query(f"SELECT event_id FROM (SELECT event_id, row_number() {BY_USER}) AS k FROM events) WHERE k % 15 = 1")
def every_15th(t):
    return series.every_nth(t("events"), 15, ["user_id"], ["ts", "event_id"]).select("event_id")


SEGS_SQL = f"s AS (SELECT *, ((row_number() {BY_USER}) - 1) // 10)::BIGINT AS seg FROM events)"


def _segs(t):
    return t("events").withColumn("seg", series.groups_of(10, _w()))


@query("""WITH w AS (SELECT event_id, median(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS middle, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mean, value - lag(value) OVER (ORDER BY ts, event_id) AS step FROM events)
  SELECT event_id, round(middle, 6) AS median, round(mean, 6) AS mean, round(step, 6) AS step FROM w""")
def windows_of_one_series(t):
    """Moving median, mean and differences of all events as one series, which no task holds whole."""
    made = lambda w: {"median": r(series.moving_median("value", w, 9)), "mean": r(series.moving_mean("value", w, 5)), "step": r(series.difference("value", w))}
    return dealt.framed(t("events").select("event_id", "ts", "value"), [], ["ts", "event_id"], 4, 4, made).select("event_id", "median", "mean", "step")


@query("""WITH f AS (SELECT event_id, ts, coalesce(value > 20, false) AS flag FROM events), s AS (SELECT *, (flag AND NOT coalesce(lag(flag) OVER (ORDER BY ts, event_id), false))::INT AS st FROM f),
  i AS (SELECT *, sum(st) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s) SELECT event_id, island FROM i WHERE flag""")
def islands_of_one_series(t):
    return dealt.islands(t("events").select("event_id", "ts", "value"), F.col("value") > 20, [], ["ts", "event_id"]).select("event_id", "island")


@query(f"WITH {SEGS_SQL} SELECT event_id, seg FROM s")
def fixed_size_groups(t):
    return _segs(t).select("event_id", "seg")


@query(f"WITH {SEGS_SQL} SELECT event_id, seg FROM s QUALIFY seg < max(seg) OVER (PARTITION BY user_id) AND seg <> 0")
def without_first_and_last_segment(t):
    return series.without_lead_in(_segs(t), ["user_id"], "seg").select("event_id", "seg")


@query(f"""WITH d AS (SELECT *, abs(value - lag(value) {BY_USER})) AS step FROM events), l AS (SELECT *, least(40.0, avg(step) OVER (PARTITION BY user_id) + 2 * coalesce(stddev_samp(step) OVER (PARTITION BY user_id), 0)) AS lim FROM d),
  f AS (SELECT *, coalesce(step < lim, false) AS flag FROM l), s AS (SELECT *, (flag AND NOT coalesce(lag(flag) {BY_USER}), false))::INT AS st FROM f), i AS (SELECT *, sum(st) {BY_USER} ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT event_id FROM i WHERE flag AND island = 1""")
def standstill_run(t):
    e = t("events").withColumn("step", F.abs(series.difference("value", _w())))
    return series.standstill(e, "step", ["user_id"], ["ts", "event_id"], 40.0).select("event_id")


@query(f"""WITH d AS (SELECT *, sqrt(pow(value - lag(value) {BY_USER}), 2) + pow(event_id % 100 - lag(event_id % 100) {BY_USER}), 2)) AS step FROM events),
  g AS (SELECT user_id, sum(step) AS length, sqrt(pow(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 2) + pow(arg_max(event_id % 100, (ts, event_id)) - arg_min(event_id % 100, (ts, event_id)), 2)) AS chord FROM d GROUP BY 1)
  SELECT user_id, round(length, 4) AS length, CASE WHEN abs(length - chord) <= 0.03 * chord THEN 'linear' ELSE 'spline' END AS kind FROM g""")
def path_length_and_kind(t):
    e = t("events").withColumn("z", F.col("event_id") % 100)
    d, at = e.withColumn("step", series.step_length(["value", "z"], _w())), F.struct("ts", "event_id")
    chord = F.sqrt(sum((F.pow(F.max_by(c, at) - F.min_by(c, at), 2) for c in ("z",)), F.pow(F.max_by("value", at) - F.min_by("value", at), 2)))
    g = d.groupBy("user_id").agg(F.sum("step").alias("length"), chord.alias("chord"))
    return g.select("user_id", r("length", 4).alias("length"), series.path_kind(F.col("length"), F.col("chord")).alias("kind"))


# --- vectors, embeddings, features ---------------------------------------------------------------------------------

SEQ = "seq"
SEQ_SQL = f"seqs AS (SELECT user_id, list([value, {HOUR_SQL}, (event_id % 100)::DOUBLE] ORDER BY ts, event_id) AS seq, count(*) AS n FROM events GROUP BY 1)"


def _resample_sql(seq: str, n: int, dim: int) -> str:
    """Flat list of one dimension of a linear resampling of the list column (m points)."""
    at = f"(i * (m - 1) / {max(1, n - 1)}.0)"
    low = f"least(floor({at})::BIGINT, m - 1)"
    return f"""list_transform(range({n}), lambda i: CASE WHEN m <= {n} THEN {seq}[least(i, m - 1) + 1][{dim}]
      ELSE {seq}[{low} + 1][{dim}] + ({seq}[least({low} + 1, m - 1) + 1][{dim}] - {seq}[{low} + 1][{dim}]) * ({at} - {low}) END)"""


def _seqs(t):
    return tables.sequences(_points(t), ["traj_id"]).withColumnRenamed("traj_id", "user_id")


@query(f"WITH {SEQ_SQL}, m AS (SELECT user_id, seq, n AS m FROM seqs), f AS (SELECT user_id, {', '.join(f'unnest({_resample_sql(SEQ, 20, d)}) AS {c}' for d, c in enumerate('xyz', 1))}, unnest(range(1, 21)) AS k FROM m) SELECT user_id, k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM f")
def resample_linear(t):
    rows = _seqs(t).select("user_id", F.posexplode(vectors.resample("seq", 20)).alias("i", "p"))
    return rows.select("user_id", (F.col("i") + 1).cast("long").alias("k"), *[r(F.col("p")[i]).alias(c) for i, c in enumerate("xyz")])


@query("""WITH b AS (SELECT user_id, min(value) AS lo, max(value) AS hi, min(event_id) AS lo2, max(event_id) AS hi2 FROM events GROUP BY 1)
  SELECT event_id, round((value - lo) / CASE WHEN hi - lo < 1e-9 THEN 1 ELSE hi - lo END, 6) AS scaled, round((event_id - lo2) / CASE WHEN hi2 - lo2 < 1e-9 THEN 1.0 ELSE (hi2 - lo2)::DOUBLE END, 6) AS scaled_id FROM events JOIN b USING (user_id)""")
def minmax_normalise(t):
    p = tables.sequences(_events(t).select("user_id", F.struct("ts", "event_id").alias("ord"), F.array("value", F.col("event_id").cast("double")).alias("v")), ["user_id"])
    both = p.select("user_id", F.explode(F.arrays_zip("seq", vectors.min_max("seq", 2).alias("scaled"))).alias("e"))
    return both.select(F.col("e.seq")[1].cast("long").alias("event_id"), r(F.col("e.scaled")[0]).alias("scaled"), r(F.col("e.scaled")[1]).alias("scaled_id"))


def _shape_cte(coarse: int, fine: int) -> str:
    """f(user_id, v): position embeddings, not yet of unit length."""
    parts = " || ".join(_resample_sql("sc", n, d) for n in (coarse, fine) for d in (1, 2, 3))
    return f"""{SEQ_SQL}, c AS (SELECT user_id, n AS m, list_transform(seq, lambda p: [p[1] - seq[1][1], p[2] - seq[1][2], p[3] - seq[1][3]]) AS s0 FROM seqs),
  e AS (SELECT *, list_max(list_transform(s0, lambda p: sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3]))) AS ext FROM c),
  s AS (SELECT user_id, m, list_transform(s0, lambda p: CASE WHEN ext > 1e-6 THEN [p[1] / ext, p[2] / ext, p[3] / ext] ELSE p END) AS sc FROM e),
  f AS (SELECT user_id, {parts} AS v FROM s)"""


@query(f"WITH {_shape_cte(5, 10)} SELECT user_id, unnest(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6))) AS x, generate_subscripts(v, 1) AS k FROM f")
def position_embedding(t):
    rows = _seqs(t).select("user_id", F.posexplode(vectors.position_embedding("seq", 5, 10)).alias("i", "x"))
    return rows.select("user_id", r("x").alias("x"), (F.col("i") + 1).cast("long").alias("k"))


@query(f"""WITH {SEQ_SQL}, m AS (SELECT user_id, seq, n AS m FROM seqs), f AS (SELECT user_id, {' || '.join(_resample_sql('seq', 8, d) for d in (1, 2, 3))} AS v FROM m)
  SELECT user_id, unnest(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6))) AS x, generate_subscripts(v, 1) AS k FROM f""")
def joint_embedding(t):
    rows = _seqs(t).select("user_id", F.posexplode(vectors.joint_embedding("seq", 8, 0, 3)).alias("i", "x"))
    return rows.select("user_id", r("x").alias("x"), (F.col("i") + 1).cast("long").alias("k"))


def _exploded(rows, vector, *keys, digits: int = 6):
    """One row for each component of a vector; -0 counts as 0."""
    return rows.select(*keys, F.posexplode(vector).alias("i", "x")).select(*keys, (F.col("i") + 1).cast("long").alias("k"), (r("x", digits) + 0.0).alias("x"))


def _exploded_sql(source: str, *keys: str) -> str:
    return f"SELECT {', '.join(keys)}, generate_subscripts(v, 1) AS k, unnest(list_transform(v, lambda c: round(c, 6) + 0.0)) AS x FROM {source}"


AXIS_SQL = f"""WITH o AS (SELECT user_id AS traj_id, ts, event_id, radians(value % 100) AS a FROM events WHERE event_id % 2 = 0),
  q AS (SELECT *, CASE WHEN sin(acos(greatest(-1.0, least(1.0, cos(a / 2))))) = 0 THEN 1.0 ELSE sin(acos(greatest(-1.0, least(1.0, cos(a / 2))))) END AS h FROM o),
  l AS (SELECT traj_id, list([sin(a / 2) * 0.6 / h, sin(a / 2) * 0.8 / h, 0.0] ORDER BY ts, event_id) AS s0, count(*) AS m FROM q GROUP BY 1),
  s AS (SELECT traj_id, m, list_transform(s0, lambda p: [p[1] - s0[1][1], p[2] - s0[1][2], p[3] - s0[1][3]]) AS sc FROM l),
  f AS (SELECT traj_id, {' || '.join(_resample_sql('sc', n, d) for n in (5, 10) for d in (1, 2, 3))} AS v FROM s),
  u AS (SELECT traj_id, CASE WHEN sqrt(list_dot_product(v, v)) > 1e-10 THEN list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM f)
  {_exploded_sql('u', 'traj_id')}"""


@query(AXIS_SQL)
def axis_embedding(t):
    xyzw = tables.sequences(_orientations(t, 0), ["traj_id"]).withColumn("seq", F.transform("seq", lambda p: F.array(p[1], p[2], p[3], p[0])))
    return _exploded(xyzw, vectors.axis_embedding("seq", 5, 10), "traj_id")


VELOCITY_SQL = f"WITH {recurrences.velocity('e', 'value', HOUR_SQL)} {_exploded_sql('e', 'user_id')}"


@query(VELOCITY_SQL)
def velocity_embedding(t):
    return _exploded(alignment.velocity_embeddings(_seqs(t), "seq", 5, 10), "velocity_embedding", "user_id")


STATS_SQL = "min({c}) AS mn{s}, max({c}) AS mx{s}, avg({c}) AS me{s}, median({c}) AS md{s}, coalesce(stddev_samp({c}), 0) AS sd{s}"
META_SQL = f"""g AS (SELECT o_custkey AS id, count(*) * 300.0 AS length, count(*)::DOUBLE AS duration, {STATS_SQL.format(c='o_totalprice / 200', s='t')}, {STATS_SQL.format(c='o_totalprice / 50', s='a')} FROM orders GROUP BY 1),
  c AS (SELECT g.*, lower(c_mktsegment) AS mv, c_acctbal AS target, c_nationkey AS parent FROM g JOIN customer ON id = c_custkey),
  mvs AS (SELECT *, length(mv) - length(replace(mv, 'l', '')) + contains(mv, 'linear')::INT AS nl, length(mv) - length(replace(mv, 'c', '')) + contains(mv, 'circular')::INT AS nc FROM c)"""


def _meta(t):
    o = t("orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 200).alias("tw"), (F.col("o_totalprice") / 50).alias("ac"))
    five = [f for c, s in (("tw", "t"), ("ac", "a")) for f in (F.min(c).alias(f"mn{s}"), F.max(c).alias(f"mx{s}"), F.avg(c).alias(f"me{s}"), F.expr(f"percentile({c}, 0.5)").alias(f"md{s}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd{s}"))]
    g = o.groupBy("id").agg((F.count("*") * 300.0).alias("length"), F.count("*").cast("double").alias("duration"), *five)
    return g.join(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("movement"), F.col("c_acctbal").alias("target"), F.col("c_nationkey").alias("parent")), "id")


_STAT_COLS = {s: dict(zip(vectors.STATISTICS, (f"mn{s}", f"mx{s}", f"me{s}", f"md{s}", f"sd{s}"))) for s in "ta"}


def _scaled_sql(s: str, most: float, clamp: bool) -> list[str]:
    parts = [f"({c}{s} + {most}) / {2 * most}" for c in ("mn", "mx", "me", "md")] + [f"sd{s} / {most}"]
    return [f"greatest(0, least(1, {p}))" if clamp else p for p in parts]


@query(f"""WITH {META_SQL}, f AS (SELECT id, [CASE WHEN nl + nc > 0 THEN nl / (nl + nc)::DOUBLE ELSE 0 END, CASE WHEN nl + nc > 0 THEN nc / (nl + nc)::DOUBLE ELSE 0 END, least(length / 9000, 1), least(duration / 25, 1), {', '.join(_scaled_sql('t', 3100.0, False) + _scaled_sql('a', 10200.0, False))}]::DOUBLE[] AS v FROM mvs)
  SELECT id, unnest(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6))) AS x, generate_subscripts(v, 1) AS k FROM f""")
def metadata_embedding(t):
    e = vectors.metadata_embedding("movement", "length", "duration", _STAT_COLS["t"], _STAT_COLS["a"])
    return _meta(t).select("id", F.posexplode(e).alias("i", "x")).select("id", r("x").alias("x"), (F.col("i") + 1).cast("long").alias("k"))


KNN_SQL = f"""WITH {META_SQL}, f AS (SELECT id, target, parent, [{', '.join(_scaled_sql('t', 3200.0, True) + _scaled_sql('a', 10200.0, True))}, greatest(0, least(1, length / 9000)), greatest(0, least(1, duration / 25)), CASE WHEN nl + nc > 0 THEN nl / (nl + nc)::DOUBLE ELSE 0 END]::DOUBLE[] AS v FROM mvs),
  d AS (SELECT a.id AS query_id, b.id, b.target, round(list_distance(a.v, b.v), 9) AS distance FROM f a, f b WHERE a.id % 50 = 0 AND a.id <> b.id AND a.parent <> b.parent),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)"""


def _knn(t, k):
    m = _meta(t).withColumn("vec", prediction.features(_STAT_COLS["t"], _STAT_COLS["a"], "length", "duration", "movement")).select("id", "vec", "target", "parent")
    m = settled(m)  # an aggregation of all orders that is read several times
    asked = m.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("parent").alias("query_parent"))
    return prediction.feature_neighbours(asked, m, k, digits=9)


@query(KNN_SQL + " SELECT query_id, id, target, distance, rank FROM n WHERE rank <= 10")
def knn_features(t):
    return _knn(t, 10)


@query(KNN_SQL + ", ks(k) AS (VALUES (5), (10), (25), (50)) SELECT query_id, k, round(avg(target), 4) AS mean, round(sum(target / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 4) AS weighted FROM n JOIN ks ON rank <= k GROUP BY ALL")
def knn_predictions_by_k(t):
    p = prediction.predictions_at(_knn(t, 50), [5, 10, 25, 50])
    return p.select("query_id", "k", r("mean", 4).alias("mean"), r("weighted", 4).alias("weighted"))


@query(KNN_SQL + """, p AS (SELECT query_id, avg(target) FILTER (rank <= 5) AS mean, min(distance) AS nearest FROM n GROUP BY 1)
  SELECT count(*) AS n, round(corr(nearest, abs(mean - f.target)), 6) AS correlation FROM p JOIN f ON f.id = query_id""")
def neighbour_coverage(t):
    near = _knn(t, 5)
    actual = t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_acctbal").alias("actual"))
    errors = prediction.predictions_at(near, [5]).join(actual, "query_id").select("query_id", F.abs(F.col("mean") - F.col("actual")).alias("error"))
    return prediction.neighbour_coverage(near, errors).select("n", r("correlation").alias("correlation"))


@query(f"""WITH {HALVES_SQL} SELECT a.id AS query_id, b.id, round(list_distance(a.vec, b.vec), 6) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.vec[i] - b.vec[i]))), 6) AS manhattan,
  round(list_max(list_transform(range(1, 65), lambda i: abs(a.vec[i] - b.vec[i]))), 6) AS chebyshev, round(list_min(list_transform(range(1, 65), lambda i: abs(a.vec[i] - b.vec[i]))), 6) AS smallest,
  round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(least(abs(a.vec[i] - b.vec[i]), 2 * pi() - abs(a.vec[i] - b.vec[i])), 2)))), 6) AS angular FROM h a, h b WHERE a.id % 50 = 0""")
def pairwise_distances(t):
    v = _vectors(t)
    both = blocks.all_distances(_asked(v, F.col("vec").alias("query_vec")), v.select("id", "vec"), list(blocks.MEASURES))
    return both.select("query_id", "id", *[proximity.rounded(F.col(m), 6).alias(m) for m in blocks.MEASURES])


def _extreme_sql(side: str, pick: str) -> str:
    return "[" + ", ".join(f"list_{pick}(list_transform({side}, lambda p: p[{d}]))" for d in (1, 2, 3)) + "]"


@query(f"""WITH {recurrences.PAIRS} SELECT query_id, id, round(greatest(list_distance(a[1], b[1]), list_distance(a[-1], b[-1]), list_distance({_extreme_sql('a', 'min')}, {_extreme_sql('b', 'min')}), list_distance({_extreme_sql('a', 'max')}, {_extreme_sql('b', 'max')})), 6) AS bound FROM pairs""")
def kim_bound(t):
    """Kim's bound of whole sequences as they are; kim_bound_sequences resamples the candidate to the query's length first."""
    return _sequence_pairs(t, "bound_as_is").select("query_id", "id", r("distance").alias("bound"))


# --- alignment -----------------------------------------------------------------------------------------------------


def _aligned(t, metric, digits: int = 6):
    turned = metric in accuracy.ORIENTATION_METRICS
    sides = (_orientations(t, 0), _orientations(t, 1)) if turned else (_points(t, 0), _points(t, 1))
    d = alignment.align(*sides, metric, 4 if turned else 3)
    return d.select("traj_id", "seg_id", "points_order", r("distance", digits).alias("distance"), r("value", digits).alias("value"), "status")


POINT_RAW_SQL = f"""WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS ord, event_id % 2 AS side, value AS x, {HOUR_SQL} AS y, (event_id % 100)::DOUBLE AS z FROM events),
  a AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM p WHERE side = 0 WINDOW w AS (PARTITION BY user_id ORDER BY ord)), b AS (SELECT * FROM p WHERE side = 1),
  t AS (SELECT b.user_id, b.event_type, b.ord, b.x AS bx, b.y AS by_, b.z AS bz, a.*, greatest(0, least(1, coalesce(((b.x - a.x) * (x2 - a.x) + (b.y - a.y) * (y2 - a.y) + (b.z - a.z) * (z2 - a.z)) / nullif(pow(x2 - a.x, 2) + pow(y2 - a.y, 2) + pow(z2 - a.z, 2), 0), 0))) AS s FROM b JOIN a ON a.user_id = b.user_id)
  SELECT user_id AS traj_id, event_type AS seg_id, ord AS points_order, min(sqrt(pow(bx - x - s * coalesce(x2 - x, 0), 2) + pow(by_ - y - s * coalesce(y2 - y, 0), 2) + pow(bz - z - s * coalesce(z2 - z, 0), 2))) AS distance FROM t GROUP BY ALL""".replace("t AS (SELECT b.user_id, b.event_type, b.ord, b.x AS bx, b.y AS by_, b.z AS bz, a.*,", "t AS (SELECT b.user_id, b.event_type, b.ord, b.x AS bx, b.y AS by_, b.z AS bz, a.x, a.y, a.z, x2, y2, z2,")
POINT_SQL = f"SELECT traj_id, seg_id, points_order, round(distance, 6) AS distance FROM ({POINT_RAW_SQL})"


@query(POINT_SQL)
def point_to_curve(t):
    return _aligned(t, "point_to_curve").select("traj_id", "seg_id", "points_order", "distance")


@query(recurrences.POINT_TO_PCHIP)
def point_to_pchip(t):
    """Distances from the shape-preserving cubic through the nominal points."""
    d = _aligned(t, "point_to_pchip", 4)
    return d.select("traj_id", "seg_id", "points_order", "distance")


@query(recurrences.SIDTW)
def sidtw(t):
    return _aligned(t, "sidtw")


@query(recurrences.DTW)
def dtw(t):
    return _aligned(t, "dtw")


@query(recurrences.FRECHET)
def frechet(t):
    return _aligned(t, "frechet")


@query(recurrences.LCSS)
def lcss(t):
    return _aligned(t, "lcss")


@query(recurrences.QAD)
def qad(t):
    return _aligned(t, "qad", 8)


@query(f"WITH {recurrences.TURNED} SELECT user_id AS traj_id, i + 1 AS ord, round(u[1], 6) + 0.0 AS w, round(u[2], 6) + 0.0 AS x, round(u[3], 6) + 0.0 AS y FROM nominal")
def orientations_without_jumps(t):
    out = alignment.without_jumps(_orientations(t, 0))
    return out.select("traj_id", F.col("ord").cast("long").alias("ord"), *[(r(F.col("cleaned")[i]) + 0.0).alias(c) for i, c in enumerate("wxy")])


@query(recurrences.QDTW)
def qdtw(t):
    return _aligned(t, "qdtw", 8)


@query(recurrences.accuracy_summary(POINT_RAW_SQL))
def accuracy_summary(t):
    """Every position metric, summed up for whole trajectories, segment by segment alignment for DTW."""
    rows = accuracy.whole_summaries(_points(t, 0), _points(t, 1), by_segment=("dtw",))
    return rows.select("metric", "traj_id", *[r(c).alias(c) for c in ("min_distance", "max_distance", "average_distance", "standard_deviation")])


def _sequence_pairs(t, measure: str, **options):
    """Every user for each user divisible by 50, with a distance of their sequences."""
    s = settled(_seqs(t).select(F.col("user_id").alias("id"), "seq"))
    return sequence_blocks.all_pairs(s.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), s, measure, **options)


def _candidates(t):
    """(every user for each user divisible by 50, in the order of ids, as ids alone; the users' sequences)."""
    s = settled(_seqs(t).select(F.col("user_id").alias("id"), "seq"))
    both = ranking.pairs(s.where("id % 50 = 0").select(F.col("id").alias("query_id")), s.select("id")).where("id <> query_id")
    return ranking.rank_by(both, ["query_id"], ["id"], "rank_s1"), s


@query(recurrences.CDTW)
def cdtw(t):
    d = _sequence_pairs(t, "constrained_dtw", window=0.15)
    return d.select("query_id", "id", r("distance").alias("distance"))


@query(recurrences.KIM)
def kim_bound_sequences(t):
    """Kim's bound, the candidate resampled to the query's length."""
    d = _sequence_pairs(t, "kim_bound")
    return d.select("query_id", "id", r("distance").alias("bound"))


@query(recurrences.KEOGH)
def keogh_bound(t):
    d = _sequence_pairs(t, "keogh_bound", window=0.15)
    return d.select("query_id", "id", r("distance").alias("distance"))


@query(recurrences.RESAMPLED)
def resampled_distance(t):
    d = _sequence_pairs(t, "resampled_distance")
    return d.select("query_id", "id", r("distance").alias("distance"))


@query(recurrences.STAGED)
def staged_rerank(t):
    out = prediction.staged_rerank(*_candidates(t), kim_share=0.5, keogh_most=20, window=0.2)
    return out.select("query_id", "id", "rank_s1", r("dtw_dist").alias("dtw_dist"), "rank_s2", "rank_change")


TWO_STAGE_SQL = f"""WITH RECURSIVE {_shape_cte(5, 10)}, jm AS (SELECT user_id, seq, n AS m FROM seqs), jf AS (SELECT user_id, {' || '.join(_resample_sql('seq', 8, d) for d in (1, 2, 3))} AS v FROM jm),
  emb AS (SELECT 'position' AS modality, user_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM f UNION ALL SELECT 'joint', user_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM jf),
  ranked AS (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY modality, a.id ORDER BY 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), b.id) AS rank FROM emb a JOIN emb b USING (modality) WHERE a.id % 50 = 0 AND a.id <> b.id QUALIFY rank <= 20),
  fused AS (SELECT query_id, id, sum(1 / (60.0 + rank)) AS score FROM ranked GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_s1 FROM fused QUALIFY rank_s1 <= 20),
  pairs AS (SELECT query_id, best.id, q.seq AS a, c.seq AS b, len(q.seq) AS n, len(c.seq) AS m FROM best JOIN seqs q ON q.user_id = query_id JOIN seqs c ON c.user_id = best.id), {recurrences.band(window=0.2)},
  again AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY distance, rank_s1) AS rank FROM best JOIN cdtw USING (query_id, id)), targets AS (SELECT user_id AS id, avg(value) AS target FROM events GROUP BY 1)
  SELECT query_id, round(avg(target), 6) AS mean, round(sum(target * score * score) / sum(score * score), 6) AS weighted, count(*) AS n FROM again JOIN targets USING (id) WHERE rank <= 5 GROUP BY 1"""


def _shapes(t):
    return _seqs(t).select(F.col("user_id").alias("id"), "seq").withColumn("position", vectors.position_embedding("seq", 5, 10)).withColumn("joint", vectors.joint_embedding("seq", 8, 0, 3))


@query(TWO_STAGE_SQL)
def two_stage_search(t):
    """Fused candidates by position and joint embeddings, reranked, and the mean value of their first five as prediction."""
    return _two_stage(t, _shapes(t))


@query(TWO_STAGE_SQL)
def two_stage_indexed(t):
    """two_stage_search with both embeddings searched in stored indexes."""
    s = settled(_shapes(t))
    return _two_stage(t, s, {m: CosineIndex.build(s.select("id", F.col(m).alias("vec")), scratch_path(s.sparkSession, m)) for m in ("position", "joint")})


def _two_stage(t, s, indexes=None):
    found = search.two_stage(_asked(s, "position", "joint"), s, ["position", "joint"], s, 20, indexes=indexes, window=0.2)
    targets = t("events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("target"))
    p = search.predict(found, targets, "target", 5, rrf_power=2)
    return p.select("query_id", r("mean").alias("mean"), r("weighted").alias("weighted"), "n")


SWEEP = [("short", 5, 0), ("both", 5, 10)]
UNIT_SQL = "CASE WHEN sqrt(list_dot_product(v, v)) > 1e-10 THEN list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) ELSE v END"
SWEEP_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS config, '{kind}' AS modality, * FROM ({sql})"
    for name, coarse, fine in SWEEP
    for kind, sql in (
        ("position", f"WITH {_shape_cte(coarse, fine)}, u AS (SELECT user_id AS id, {UNIT_SQL} AS v FROM f) {_exploded_sql('u', 'id')}"),
        ("joint", f"WITH {SEQ_SQL}, m AS (SELECT user_id, seq, n AS m FROM seqs), f AS (SELECT user_id, {' || '.join(_resample_sql('seq', n, d) for n in (coarse, fine) if n for d in (1, 2, 3))} AS v FROM m), u AS (SELECT user_id AS id, {UNIT_SQL} AS v FROM f) {_exploded_sql('u', 'id')}"),
        ("velocity", f"WITH {recurrences.velocity('e', 'value', HOUR_SQL, tuple(n for n in (coarse, fine) if n))}, u AS (SELECT user_id AS id, v FROM e) {_exploded_sql('u', 'id')}"),
    )
)


_KINDS = {"position": lambda c, f: vectors.position_embedding("seq", c, f), "joint": lambda c, f: vectors.joint_embedding("seq", c, f, 3)}


@query(SWEEP_SQL)
def embedding_sweep(t):
    """Position, joint and velocity embeddings of every user's sequence in two configurations."""
    rows = search.embedding_sweep(_seqs(t).select(F.col("user_id").alias("id"), "seq"), SWEEP, _KINDS, velocity="seq")
    return _exploded(rows, "vec", "config", "modality", "id")


@query(SWEEP_SQL)
def stored_embedding_sweep(t):
    """The sweep out of a store that had a third of the users under one configuration before."""
    rows = _seqs(t).select(F.col("user_id").alias("id"), F.lit("trajectory").alias("level"), "seq")
    store = EmbeddingStore(rows.sparkSession, scratch_path(rows.sparkSession, "embeddings"))
    store.ensure(rows.where("id % 3 = 0"), SWEEP[1:], _KINDS, "seq")
    return _exploded(store.sweep(rows, SWEEP, _KINDS, "seq"), "vec", "config", "modality", "id")


@query(f"""WITH h AS (SELECT event_id AS id, user_id AS parent, value AS x, (event_id % 100)::DOUBLE AS y FROM events), e AS (SELECT id, parent, 'plain' AS config, [x, y, 1.0] AS v FROM h UNION ALL SELECT id, parent, 'wide', [x * 3, y, 1.0] FROM h),
  d AS (SELECT config, a.id AS query_id, b.id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 9) AS distance FROM e a JOIN e b USING (config) WHERE a.id % 50 = 0 AND a.parent <> b.parent)
  SELECT * FROM (SELECT config, 'shape' AS modality, 'segment' AS level, query_id, id, distance, row_number() OVER (PARTITION BY config, query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 3""")
def sweep_search(t):
    """The nearest rows under two configurations; rows of the query's own user take no part."""
    rows = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("parent"), F.lit("segment").alias("level"), "value", (F.col("event_id") % 100).cast("double").alias("y"))
    kinds = {"shape": lambda c, f: F.array(F.col("value") * float(c), F.col("y"), F.lit(1.0))}
    each = search.embedding_sweep(rows, [("plain", 1, 0), ("wide", 3, 0)], kinds)
    return search.sweep_search(each, F.col("id") % 50 == 0, 3, digits=9)


@query(f"WITH RECURSIVE {recurrences.PAIRS}, {recurrences.band(window=0.2)}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank_s2 FROM cdtw) SELECT query_id, id, round(distance, 6) AS dtw_dist, rank_s2 FROM k WHERE rank_s2 <= 10")
def exact_rerank(t):
    """The ten nearest by constrained DTW; bounds spare only distances that cannot be among them."""
    candidates, sequences = _candidates(t)
    return prediction.exact_rerank(candidates, 10, sequences, window=0.2).select("query_id", "id", r("dtw_dist").alias("dtw_dist"), "rank_s2")


@query(recurrences.adaptive(prediction.SMALL_LIST))
def adaptive_rerank(t):
    return prediction.adaptive_rerank(*_candidates(t), window=0.2).select("query_id", "id", "rank_s1", r("dtw_dist").alias("dtw_dist"), "rank_s2")


@query(f"""WITH RECURSIVE {SEQ_SQL}, f AS (SELECT user_id, avg(value) AS target, [avg(value), count(*) / 10.0, avg(event_id % 100)] AS v FROM events GROUP BY 1),
  near AS (SELECT a.user_id AS query_id, b.user_id AS id, b.target, row_number() OVER (PARTITION BY a.user_id ORDER BY round(list_distance(a.v, b.v), 6), b.user_id) AS rank_s1 FROM f a JOIN f b ON a.user_id <> b.user_id WHERE a.user_id % 50 = 0 QUALIFY rank_s1 <= 20),
  pairs AS (SELECT query_id, near.id, q.seq AS a, c.seq AS b, len(q.seq) AS n, len(c.seq) AS m FROM near JOIN seqs q ON q.user_id = query_id JOIN seqs c ON c.user_id = near.id), {recurrences.band(window=0.2)},
  again AS (SELECT near.*, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, rank_s1) AS rank FROM near JOIN cdtw USING (query_id, id))
  SELECT query_id, k, round(avg(target), 6) AS mean, round(sum(target / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS weighted FROM again, (SELECT unnest([3, 8]) AS k) WHERE rank <= k GROUP BY ALL""")
def knn_predictions_by_dtw(t):
    """Feature neighbours of a user put in the order of constrained DTW, and the predictions of the first three and eight."""
    f = t("events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("target"), F.array(F.avg("value"), F.count("*") / 10.0, F.avg(F.col("event_id") % 100)).alias("vec"))
    near = prediction.feature_neighbours(_asked(f, F.col("vec").alias("query_vec")), f, 20, same_parent=False, digits=6)
    done = prediction.reranked_by_dtw(near, _seqs(t).select(F.col("user_id").alias("id"), "seq"), window=0.2)
    return prediction.predictions_at(done, [3, 8]).select("query_id", "k", r("mean").alias("mean"), r("weighted").alias("weighted"))


@query(recurrences.SAVINGS)
def rerank_savings(t):
    out = prediction.savings(prediction.staged_rerank(*_candidates(t), kim_share=0.5, keogh_most=20, window=0.2))
    return out.withColumn("saved_percent", r("saved_percent"))


# --- geometry ------------------------------------------------------------------------------------------------------

QUAT_SQL = "a AS (SELECT event_id, user_id, radians(value) AS a, radians((event_id % 90)::DOUBLE) AS b FROM events), q AS (SELECT *, [cos(a / 2), sin(a / 2) * 0.6, sin(a / 2) * 0.8, 0.0] AS p, [cos(b / 2), 0.0, 0.0, sin(b / 2)] AS r FROM a)"


def _quats(t):
    a, b = F.radians("value"), F.radians((F.col("event_id") % 90).cast("double"))
    p = q.quat(F.cos(a / 2), F.sin(a / 2) * 0.6, F.sin(a / 2) * 0.8, F.lit(0.0))
    return t("events").select("event_id", "user_id", "value", p.alias("p"), q.quat(F.cos(b / 2), F.lit(0.0), F.lit(0.0), F.sin(b / 2)).alias("r"))


@query(f"WITH {QUAT_SQL} SELECT event_id, round(2 * degrees(acos(least(1.0, abs(list_dot_product(p, r))))), 5) AS angle FROM q")
def quaternion_angle(t):
    return _quats(t).select("event_id", r(q.angle_degrees("p", "r"), 5).alias("angle"))


PRODUCT = "[p[1]*r[1]-p[2]*r[2]-p[3]*r[3]-p[4]*r[4], p[1]*r[2]+p[2]*r[1]+p[3]*r[4]-p[4]*r[3], p[1]*r[3]-p[2]*r[4]+p[3]*r[1]+p[4]*r[2], p[1]*r[4]+p[2]*r[3]-p[3]*r[2]+p[4]*r[1]]"


@query(f"WITH {QUAT_SQL}, m AS (SELECT event_id, {PRODUCT} AS m FROM q) SELECT event_id, round(m[1], 6) + 0.0 AS w, round(m[2], 6) + 0.0 AS x, round(m[3], 6) + 0.0 AS y, round(m[4], 6) + 0.0 AS z FROM m")
def quaternion_product(t):
    m = _quats(t).select("event_id", q.product("p", "r").alias("m"))
    return m.select("event_id", *[(r(F.col("m")[i]) + 0.0).alias(c) for i, c in enumerate("wxyz")])


@query(f"""WITH {QUAT_SQL}, m AS (SELECT event_id, {PRODUCT} AS m FROM q), e AS (SELECT event_id, m[1] AS w, m[2] AS x, m[3] AS y, m[4] AS z FROM m), u AS (SELECT *, -(2 * (x * z - y * w)) AS up FROM e)
  SELECT event_id, round(CASE WHEN abs(up) > 0.99999 THEN 0 ELSE degrees(atan2(2 * (y * z + x * w), 1 - 2 * (x * x + y * y))) END, 4) + 0.0 AS roll, round(CASE WHEN abs(up) > 0.99999 THEN sign(up) * 90 ELSE degrees(asin(greatest(-1, least(1, up)))) END, 4) + 0.0 AS pitch,
  round(CASE WHEN abs(up) > 0.99999 THEN degrees(atan2(-(2 * (x * y - z * w)), 1 - 2 * (x * x + z * z))) ELSE degrees(atan2(2 * (x * y + z * w), 1 - 2 * (y * y + z * z))) END, 4) + 0.0 AS yaw FROM u""")
def euler_from_quaternion(t):
    e = _quats(t).select("event_id", q.euler_fixed_xyz(q.product("p", "r")).alias("e"))
    return e.select("event_id", *[(r(F.col("e")[i], 4) + 0.0).alias(c) for i, c in enumerate(("roll", "pitch", "yaw"))])


@query("""SELECT event_id, round(0.36 * value + 0.48 * (event_id % 100) - 0.8 * (event_id % 7) + 1, 6) AS x, round(-0.8 * value + 0.6 * (event_id % 100) + 2, 6) AS y, round(0.48 * value + 0.64 * (event_id % 100) + 0.6 * (event_id % 7) + 3, 6) AS z FROM events""")
def rigid_transform(t):
    p = F.array("value", (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 7).cast("double"))
    rows = t("events").select("event_id", p.alias("p"))
    turn = F.array(*[F.lit(v) for v in (0.36, -0.8, 0.48, 0.48, 0.6, 0.64, -0.8, 0.0, 0.6)])
    moved = rows.select("event_id", calibration.transformed("p", turn, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("m"))
    return moved.select("event_id", *[r(F.col("m")[i]).alias(c) for i, c in enumerate("xyz")])


ALGEBRA_SQL = f"""WITH {QUAT_SQL}, c AS (SELECT event_id, a / 2 AS h, p, r, sqrt(p[2] * p[2] + p[3] * p[3]) AS v, list_dot_product(p, r) AS dot FROM q),
  f AS (SELECT event_id, 'inverse' AS form, [p[1], -p[2], -p[3], -p[4]] AS x FROM c UNION ALL SELECT event_id, 'log', CASE WHEN v = 0 THEN [0.0, 0.0, 0.0, 0.0] ELSE [0.0, atan2(v, p[1]) * p[2] / v, atan2(v, p[1]) * p[3] / v, 0.0] END FROM c
    UNION ALL SELECT event_id, 'half', CASE WHEN v = 0 THEN [1.0, 0.0, 0.0, 0.0] ELSE [cos(atan2(v, p[1]) / 2), sin(atan2(v, p[1]) / 2) * p[2] / v, sin(atan2(v, p[1]) / 2) * p[3] / v, 0.0] END FROM c
    UNION ALL SELECT event_id, 'between', list_transform(range(1, 5), lambda k: (wa * p[k] + wb * r[k]) / sqrt(wa * wa + wb * wb + 2 * wa * wb * dot)) FROM (SELECT *, CASE WHEN abs(dot) > 0.9995 THEN 0.75 ELSE sin(0.75 * acos(abs(dot))) / sin(acos(abs(dot))) END AS wa, CASE WHEN dot < 0 THEN -1 ELSE 1 END * CASE WHEN abs(dot) > 0.9995 THEN 0.25 ELSE sin(0.25 * acos(abs(dot))) / sin(acos(abs(dot))) END AS wb FROM c)
    UNION ALL SELECT event_id, 'axis_angle', CASE WHEN v = 0 THEN [1.0, 0.0, 0.0, 2 * atan2(v, p[1])] WHEN p[2] < 0 THEN [-p[2] / v, -p[3] / v, 0.0, -2 * atan2(v, p[1])] ELSE [p[2] / v, p[3] / v, 0.0, 2 * atan2(v, p[1])] END FROM c
    UNION ALL SELECT event_id, 'rodrigues', [tan(h / 2) * 0.6, tan(h / 2) * 0.8, 0.0] FROM c UNION ALL SELECT event_id, 'canonical', CASE WHEN p[1] < 0 THEN list_transform(p, lambda x: -x) ELSE p END FROM c),
  u AS (SELECT event_id, form, x AS v FROM f) {_exploded_sql('u', 'event_id', 'form')}"""


@query(ALGEBRA_SQL)
def quaternion_algebra(t):
    """Inverse, logarithm, power, interpolation, axis-angle and Rodrigues forms of every pose."""
    named = {"inverse": q.inverse("p"), "log": q.logarithm("p"), "half": q.power("p", 0.5), "between": q.slerp("p", "r", F.lit(0.25)), "axis_angle": q.axis_angle("p"), "rodrigues": q.rodrigues("p", True), "canonical": q.equivalent("p")}
    forms = _quats(t).select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), v.alias("v")) for n, v in named.items()])).alias("f")).select("event_id", "f.*")
    return _exploded(forms, "v", "event_id", "form")


AXIS_ORDERS = [a + b + c for a in "XYZ" for b in "XYZ" for c in "XYZ" if a != b != c]


def _euler_sql(order: str) -> str:
    """Angles of an axis order out of the rotation matrix m (row by row)."""
    i, j, k = ("XYZ".index(a) for a in order)
    m = lambda a, b: f"m[{3 * a + b + 1}]"
    if i == k:
        k = 3 - i - j
        e = (i - j) * (j - k) * (k - i) // 2
        return f"[atan2({m(j, i)}, {-e} * {m(k, i)}), acos(greatest(-1.0, least(1.0, {m(i, i)}))), atan2({m(i, j)}, {e} * {m(i, k)})]"
    e = (i - j) * (j - k) * (k - i) // 2
    return f"[atan2({-e} * {m(j, k)}, {m(k, k)}), asin(greatest(-1.0, least(1.0, {e} * {m(i, k)}))), atan2({-e} * {m(i, j)}, {m(i, i)})]"


EULER_SQL = f"""WITH {QUAT_SQL}, t AS (SELECT event_id, a + 0.5 AS a FROM a), m AS (SELECT event_id, [cos(a) + 0.36 * (1 - cos(a)), 0.48 * (1 - cos(a)), 0.8 * sin(a), 0.48 * (1 - cos(a)), cos(a) + 0.64 * (1 - cos(a)), -0.6 * sin(a), -0.8 * sin(a), 0.6 * sin(a), cos(a)] AS m FROM t)
  {' UNION ALL '.join(f"SELECT event_id, '{o.lower()}' AS axes, round(e[1], 5) + 0.0 AS first, round(e[2], 5) + 0.0 AS second, round(e[3], 5) + 0.0 AS third FROM (SELECT event_id, {_euler_sql(o)} AS e FROM m)" for o in AXIS_ORDERS)}"""


@query(EULER_SQL)
def euler_orders(t):
    """Angles of every pose, turned on by half a radian about its axis, in all twelve axis orders."""
    h = (F.radians("value") + 0.5) / 2
    rows = t("events").select("event_id", q.quat(F.cos(h), F.sin(h) * 0.6, F.sin(h) * 0.8, F.lit(0.0)).alias("p"))
    each = F.explode(F.array(*[F.struct(F.lit(o.lower()).alias("axes"), q.to_euler(o, "p").alias("e")) for o in AXIS_ORDERS])).alias("o")
    return rows.select("event_id", each).select("event_id", "o.axes", *[(r(F.col("o.e")[i], 5) + 0.0).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"""WITH d AS (SELECT event_id, radians(value - lag(value) OVER w) AS turn, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000.0 AS hours FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT event_id, hours, turn - 2 * pi() * round(turn / (2 * pi())) AS turn FROM d) SELECT event_id, round(0.6 * turn / nullif(hours, 0), 4) + 0.0 AS x, round(0.8 * turn / nullif(hours, 0), 4) + 0.0 AS y, CASE WHEN turn / nullif(hours, 0) IS NOT NULL THEN 0.0 END AS z FROM s""")
def angular_rates(t):
    rows = _quats(t).join(_events(t).select("event_id", "at"), "event_id")
    rates = kinematics.angular_rates(rows, ["user_id"], "at", "p", ties=["event_id"], unit=3_600_000_000.0)
    return rates.select("event_id", *[(r(F.col("rate")[i], 4) + 0.0).alias(c) for i, c in enumerate("xyz")])


@query(f"""WITH {HALVES_SQL}, {_topk_sql('head', 1, 'near')} SELECT query_id, id, distance FROM near""")
def nearest_pair_subset(t):
    """The nearest row of each query out of all pairs of half vectors."""
    h = _halves(t)
    few = blocks.distances(_asked(h, F.col("head").alias("query_vec")), h.select("id", F.col("head").alias("vec")), "cosine", 1, 9)  # all that can be the nearest
    return ranking.pair_subset(few, "nearest")


def _subset_sql(where: str = "true", order: str | None = None, most: int = 1) -> str:
    chosen = f" QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) <= {most}" if order else ""
    return f"""WITH p AS (SELECT c_custkey AS id, [c_acctbal / 1000, c_nationkey::DOUBLE, (c_custkey % 17)::DOUBLE] AS v FROM customer),
  d AS (SELECT a.id AS query_id, b.id, round(list_distance(a.v, b.v), 6) AS distance FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 50 = 0) SELECT query_id, id, distance FROM d WHERE {where}{chosen}"""


def _subset(t, subset: str, limit=None):
    points = t("customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 17).cast("double")).alias("vec"))
    return proximity.pairs_of_points(_asked(points, F.col("vec").alias("query_vec")), points, subset, limit, digits=6)


@query(_subset_sql())
def point_pairs_all(t):
    return _subset(t, "all")


@query(_subset_sql("distance >= 20"))
def point_pairs_minimum(t):
    return _subset(t, "minimum", 20)


@query(_subset_sql("distance <= 3"))
def point_pairs_maximum(t):
    return _subset(t, "maximum", 3)


@query(_subset_sql(order="distance", most=6))
def point_pairs_smallest(t):
    return _subset(t, "smallest", 6)


@query(_subset_sql(order="distance DESC", most=6))
def point_pairs_largest(t):
    return _subset(t, "largest", 6)


@query(_subset_sql(order="distance"))
def point_pairs_nearest(t):
    return _subset(t, "nearest")


@query(_subset_sql(order="distance DESC"))
def point_pairs_farthest(t):
    return _subset(t, "farthest")


@query(recurrences.POSES)
def poses_in_robot_frame(t):
    rows = _quats(t).join(t("events").select("event_id", F.to_date("ts").alias("recording_date")), "event_id")
    poses = rows.select("event_id", "recording_date", F.array("value", F.lit(10.0), F.lit(-5.0)).alias("position"), F.col("p").alias("orientation"))
    days = poses.groupBy(F.trunc("recording_date", "month").alias("valid_from")).count()
    shift = F.dayofyear("valid_from").cast("double")
    one = lambda x: F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0)], x, *[F.lit(v) for v in (0.0, 0.0, -1.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0)])
    matrices = days.select("valid_from", one(shift).alias("offset"), one(-shift).alias("instrument_to_robot"))
    out = accuracy.in_robot_frame(poses, matrices)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("v")) for c in ("position", "orientation", "angles")])).alias("e")
    return _exploded(out.select("event_id", each).select("event_id", "e.*"), "v", "event_id", "part", digits=4)


@query(recurrences.CALIBRATION)
def calibration_fit(t):
    """Fit of the transform between points and their turned, shifted and disturbed copies, by event type, and what it leaves."""
    p = F.array("value", (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 7).cast("double"))
    rows = t("events").select("event_type", p.alias("p"))
    turn = F.array(*[F.lit(v) for v in (0.36, -0.8, 0.48, 0.48, 0.6, 0.64, -0.8, 0.0, 0.6)])
    moved = calibration.transformed("p", turn, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    rows = rows.withColumn("m", F.zip_with(moved, F.array(F.col("p")[1] % 13 / 10, F.col("p")[1] % 11 / 10, F.col("p")[1] % 9 / 10), lambda x, y: x + y))
    e = calibration.calibration_errors(rows, ["event_type"], "p", "m")
    return e.select("event_type", "n", r("mean_error").alias("mean_error"), r("max_error").alias("max_error"), r("rms_error").alias("rms_error"))


@query(f"""WITH {QUAT_SQL}, s AS (SELECT user_id, sum(cos(a / 2) * cos(a / 2)) AS cc, sum(cos(a / 2) * sin(a / 2)) AS cs, sum(sin(a / 2) * sin(a / 2)) AS ss, avg(cos(a / 2)) AS c, avg(sin(a / 2)) AS s FROM q GROUP BY 1),
  g AS (SELECT user_id, atan2(2 * cs, cc - ss) / 2 AS e, atan2(s, c) AS m FROM s), u AS (SELECT user_id, 'eigen' AS method, [cos(e), sin(e) * 0.6, sin(e) * 0.8, 0.0] AS v FROM g UNION ALL SELECT user_id, 'arithmetic', [cos(m), sin(m) * 0.6, sin(m) * 0.8, 0.0] FROM g)
  {_exploded_sql('u', 'user_id', 'method')}""")
def mean_orientations(t):
    """All orientations turn about one axis, so SQL can say the eigenvector, too."""
    each = [calibration.mean_orientations(_quats(t), ["user_id"], "p", m).select("user_id", F.lit(m).alias("method"), "p") for m in ("eigen", "arithmetic")]
    return _exploded(each[0].unionByName(each[1]), "p", "user_id", "method")


@query("""WITH x AS (SELECT event_id, user_id, value * 3.6 - 180 AS a FROM events), m AS (SELECT user_id, max((abs(abs(a) - 180) < 5)::INT) AS near FROM x GROUP BY 1)
  SELECT event_id, round(CASE WHEN near = 1 AND a < 0 THEN a + 360 ELSE a END, 6) AS angle FROM x JOIN m USING (user_id)""")
def unwrap_near_half_turn(t):
    e = t("events").select("event_id", "user_id", (F.col("value") * 3.6 - 180).alias("angle"))
    return calibration.unwrap_near_half_turn(e, ["user_id"], ["angle"]).select("event_id", r("angle").alias("angle"))


@query("""WITH p AS (SELECT user_id, value AS x, (event_id % 100)::DOUBLE AS y FROM events), m AS (SELECT user_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p GROUP BY 1)
  SELECT user_id, round(avg(x), 10) AS x, round(avg(y), 10) AS y, count(*) AS n FROM p JOIN m USING (user_id) WHERE abs(x - mx) <= 2 * sx + 1e-12 AND abs(y - my) <= 2 * sy + 1e-12 GROUP BY 1""")
def rest_point_means(t):
    rows = t("events").select("user_id", F.array("value", (F.col("event_id") % 100).cast("double"), F.lit(0.0)).alias("v"))
    m = calibration.rest_points(rows, ["user_id"], "v")
    return m.select("user_id", r(F.col("v")[0], 10).alias("x"), r(F.col("v")[1], 10).alias("y"), "n")


# --- further geometry, interpolation and result handling -----------------------------------------------------------


@query("""WITH e AS (SELECT event_id, [value, (event_id % 100)::DOUBLE] AS p, lag([value, (event_id % 100)::DOUBLE]) OVER w AS b, lag([value, (event_id % 100)::DOUBLE], 2) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  t AS (SELECT *, coalesce(((p[1] - a[1]) * (b[1] - a[1]) + (p[2] - a[2]) * (b[2] - a[2])) / nullif(pow(b[1] - a[1], 2) + pow(b[2] - a[2], 2), 0), 0) AS t FROM e WHERE a IS NOT NULL)
  SELECT event_id, round(t, 6) + 0.0 AS share, CASE WHEN t BETWEEN 0 AND 1 THEN round(sqrt(pow(p[1] - a[1] - t * (b[1] - a[1]), 2) + pow(p[2] - a[2] - t * (b[2] - a[2]), 2)), 6) ELSE 'infinity'::DOUBLE END AS distance FROM t""")
def edge_projection(t):
    """Each point against the edge of the two points before it."""
    e, w = t("events").withColumn("p", F.array("value", (F.col("event_id") % 100).cast("double"))), _w()
    rows = e.select("event_id", "p", F.lag("p", 2).over(w).alias("a"), F.lag("p").over(w).alias("b")).where("a is not null")
    rows = rows.withColumn("e", vectors.edge_projection("p", "a", "b"))
    return rows.select("event_id", (r("e.share") + 0.0).alias("share"), r("e.distance").alias("distance"))


@query(f"""WITH {QUAT_SQL}, m AS (SELECT event_id, a + 0.5 AS a FROM a), r AS (SELECT event_id, [cos(a) + 0.36 * (1 - cos(a)), 0.48 * (1 - cos(a)), 0.8 * sin(a), 0.48 * (1 - cos(a)), cos(a) + 0.64 * (1 - cos(a)), -0.6 * sin(a), -0.8 * sin(a), 0.6 * sin(a), cos(a)] AS m FROM m),
  e AS (SELECT event_id, {_euler_sql('XYZ')} AS e FROM r), d AS (SELECT event_id, [e[2], -e[1], e[3]] AS h FROM e),
  z AS (SELECT event_id, {recurrences._times(recurrences._times('[cos(h[1] / 2), sin(h[1] / 2), 0.0, 0.0]', '[cos(h[2] / 2), 0.0, sin(h[2] / 2), 0.0]'), '[cos(h[3] / 2), 0.0, 0.0, sin(h[3] / 2)]')} AS z FROM d),
  c AS (SELECT event_id, {recurrences._times('z', '[0.5, 0.5, 0.5, 0.5]')} AS c FROM z), v AS (SELECT event_id, CASE WHEN c[1] + c[2] < 0 THEN list_transform(c, lambda z: -z) ELSE c END AS v FROM c) {_exploded_sql('v', 'event_id')}""")
def turned_by_angles(t):
    """Orientations mapped by their angles (the first two exchanged, one negated), calibrated, and signed like a reference."""
    h = (F.radians("value") + 0.5) / 2
    rows = t("events").select("event_id", q.quat(F.cos(h), F.sin(h) * 0.6, F.sin(h) * 0.8, F.lit(0.0)).alias("p"))
    numbers = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    turned = q.turned_by_angles("p", numbers(0, -1, 0, 1, 0, 0, 0, 0, 1), numbers(0.5, 0.5, 0.5, 0.5), numbers(1, 1, 0, 0))
    return _exploded(rows, turned, "event_id")


@query(f"""WITH e AS (SELECT user_id, row_number() {BY_USER}) AS segment, value AS x0, (event_id % 100)::DOUBLE AS y0, lead(value) {BY_USER}) AS x1, lead((event_id % 100)::DOUBLE) {BY_USER}) AS y1, event_id % 4 + 1 AS n FROM events),
  p AS (SELECT *, unnest(range(n)) AS i FROM e WHERE x1 IS NOT NULL)
  SELECT user_id, segment, i + 1 AS point, round(x0 + CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 1 END * (x1 - x0), 6) AS x, round(y0 + CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 1 END * (y1 - y0), 6) AS y FROM p""")
def nominal_points(t):
    e = t("events").withColumn("x", F.col("value")).withColumn("y", (F.col("event_id") % 100).cast("double"))
    p = series.points_between(e, ["user_id"], ["ts", "event_id"], ["x", "y"], F.col("event_id") % 4 + 1)
    return p.select("user_id", "segment", "point", r("x").alias("x"), r("y").alias("y"))


@query(f"""WITH d AS (SELECT event_id, radians(value - lag(value) {BY_USER})) AS turn, radians(lag(value) {BY_USER})) AS from_ FROM events), m AS (SELECT event_id, turn, from_ + (turn / 2 - pi() * round(turn / 2 / pi())) AS middle FROM d)
  SELECT event_id, round(cos(turn / 2), 6) + 0.0 AS w, round(sin(turn / 2) * 0.6, 6) + 0.0 AS x, round(cos(middle / 2), 6) + 0.0 AS middle_w, round(sin(middle / 2) * 0.6, 6) + 0.0 AS middle_x FROM m WHERE turn IS NOT NULL""")
def orientation_steps(t):
    """The turn since the pose before, and the orientation half-way, by interpolation in time."""
    rows = _quats(t).join(_events(t).select("event_id", "at"), "event_id").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")) * 2)
    turned = kinematics.turns(rows, ["user_id"], ["at", "event_id"], "p")
    wanted = rows.where("place > 2").select("event_id", "user_id", (F.col("place") - 1).alias("place"))
    between = kinematics.interpolated(rows.select("user_id", "place", "p"), wanted, ["user_id"], "place", "p")
    both = between.join(turned.select("event_id", "turn"), "event_id")
    return both.select("event_id", *[(r(F.col(c)[i]) + 0.0).alias(n) for n, c, i in (("w", "turn", 0), ("x", "turn", 1), ("middle_w", "orientation", 0), ("middle_x", "orientation", 1))])


@query(f"""WITH s AS (SELECT event_id, sum(radians(value)) {BY_USER} ROWS UNBOUNDED PRECEDING) / 2 AS h FROM events) SELECT event_id, round(cos(h), 6) + 0.0 AS w, round(sin(h) * 0.6, 6) + 0.0 AS x, round(sin(h) * 0.8, 6) + 0.0 AS y, 0.0 AS z FROM s""")
def cumulative_turns(t):
    rows = _quats(t).select("event_id", "user_id", "p").join(_events(t).select("event_id", F.struct("at", "event_id").alias("o")), "event_id")
    rows = rows.withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("o")))
    total = kinematics.cumulative_product(rows, ["user_id"], "o", "p")
    return total.select("event_id", *[(r(F.col("product")[i]) + 0.0).alias(c) for i, c in enumerate("wxyz")])


@query("""WITH s AS (SELECT event_id, sum(radians(value)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 2 AS h FROM events) SELECT event_id, round(cos(h), 5) + 0.0 AS w, round(sin(h) * 0.6, 5) + 0.0 AS x, round(sin(h) * 0.8, 5) + 0.0 AS y FROM s""")
def cumulative_turns_of_long_series(t):
    """Products of the turns of each event type, a fifth of all events, by block scans."""
    rows = _quats(t).select("event_id", "p").join(t("events").select("event_id", "event_type", "ts"), "event_id")
    total = dealt.cumulative_product(rows, ["event_type"], ["ts", "event_id"], "p")
    return total.select("event_id", *[(r(F.col("product")[i], 5) + 0.0).alias(c) for i, c in enumerate("wxy")])


@query(f"""WITH d AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) {BY_USER})) / 3600000000.0 AS hours, value / 100 AS rate, user_id, ts FROM events), s AS (SELECT event_id, sum(coalesce(hours, 0) * rate) {BY_USER} ROWS UNBOUNDED PRECEDING) / 2 AS h FROM d)
  SELECT event_id, round(cos(h), 5) + 0.0 AS w, round(sin(h), 5) + 0.0 AS z FROM s""")
def integrated_rates(t):
    """Orientations that a rate about the z axis leads to (events of a user have distinct times)."""
    e = _events(t).select("event_id", "user_id", (F.col("at") / 3_600_000_000.0).alias("hours"), F.array(F.lit(0.0), F.lit(0.0), F.col("value") / 100).alias("rate"))
    out = kinematics.integrated(e, ["user_id"], "hours", "rate")
    return out.select("event_id", (r(F.col("orientation")[0], 5) + 0.0).alias("w"), (r(F.col("orientation")[3], 5) + 0.0).alias("z"))


@query("""WITH d AS (SELECT user_id, row_number() OVER w AS n, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0 AS t FROM (SELECT DISTINCT user_id, ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  a AS (SELECT user_id, n, (0.1 * t + 0.02 * t * t / 2 - 0.003 * t * t * t / 3 + 0.0001 * t * t * t * t / 4) / 2 AS h FROM d) SELECT user_id, n, round(cos(h), 5) + 0.0 AS w, round(sin(h) * 0.6, 5) + 0.0 AS x, round(sin(h) * 0.8, 5) + 0.0 AS z FROM a""")
def integrated_by_spline(t):
    """Orientations that a rate about a fixed axis leads to, which is a cubic of the time and sampled at a user's events."""
    first = F.min("at").over(Window.partitionBy("user_id"))
    e = _events(t).withColumn("days", (F.col("at") - first) / 86_400_000_000.0)
    d = F.col("days")
    rate = 0.1 + 0.02 * d - 0.003 * d * d + 0.0001 * d * d * d
    out = kinematics.integrated_by_spline(e.select("user_id", "days", F.array(rate * 0.6, F.lit(0.0), rate * 0.8).alias("rate")), ["user_id"], "days", "rate")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("days")).cast("long")
    o = F.col("orientation")
    return out.select("user_id", n.alias("n"), *[(r(o[i], 5) + 0.0).alias(c) for i, c in ((0, "w"), (1, "x"), (3, "z"))])


@query(recurrences.TOP)
def propagated_top(t):
    """Orientation and rate of a free symmetric top for every event, at three times."""
    i = F.col("event_id")
    rates = F.array((i % 7) / 10.0, (i % 5) / 10.0, (i % 11) / 10.0 - 0.5)
    times = F.when(i % 40 == 0, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(*[F.lit(f) * (i % 40) / 8 for f in (0.0, 0.5, 1.0)]))
    rows = _quats(t).withColumn("rate", rates).withColumn("moments", F.array(F.lit(2.0), F.lit(2.0), F.lit(3.0))).withColumn("times", times)
    out = kinematics.propagated(rows, "p", "rate", "moments", "times", relative=1e-11).select("event_id", F.explode("motion").alias("m"))
    each = [(r(F.col("m.orientation")[k], 4) + 0.0).alias(c) for k, c in enumerate("wxyz")] + [(r(F.col("m.rate")[k], 4) + 0.0).alias(f"w{c}") for k, c in enumerate("xyz")]
    return out.select("event_id", r("m.t").alias("t"), *each)


@query(f"""WITH {QUAT_SQL}, m AS (SELECT event_id, value, [cos(a), -sin(a), 0.0, sin(a), cos(a), 0.0, 0.0, 0.0, 1.0] AS m, b FROM (SELECT a.event_id, e.value, a.b AS a, a.b FROM a JOIN events e USING (event_id)))
  SELECT event_id, round(m[1] * m[1] * 2 + m[2] * m[2] * 3, 6) + 0.0 AS xx, round(m[1] * m[4] * 2 + m[2] * m[5] * 3, 6) + 0.0 AS xy, round(m[4] * m[4] * 2 + m[5] * m[5] * 3, 6) + 0.0 AS yy, round(cos(b / 2), 6) + 0.0 AS re, round(sin(b / 2), 6) + 0.0 AS im, round(cos(b / 2), 6) + 0.0 AS back FROM m""")
def tensors_and_complex_matrices(t):
    """A tensor turned about z, entries of the complex matrix of the turn, and its real part when read back."""
    rows = _quats(t).withColumn("c", q.complex_matrix("r")).withColumn("t", q.rotate_tensor("r", F.array(*[F.lit(float(x)) for x in (2, 0, 0, 0, 3, 0, 0, 0, 5)])))
    return rows.select("event_id", *[(r(F.col("t")[i]) + 0.0).alias(n) for i, n in ((0, "xx"), (1, "xy"), (4, "yy"))], (r(F.col("c")[0]) + 0.0).alias("re"), (r(F.col("c")[3]) + 0.0).alias("im"), (r(q.from_complex_matrix("c")[0]) + 0.0).alias("back"))


@query(recurrences.DTW.replace("'ok' AS status", "round(tx[i + 1], 6) AS nominal_at, round(ty[j + 1], 6) AS measured_at").replace("round(avg(d[i + 1][j + 1]) OVER u, 6) AS value, ", "")
  .replace("JOIN (SELECT user_id, xs, ys FROM xy)", f"JOIN (SELECT a.user_id, a.t AS tx, b.t AS ty FROM (SELECT user_id, event_id % 2 AS side, list({HOUR_SQL} * 2 ORDER BY ts, event_id) AS t FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_id % 2 AS side, list({HOUR_SQL} * 2 ORDER BY ts, event_id) AS t FROM events GROUP BY ALL) b ON a.user_id = b.user_id AND a.side = 0 AND b.side = 1) USING (user_id) JOIN (SELECT user_id, xs, ys FROM xy)"))
def dtw_with_time(t):
    """DTW on three coordinates with a fourth, a time, that comes along."""
    def timed(rest):
        e = t("events").where(F.col("event_id") % 2 == rest).withColumn("hour", hour()).withColumn("z", (F.col("event_id") % 100).cast("double")).withColumn("when", F.col("hour") * 2)
        return tables.points(e, "user_id", "event_type", ["ts", "event_id"], ["value", "hour", "z", "when"])

    d = alignment.align(timed(0), timed(1), "dtw", 3, carried=1)
    return d.select("traj_id", "seg_id", "points_order", r("distance").alias("distance"), r(F.col("nominal")[3]).alias("nominal_at"), r(F.col("measured")[3]).alias("measured_at"))


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'o' AND contains(lower(o_orderpriority), 'high') AND o_orderkey % 10 IN (1, 3, 7) AND o_orderkey % 7 = o_custkey % 7 AND starts_with(lower(o_orderpriority), '2')")
def result_filters(t):
    o = t("orders").withColumn("last", F.col("o_orderkey") % 10).withColumn("a", F.col("o_orderkey") % 7).withColumn("b", F.col("o_custkey") % 7)
    return joins.selected(o, equals={"o_orderstatus": "o"}, contains={"o_orderpriority": "HIGH"}, starts={"o_orderpriority": "2"}, among={"last": [1, 3, 7]}, same=[("a", "b")]).select("o_orderkey")


@query("""WITH s AS (SELECT c_custkey AS traj, c_nationkey AS g, c_custkey || '_' || k AS seg, k AS number FROM customer, (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR c_custkey % 3 = 0)
  SELECT a.seg AS query, a.number, string_agg(b.seg, ',' ORDER BY b.seg) AS matches FROM s a JOIN s b ON a.g = b.g AND a.number = b.number AND a.traj <> b.traj WHERE a.traj % 50 = 0 GROUP BY ALL""")
def same_group_by_number(t):
    c = t("customer").select(F.col("c_custkey").alias("traj"), F.col("c_nationkey").alias("g"), F.explode(F.array(F.lit(1), F.lit(2))).alias("number")).where("number = 1 or traj % 3 = 0")
    c = c.withColumn("seg", F.concat_ws("_", "traj", "number"))
    return joins.same_group_by_number(c.where("traj % 50 = 0"), c, "g", "traj", "seg", "number")


@query("""WITH m AS (SELECT o_orderpriority AS mode, o_custkey AS label, round(sum(o_totalprice), 4) AS score FROM orders GROUP BY ALL)
  SELECT mode, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, label) AS rank FROM m) WHERE rank <= 5""")
def top_labels(t):
    sums = t("orders").groupBy(F.col("o_orderpriority").alias("mode"), F.col("o_custkey").alias("label")).agg(r(F.sum("o_totalprice"), 4).alias("total"))
    return summary.top_labels(sums, ["mode"], F.col("total"), "label", 5)


@query("""WITH x AS (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'infinity'::DOUBLE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)
  SELECT event_type, round(avg(v) FILTER (v IS NOT NULL AND isfinite(v)), 6) AS v, count(*) FILTER (v IS NOT NULL AND isfinite(v)) AS n_v FROM x GROUP BY 1""")
def finite_means(t):
    i = F.col("event_id")
    v = F.when(i % 5 == 0, F.lit(float("inf"))).when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return summary.finite_means(t("events").select("event_type", v.alias("v")), ["event_type"], ["v"]).select("event_type", r("v").alias("v"), "n_v")


@query("""SELECT c_custkey, 'both' AS part FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'idle' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_operations(t):
    ids, o = t("customer").select("c_custkey"), t("orders")
    both = ids.intersect(o.select(F.col("o_custkey").alias("c_custkey"))).withColumn("part", F.lit("both"))
    return both.unionByName(ids.subtract(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))).withColumn("part", F.lit("idle")))


@query(f"WITH {FUSED_SQL} SELECT query_id, fused.id, rrf_score, fused.rank, label, CASE WHEN ra.id IS NOT NULL THEN ra.distance ELSE rb.distance END AS distance FROM fused JOIN (SELECT id, label FROM v) USING (id) LEFT JOIN ra USING (query_id, id) LEFT JOIN rb USING (query_id, id)")
def rrf_with_metadata(t):
    """Fusion with the label and the distance of the first modality that lists a row."""
    rows = _rankings(t).join(_vectors(t).select("id", "label"), "id")
    fused = ranking.reciprocal_rank_fusion(rows, carry=["label", "distance"], first="head")
    scored = fused.select("query_id", "id", r("rrf_score", 12).alias("rrf_score"), "label", "distance")
    return ranking.rank_by(scored, ["query_id"], [F.desc("rrf_score"), "id"])


@query(f"""WITH {HALVES_SQL}, {_topk_sql('vec', 30, 'top')}, {TRUTH_SQL}, m AS (SELECT query_id, max(distance) AS far FROM top GROUP BY 1)
  SELECT truth.query_id, truth.id, coalesce(round(1 / (1 + distance / far), 6), 0) AS relevance FROM truth LEFT JOIN top USING (query_id, id) LEFT JOIN m USING (query_id)""")
def relevance_of_truths(t):
    """Truths outside of the first thirty count as not found."""
    found = ranking.relevance_of_groups(*_labels(t), _full(t, 30), "distance")
    return found.select("query_id", "id", r("relevance").alias("relevance"))


@query("""WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT CASE WHEN user_id % 50 = 0 THEN 'queries' ELSE 'candidates' END AS part, user_id::VARCHAR AS id, n FROM g UNION ALL SELECT CASE WHEN user_id % 50 = 0 THEN 'query segments' ELSE 'candidate segments' END, user_id || '/' || event_type, n FROM s""")
def experiment_preload(t):
    e = t("events")
    points = _points(t)
    meta = e.select(F.col("user_id").alias("traj_id"), F.col("user_id").cast("string").alias("seg_id")).union(e.select("user_id", "event_type")).groupBy("traj_id", "seg_id").agg(F.count("*").alias("rows"))
    data = search.experiment_data(points, meta, e.where("user_id % 50 = 0").select("user_id"))
    out = None
    for part in ("queries", "candidates"):
        df = data[part].select(F.lit(part).alias("part"), F.col("traj_id").cast("string").alias("id"), "n")
        out = df if out is None else out.unionByName(df)
    parts = data["segments"].select(F.when(F.col("is_query"), F.lit("query segments")).otherwise(F.lit("candidate segments")).alias("part"), F.concat_ws("/", "traj_id", "seg_id").alias("id"), "n")
    return out.unionByName(parts)


@query(f"""WITH {recurrences.PAIRS.split('pairs AS')[0]} pairs AS (SELECT id AS query_id, id, list_transform(range(40), lambda i: [i, i, i]::DOUBLE[]) AS a, seq AS b, 40 AS n, len(seq) AS m FROM seqs), {recurrences.PCHIP}
  SELECT id AS user_id, t + 1 AS k, round(max(v) FILTER (dim = 1), 6) AS x, round(max(v) FILTER (dim = 2), 6) AS y, round(max(v) FILTER (dim = 3), 6) AS z FROM both_ GROUP BY ALL""")
def resample_shape_preserving(t):
    rows = alignment.resampled_sequences(_seqs(t), "seq", 40).select("user_id", F.posexplode("resampled").alias("i", "p"))
    return rows.select("user_id", (F.col("i") + 1).cast("long").alias("k"), *[r(F.col("p")[i]).alias(c) for i, c in enumerate("xyz")])


@query("SELECT vec_id, '{' || array_to_string(list_transform(embedding[1:64], lambda x: (round(x * 1000))::BIGINT::VARCHAR), ',') || '}' AS literal FROM embeddings")
def array_literals(t):
    rows = t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(1000.0).cast("float")).cast("long")).alias("v"))  # a product of floats, as in SQL
    return rows.select("vec_id", vectors.array_literal("v").alias("literal"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-modality search with rank fusion."""
    return QUERIES["rrf_fusion"](spark, sf_dir)
