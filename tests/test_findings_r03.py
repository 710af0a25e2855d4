"""What the third round of findings showed, in small."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import kernels, vectors
from tracewright.operators import alignment, blocks, joins, kinematics, proximity, ranking, sequence_blocks
from tracewright.plans import queries


def test_no_window_of_a_nearest_join_ends_with_its_group(spark):
    """A frame up to the end of its group costs the square of the group's rows."""
    left = spark.createDataFrame([(i, 3 * i % 50) for i in range(40)], "id long, at long")
    right = spark.createDataFrame([(i, i * i % 70) for i in range(30)], "other long, m long")
    for spread in (False, True):
        near = joins.nearest(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), "at", "m", ["g"], ["other"], spread=spread)
        assert "unboundedfollowing" not in near._jdf.queryExecution().optimizedPlan().toString().lower()
        times = sorted({i * i % 70 for i in range(30)})
        for r in near.collect():
            best = min(times, key=lambda m: (abs(m - r["at"]), m))
            assert r.other * r.other % 70 == best


def _turn(degrees: float) -> list[float]:
    h = math.radians(degrees) / 2
    return [math.cos(h), math.sin(h) * 0.6, math.sin(h) * 0.8, 0.0]


@pytest.mark.parametrize("start", [0.0, 0.01, 33.33, 77.7])
def test_half_turns_are_decided_by_rule_and_not_by_a_last_bit(spark, start):
    rows = spark.createDataFrame([(1, 0, _turn(start)), (1, 2, _turn(start + 180.0))], "k long, at long, q array<double>")
    out = kinematics.interpolated(rows, spark.createDataFrame([(1, 1)], "k long, at long"), ["k"], "at", "q").first().orientation
    assert out == pytest.approx(_turn(start - 90.0), abs=1e-9)


def test_rates_keep_whole_ticks_and_half_turns_and_order_ties(spark):
    at = 1_706_000_000_000_000
    rows = spark.createDataFrame([(1, 1, at, _turn(10.0)), (1, 3, at + 7, _turn(50.0)), (1, 2, at + 7, _turn(20.0)), (1, 4, at + 3_600_000_007, _turn(230.0))], "k long, id long, at long, q array<double>")
    rates = {r.id: r.rate for r in kinematics.angular_rates(rows, ["k"], "at", "q", ties=["id"], unit=3_600_000_000.0).collect()}
    assert rates[1] is None and rates[3] is None  # the first, and one without time since the row before
    assert rates[2][0] == pytest.approx(0.6 * math.radians(10.0) / (7 / 3.6e9), rel=1e-12)
    assert rates[4] == pytest.approx([-0.6 * math.pi, -0.8 * math.pi, 0.0], abs=1e-9)


def test_array_literals_multiply_floats(spark, tmp_path):
    spark.createDataFrame([(1, [0.3195, -0.3195, 0.25, None])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["array_literals"](spark, str(tmp_path)).first().literal == "{320,-320,250,NULL}"


def test_orientations_of_the_queries_are_those_of_the_c_library(spark, tmp_path):
    """A step of exactly 1.5 degrees is a jump or none by the last bit, so it has to be that of the SQL."""
    import datetime

    stamp, values = datetime.datetime(2024, 1, 1), [round(i * 0.01, 2) for i in range(9000)]
    spark.createDataFrame([(2 * i, stamp, 1, "click", v) for i, v in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = queries._orientations(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"), 0).orderBy("ord").collect()
    halves = [math.radians(v) / 2 for v in values]
    assert [r.v for r in rows] == [[math.cos(h), math.sin(h) * 0.6, math.sin(h) * 0.8, 0.0] for h in halves]


def _brute(q, r, measure, k, digits, parents=None):
    out = []
    for i, x in q:
        each = []
        for j, y in r:
            if i == j or parents and parents[i] == parents[j]:
                continue
            s = lambda terms: functools.reduce(lambda a, b: a + b, terms, 0.0)
            size = lambda v: math.sqrt(s([c * c for c in v]))
            d = 1 - s([a * b for a, b in zip(x, y)]) / (size(x) * size(y) + 1e-10) if measure == "cosine" else math.sqrt(s([(a - b) * (a - b) for a, b in zip(x, y)]))
            each.append((round(d, digits), j))
        out += [(i, j, d) for d, j in (sorted(each)[:k] if k else each)]
    return sorted(out)


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
@pytest.mark.parametrize("k", [3, 40, None])
def test_blocks_find_what_all_pairs_hold(spark, monkeypatch, measure, k):
    """Few rows a block and a product, many equal vectors, a vector of no length, and rows barred by their parent."""
    monkeypatch.setattr(blocks, "QUERY_BYTES", 600)
    monkeypatch.setattr(blocks, "ROW_BYTES", 6000)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(260, 4)), 1)
    v[:60], v[77] = v[0], 0.0
    rows = [(i, x.tolist(), i % 7) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, [1.0, None, 2.0, 3.0], 1)], "id long, vec array<double>, parent int")
    asked = df.where("id % 20 in (0, 17)").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("parent").alias("query_parent"))
    found = blocks.distances(asked, df, measure, k, 6, ("parent", "query_parent"))
    if k:
        found = ranking.top_k(found, ["query_id"], ["distance", "id"], k)
    got = sorted((r.query_id, r.id, r.distance) for r in found.collect())
    want = _brute([(i, x) for i, x, _ in rows if i % 20 in (0, 17)], [(i, x) for i, x, _ in rows], measure, k, 6, [i % 7 for i in range(260)])
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1.1e-6)


def test_blocks_keep_configurations_apart(spark):
    rows = spark.createDataFrame([(c, i, [float(i % 5), float(i % 3 + (c == "b"))]) for c in "ab" for i in range(40)], "config string, id long, vec array<double>")
    asked = rows.where("id = 7").select("config", F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    got = sorted((r.config, r.id) for r in ranking.top_k(blocks.distances(asked, rows, "euclidean", 2, 6, same=["config"]), ["config", "query_id"], ["distance", "id"], 2).collect())
    assert got == [("a", 22), ("a", 37), ("b", 22), ("b", 37)]


def test_all_distances_in_blocks_equal_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROW_BYTES", 2000)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 6)) * 3)], "id long, vec array<double>")
    asked = rows.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    each = {"euclidean": vectors.euclidean, "manhattan": vectors.manhattan, "chebyshev": vectors.chebyshev, "smallest": vectors.smallest_difference, "angular": vectors.angular}
    want = sorted(map(tuple, asked.crossJoin(rows).select("query_id", "id", *[f("query_vec", "vec") for f in each.values()]).collect()))
    got = sorted(map(tuple, blocks.all_distances(asked, rows, list(each)).collect()))
    assert len(got) == 270 and got == want


@pytest.mark.parametrize("subset,limit", [("all", None), ("minimum", 1.0)])
def test_subsets_that_hold_most_pairs_are_not_shuffled(spark, subset, limit):
    points = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(200)] + [(901, [1.0])], "id long, vec array<double>")
    out = proximity.pairs_of_points(points.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), points, subset, limit, 6)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.id) for r in out.where("id < 900").collect()} == {(a, b) for a in range(0, 200, 50) for b in range(200) if a != b}


MEASURES = [("constrained_dtw", {"window": 0.2}), ("kim_bound", {}), ("keogh_bound", {"window": 0.15}), ("resampled_distance", {}), ("moved_bound", {"dims": 2}), ("bound_as_is", {})]


def _sequences(spark, count: int = 46):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=(int(rng.integers(1, 9)), 3)) * 5).tolist()) for i in range(count)]
    return spark.createDataFrame([*rows, (900, None), (910, [])], "id long, seq array<array<double>>")


@pytest.mark.parametrize("measure,options", MEASURES)
def test_sequences_in_blocks_equal_pairs_one_by_one(spark, monkeypatch, measure, options):
    """All pairs in several blocks, and listed pairs in blocks, against a kernel call a pair."""
    for name, value in (("QUERIES", 3), ("ROWS", 17), ("LEAST_PAIRS", 10)):
        monkeypatch.setattr(sequence_blocks, name, value)
    s = _sequences(spark)
    asked = s.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq"))
    pairs = asked.crossJoin(s).where("id <> query_id")
    want = {(r.query_id, r.id): r.distance for r in alignment.pair_distances(pairs, "query_seq", "seq", measure, **options).collect()}
    got = {(r.query_id, r.id): r.distance for r in sequence_blocks.all_pairs(asked, s, measure, **options).collect()}
    few = pairs.select("query_id", "id", F.lit("x").alias("note")).unionByName(spark.createDataFrame([(0, 12345, "x")], "query_id long, id long, note string"))
    queries_of = s.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq"))
    monkeypatch.setattr(sequence_blocks, "pair_distances", None)  # blocks, and nothing else
    listed = {(r.query_id, r.id): r.distance for r in sequence_blocks.listed(few, s, queries_of, measure, **options).collect() if r.note == "x"}
    assert len(want) == len(got) and want.keys() == got.keys() == listed.keys()
    for k, v in want.items():
        for found in (got[k], listed[k]):
            assert (v is None) == (found is None) and (v is None or found == pytest.approx(v, rel=1e-12, abs=1e-12))


def test_pairs_of_sequences_keep_to_their_limits(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(5, 40, 3)), rng.normal(size=(9, 44, 3))
    i, j = (x.ravel() for x in np.indices((5, 9)))
    plain = np.array([kernels.constrained_dtw(a[p], b[q]) for p, q in zip(i, j)])
    limits = plain * np.resize([0.5, 1.0, 2.0], len(i))
    got = kernels.of_pairs("constrained_dtw", a, b, i, j, best=limits)
    assert np.array_equal(got[plain <= limits], plain[plain <= limits]) and (got[plain > limits] > limits[plain > limits]).all()
    assert np.isinf(got[plain > limits]).any()


def test_queries_of_all_pairs_hand_no_sequences_to_pairs(spark, sf):
    for name in ("cdtw", "kim_bound", "kim_bound_sequences", "keogh_bound", "resampled_distance"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("variant", ["scaled", "plain", "min_max"])
def test_telling_distances_give_the_ndcg_of_all(spark, variant):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(120, 5))
    v[:30] = v[0]  # many equal distances
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = ranking.cosine_top_k(*(d.select(c, F.slice(n, 1, 2).alias(n)) for d, c, n in ((asked, "query_id", "query_vec"), (rows, "id", "vec"))), 10, 9)
    score = lambda distances: {x.query_id: x.ndcg for x in ranking.ndcg(found, "relevance", 10, relevances=ranking.relevance_of_distance(distances, "distance", variant)).collect()}
    few = ranking.telling_distances(asked, rows, 10, 9, found)
    assert few.count() <= 6 * 21
    assert score(few) == pytest.approx(score(ranking.cosine_distances(asked, rows, 9)), rel=1e-12)


WHOLE_RANKINGS = ["spearman_of_rankings", "mrr_mean_rank", "truth_coverage", "coverage_points", "prefix_for_common_top50"]


@pytest.mark.parametrize("name", WHOLE_RANKINGS)
def test_whole_rankings_hand_on_no_pairs_as_rows(spark, sf, monkeypatch, name):
    def refuse(*a, **k):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(ranking, "cosine_ranking", refuse)
    monkeypatch.setattr(ranking, "cosine_distances", refuse)
    assert queries.QUERIES[name](spark, sf).count()


def _ranked_plainly(rows, asked):
    """query_id -> ids in the order of rounded distance and id."""
    out = {}
    for q, v in asked:
        far = [(math.floor((1 - sum(a * b for a, b in zip(v, w)) / (math.sqrt(sum(a * a for a in w)) * math.sqrt(sum(a * a for a in v)) + 1e-10)) * 1e9 + 0.5), i) for i, w, _ in rows if i != q and w and None not in w]
        out[q] = [i for _, i in sorted(far)]
    return out


@pytest.mark.parametrize("kind,spread", [("long", 1), ("long", 1 << 40), ("string", 1)])
def test_ranks_in_blocks_equal_a_plain_sort(spark, monkeypatch, kind, spread):
    """With ranges, blocks and parts of a few rows; equal, zero and missing vectors; ids far apart and ids of texts."""
    for name, value in {"QUERIES_OF_RANKS": 2, "ROWS_OF_RANKS": 25, "RANGE_ENTRIES": 13, "PART_NUMBERS": 20, "SAMPLED": 3}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(3)
    own = (lambda i: i * spread) if kind == "long" else (lambda i: f"r{i:04}")
    rows = [(own(i), [float(x) for x in rng.integers(-2, 3, 3)], i % 4 if i % 9 else None) for i in range(80)]
    rows += [(own(90), None, 1), (own(91), [1.0, None, 2.0], 1), (own(92), [0.0, 0.0, 0.0], 2)]
    other = [(i, v[:2] if v else v, g) for i, v, g in rows if i != own(17)]
    asked = [(i, v) for i, v, _ in rows[:40:8]]
    table = lambda r: spark.createDataFrame(r, f"id {kind}, vec array<double>, g int")
    label = {i: g for i, _, g in rows}
    wanted = spark.createDataFrame([(i, v, label[i]) for i, v in asked], f"query_id {kind}, query_vec array<double>, qg int")
    plain = _ranked_plainly(rows, asked)
    got = {}
    for r in ranking.cosine_ranks(wanted, table(rows), 9, ("g", "qg")).collect():
        got.setdefault(r.query_id, []).append((r["nth"], r["rank"], r["of"]))
    for q, order in plain.items():
        places = [n + 1 for n, i in enumerate(order) if label[i] is not None and label[i] == label[q]]
        assert sorted(got.get(q, [])) == [(k + 1, n, len(places)) for k, n in enumerate(places)]
    assert sum(map(len, got.values())) > 50

    found = ranking.coverage_of_ranks(ranking.cosine_ranks(wanted, table(rows), 9, ("g", "qg"))).collect()
    assert found and all(r.median_rank == np.median([n for _, n, _ in got[r.query_id]]) for r in found)

    few = [(q, i) for q, order in plain.items() for i in order[3:60:7]] + [(asked[0][0], own(90))]
    ranks = ranking.cosine_ranks_of(wanted, table(rows), spark.createDataFrame(few, f"query_id {kind}, id {kind}"), 9).collect()
    assert sorted(map(tuple, ranks)) == sorted((q, i, plain[q].index(i) + 1) for q, i in few if i in plain[q])

    second = _ranked_plainly(other, [(q, v[:2]) for q, v in asked])
    shorter = dict((i, v) for i, v, _ in other)
    both = spark.createDataFrame([(i, v, shorter.get(i), None) for i, v, _ in rows], f"id {kind}, vec array<double>, head array<double>, x int")
    q2 = spark.createDataFrame([(q, v, v[:2]) for q, v in asked], f"query_id {kind}, vec array<double>, head array<double>")
    got = {r.query_id: r.correlation for r in ranking.cosine_rank_correlations(q2, both, "vec", "head", 9).collect()}
    for q, order in plain.items():
        at = {i: n for n, i in enumerate(second[q])}
        x, y = zip(*[(n, at[i]) for n, i in enumerate(order) if i in at])
        assert got[q] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_steps_near_a_middle_are_those_of_the_measured_distance(spark):
    rng = np.random.default_rng(8)
    q, r = rng.normal(size=(30, 64)), rng.normal(size=(400, 64))
    far = blocks.measured(q[:, None], r[None], blocks._norms(q)[:, None], blocks._norms(r)[None], "cosine")
    for digits in (3, 9):
        assert (blocks._steps(q, r, digits) == np.floor(far * 10.0**digits + 0.5)).all()
    r[0, 0], r[1] = np.nan, 0.0
    assert (blocks._steps(q, r, 9)[:, 0] == blocks.LARGEST).all() and (blocks._steps(q, r, 9)[:, 1] == 10**9).all()
    flat = spark.createDataFrame([(float(x),) for x in far[0]], "d double").select(blocks.steps(F.col("d"), 9)).collect()
    assert [x[0] for x in flat] == np.floor(far[0] * 1e9 + 0.5).astype(int).tolist()


@pytest.mark.parametrize("name", ["recall_at_k", "validation_sweep", "relevance_of_truths"])
def test_truths_of_labels_are_not_listed(spark, sf, monkeypatch, name):
    def refuse(*a, **k):
        raise AssertionError("all pairs of a label")

    monkeypatch.setattr(joins, "same_group", refuse)
    assert queries.QUERIES[name](spark, sf).count()


def test_truths_of_groups_equal_listed_truths(spark):
    members = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else None if i == 30 else "z") for i in range(32)], "id long, group string")
    asked = members.where("id % 5 = 0 or id > 29").withColumnRenamed("id", "query_id")
    truth = joins.same_group(members.where("id % 5 = 0 or id > 29"), members, "id", "group").toDF("query_id", "id")
    found = spark.createDataFrame([(q, (7 * q + 3 * k) % 32, float(k), k) for q in range(0, 35, 5) for k in range(1, 9)], "query_id long, id long, distance double, rank long").where("query_id <> id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    few, counts = ranking.truths_of_groups(asked, members, found)
    for capped in (True, False):
        want = rows(truth.join(found.where("rank <= 5"), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("rank"), F.count("*"), F.count("rank") / (F.least(F.count("*"), F.lit(5)) if capped else F.count("*"))))
        assert rows(ranking.recall_at(found, few, 5, capped, counts)) == want == rows(ranking.recall_at(found, truth, 5, capped))
    assert rows(ranking.relevance_of_groups(asked, members, found, "distance")) == rows(ranking.relevance_of_truths(truth, found, "distance"))


def test_groups_by_number_make_no_pairs(spark):
    """Trajectories with several segments of a number, alone in a group, first, last and between, and a query that stands twice."""
    data = [("a", 1, "g", 1), ("b", 2, "g", 1), ("bb", 2, "g", 1), ("c", 3, "g", 1), ("\u00e9d", 4, "g", 1), ("e", 5, "h", 1), ("f", 1, "g", 2), ("g", 6, None, 1), ("h", None, "g", 1), ("a", 7, "k", 1), ("x", 8, "k", 1), ("i", 2, "g", 2)]
    rows = spark.createDataFrame(data, "seg string, traj long, grp string, number int")
    found = joins.same_group_by_number(rows, rows, "grp", "traj", "seg", "number")
    assert "cartesian" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and "t__ = rt__" not in found._jdf.queryExecution().toString()
    want = {}
    for s, t, g, n in data:
        others = [m for m, u, h, k in data if t is not None and u is not None and u != t and g is not None and h == g and k == n]
        want[s, n] = sorted(want.get((s, n), []) + others)
    assert {(r["query"], r["number"]): r["matches"] for r in found.collect()} == {k: ",".join(v) for k, v in want.items() if v}


def test_cells_meet_their_visits_in_blocks(spark, monkeypatch, tmp_path):
    """Parts of few rows and queries, equal and zero vectors; no distance is an expression over pairs."""
    from tracewright.operators import vector_index

    monkeypatch.setattr(vector_index, "PART_ROWS", 7)
    monkeypatch.setattr(vector_index, "PART_QUERIES", 3)
    monkeypatch.setattr(vectors, "cosine_distance", None)
    rng = np.random.default_rng(6)
    made = rng.normal(size=(60, 4)).round(1)
    made[20:30], made[31] = made[3], 0.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "id long, vec array<double>")
    asked = rows.where("id % 6 = 1").toDF("query_id", "query_vec")
    index = vector_index.CosineIndex.build(rows, f"{tmp_path}/index", cells=5)
    out = lambda df: sorted(map(tuple, df.select("query_id", "id", "distance", "rank").collect()))
    assert out(index.search(asked, 4, digits=9)) == out(ranking.cosine_top_k(asked, rows, 4, 9))
