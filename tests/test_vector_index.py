"""The stored cosine index against exact search: recall and work on clustered vectors, odd vectors, appended rows."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import ranking, vector_index
from tracewright.operators.vector_index import CosineIndex
from tracewright.sources.scratch import scratch_path


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>").repartition(4)


def clustered(n=4000, centres=40, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dims))


def asked(df, every=50):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))


def found(df):
    return sorted((r.query_id, r.id, round(r.distance, 9), r["rank"]) for r in df.collect())


def test_few_probes_find_most_neighbours_and_visit_few_rows(spark):
    df = table(spark, clustered())
    index = CosineIndex.build(df, scratch_path(spark, "index"))
    exact = {r[:2] for r in found(ranking.cosine_top_k(asked(df), df, 10))}
    got = {r[:2] for r in found(index.search(asked(df), 10, probes=6))}
    assert len(got & exact) >= 0.9 * len(exact) == 0.9 * 800
    visited = index.visited(asked(df), 10, probes=6).agg(F.sum("rows")).first()[0]
    assert visited < 0.3 * 80 * 4000
    every = index.visited(asked(df), 10).agg(F.sum("rows")).first()[0]
    assert every < 0.8 * 80 * 4000  # the stop bound spares cells even when all may be visited


def test_all_cells_equal_exact_search_after_appending_and_reopening(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 40)  # cells in parts
    v = clustered(900, 7, 5)
    v[::3] = v[1]  # a third of all rows are one vector
    rows = [*v, None, np.zeros(5), np.full(5, 1e-9), -v[1], 1e6 * v[2], np.full(5, 1e-3)]
    df = table(spark, rows)
    index = CosineIndex.build(df.where("id < 500"), scratch_path(spark, "index"), cells=9, sample_rows=300)
    index.append(df.where("id >= 500"))
    index = CosineIndex(spark, index.path)
    queries = df.where("id % 50 = 0 or id > 895").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    for k in (1, 12):
        assert found(index.search(queries, k, digits=9)) == found(ranking.cosine_top_k(queries.where("query_vec is not null"), df.where("vec is not null"), k, 9))
    assert index.lists().count() == len(rows) - 1
    assert len(found(index.search(queries.where("query_id = 0"), 2000))) == len(rows) - 2  # more asked for than there are


def test_index_of_no_rows(spark):
    df = table(spark, [[1.0, 2.0]]).limit(0)
    index = CosineIndex.build(df, scratch_path(spark, "index"))
    assert index.search(asked(df), 3).count() == 0
    index.append(table(spark, [[1.0, 2.0], [2.0, 1.0]]))  # without centres all rows are visited
    assert [r[:2] for r in found(index.search(asked(table(spark, [[1.0, 2.0]])), 3))] == [(0, 1)]
