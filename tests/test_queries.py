"""Every registered query against its DuckDB SQL on the smallest tables: names, row counts and values."""

import math

import pytest

from tracewright.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v + 0.0 if isinstance(v, float) else v


def sort_key(row):
    """Exact columns first, then rounded floats, so that a difference in a last digit does not pair other rows."""
    exact = [(x is None, str(x)) for x in row if not isinstance(x, float)]
    return tuple(exact), tuple((x is None, round(x, 3) if isinstance(x, float) else 0.0) for x in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    if name not in queries.SQL:
        assert rows
        return
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=sort_key), sorted(want, key=sort_key)):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (a, b)


def test_adaptive_rerank_of_lists_over_its_limit(spark, monkeypatch):
    """The filters work as the SQL says on lists of 149 candidates when 60 are the limit."""
    import duckdb

    from tracewright.operators import prediction
    from tracewright.plans import recurrences

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    monkeypatch.setattr(prediction, "SMALL_LIST", 60)
    rows = sorted(map(tuple, queries.QUERIES["adaptive_rerank"](spark, folder).select("query_id", "id", "rank_s1", "dtw_dist", "rank_s2").collect()))
    want = sorted(c.execute(recurrences.adaptive(60)).fetchall())
    assert len(rows) == len(want) and sum(math.isinf(r[3]) for r in rows) == sum(math.isinf(r[3]) for r in want) > 100
    assert all(a[:3] == b[:3] and a[4] == b[4] and (a[3] == b[3] or math.isclose(a[3], b[3], abs_tol=2e-6)) for a, b in zip(rows, want))
