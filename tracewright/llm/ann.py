"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Largest inner product becomes smallest distance by adding to each vector the coordinate that brings it to the largest
norm (queries are scaled to that norm and get 0). `TABLES` tables hash a vector with `FUNCTIONS` functions
floor((a.x + b) / width), a Gaussian, hence stable. A query visits, in every table, its own bucket and then buckets
perturbed by -1 or +1 in some functions, in the order of estimated success (smallest sum of squared distances to the
crossed boundaries), `PROBES` in all. The tables' candidates are scored in double precision and merged.

Every vector is indexed: the tables are written once, a row for each vector and table. Buckets are gathered in groups of about
`GROUP_ROWS` rows; a bucket that alone holds more (such as a vector that a third of all rows share) is split over several. Probes
meet the counted buckets first, so a query travels only to groups that hold a bucket it visits, at most as often as it has probes,
and in a group only the pairs of a visited bucket are multiplied. Each group returns at most k rows a query. A query whose
probes find fewer than k rows visits all buckets of the first table. visits() tells how many pairs are scored. The defaults are for vectors without structure
(independent directions in 64 dimensions), where the probes must reach four fifths of the rows for a recall of 0.97; on clustered ones
(80 centres, deviations of 0.64 in all), six tables of eight functions 1.5 wide with 60 probes reach 0.19 of the rows for 0.98.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components or with a null id take no part;
vectors meet those of their own length only; rows are told apart by a written number, so each row that repeats an id is a
query and a candidate of its own; ties go to the smaller id; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TABLES, FUNCTIONS, WIDTH, PROBES = 2, 6, 2.0, 250
#: Rows of a group of buckets, about; rows of a bucket's part, at most about; queries that are scored at once.
GROUP_ROWS, CHUNK = 8192, 256
SEED = 11


@dataclass(frozen=True)
class Params:
    tables: int = TABLES
    functions: int = FUNCTIONS
    width: float = WIDTH
    probes: int = PROBES


class Hasher:
    """The hash functions of vectors of one length."""

    def __init__(self, length: int, norm: float, params: Params = Params(), seed: int = SEED):
        self.norm, self.params = norm or 1.0, params
        rng, p = np.random.default_rng(seed), params
        self.a = rng.normal(size=(p.tables, length + 1, p.functions))
        self.b = rng.uniform(0, p.width, (p.tables, p.functions))
        self.moves = np.array(list(product((0, -1, 1), repeat=p.functions)))
        self.move_cost = np.array([0, 2, 1])[self.moves]  # where a move's cost stands: 0, +1, -1
        self.place = (1 << 10) ** np.arange(min(p.functions, 6), dtype=np.int64)

    def _project(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table] + self.b[table]) / self.params.width

    def _key(self, cells: np.ndarray) -> np.ndarray:
        cells = cells.astype(np.int64) + 512
        key = (cells[..., :6] * self.place).sum(axis=-1)
        for k in range(6, cells.shape[-1]):  # more functions than fit are mixed in
            key = (key ^ (key >> 29)) * 0x5851F42D4C957F2D + cells[..., k]
        return key

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table: (rows, tables)."""
        unit = vectors / self.norm
        unit = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1, keepdims=True)))])
        return np.stack([self._key(np.floor(self._project(unit, t))) for t in range(self.params.tables)], axis=1)

    def probes(self, queries: np.ndarray, table: int) -> np.ndarray:
        """The buckets that each query visits in a table, likeliest first."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = self._project(np.hstack([unit, np.zeros((len(unit), 1))]), table)
        own = np.floor(at)
        low = at - own
        cost = np.stack([np.zeros_like(low), low**2, (1 - low) ** 2], axis=-1)
        sums = sum(cost[:, k, self.move_cost[:, k]] for k in range(self.params.functions))
        most = min(self.params.probes, sums.shape[1])
        first = np.argpartition(sums, most - 1, axis=1)[:, :most]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(sums, first, 1), axis=1, kind="stable"), 1)
        return self._key(own[:, None, :] + self.moves[first])


def score_group(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, buckets: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, visited: list[np.ndarray], k: int):
    """(query rows, rows, ids, scores) of the k best rows of each query among those of its visited buckets, ties to the smaller id, then row."""
    order = np.argsort(buckets, kind="stable")
    rows, ids, vectors, buckets = rows[order], ids[order], vectors[order], buckets[order]
    keys, starts = np.unique(buckets, return_index=True)
    ends = np.append(starts[1:], len(rows))
    norms, out = np.sqrt((vectors**2).sum(axis=1)).max(), []
    for at in range(0, len(queries), CHUNK):
        q, names = queries[at : at + CHUNK], query_rows[at : at + CHUNK]
        rough = np.full((len(q), len(rows)), -np.inf)
        asked = np.repeat(np.arange(len(q)), [len(v) for v in visited[at : at + CHUNK]])
        wanted = np.concatenate(visited[at : at + CHUNK])
        by = np.argsort(wanted, kind="stable")
        asked, wanted = asked[by], wanted[by]
        cuts = np.searchsorted(wanted, keys), np.searchsorted(wanted, keys, "right")
        for a, b, first, last in zip(starts, ends, *cuts):
            if last > first:  # only pairs of a visited bucket are multiplied
                who = asked[first:last]
                rough[who, a:b] = q[who] @ vectors[a:b].T
        rough[names[:, None] == rows[None, :]] = -np.inf
        kth = min(k, rough.shape[1])
        cut = np.partition(rough, rough.shape[1] - kth, axis=1)[:, rough.shape[1] - kth]
        slack = 1e-9 * np.maximum(1.0, np.linalg.norm(q, axis=1) * norms)
        row, col = np.nonzero((rough > -np.inf) & (rough >= (cut - slack)[:, None]))
        score = (q[row] * vectors[col]).sum(axis=1)  # the same order of additions for every pair, so equal vectors tie
        best = np.lexsort((rows[col], ids[col], -score, row))
        row, col, score = row[best], col[best], score[best]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((names[row[best]], rows[col[best]], ids[col[best]], score[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [query_rows[:0], rows[:0], ids[:0], np.zeros(0)]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double), n (its length): the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("n")).where("id is not null and n > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


class Index:
    """The written tables of df's vectors: entries(n, t, bucket, row, id, v) and their counted buckets."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()):
        self.params = params
        self.rows = common.written(usable(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
        norm = self.rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
        norm = self.norm = float(norm or 1.0) * (1 + 1e-12)

        def hashed(frames):
            makers: dict[int, Hasher] = {}
            for frame in frames:
                for n, part in frame.groupby("n"):
                    make = makers.setdefault(n, Hasher(int(n), norm, params))
                    yield pd.DataFrame({"row": part.row, "n": part.n, "b": list(make.buckets(np.vstack(part.v)))})

        places = self.rows.select("row", "v", "n").mapInPandas(hashed, "row long, n int, b array<long>")
        self.places = common.written(places.select("row", "n", F.posexplode("b").alias("t", "bucket")), "ann-buckets")
        self.sizes = common.written(self.places.groupBy("n", "t", "bucket").agg(F.count("*").alias("size")), "ann-sizes")

    def grouped(self, buckets: DataFrame) -> DataFrame:
        """buckets(n, t, bucket) with their group and number of parts: groups follow the number of rows, and a bucket of more than GROUP_ROWS rows has parts."""
        totals = self.sizes.where("t = 0").groupBy("n").agg(F.ceil(F.sum("size") / GROUP_ROWS).alias("groups"))
        large = self.sizes.where(F.col("size") > GROUP_ROWS).withColumn("parts", F.ceil(F.col("size") / GROUP_ROWS)).drop("size")
        found = buckets.join(F.broadcast(totals), "n").join(large, ["n", "t", "bucket"], "left")  # totals: a row a vector length
        return found.withColumn("group", F.pmod(F.xxhash64("bucket"), "groups")).withColumn("parts", F.coalesce("parts", F.lit(1)).cast("int")).drop("groups")

    def probes(self, asked: DataFrame) -> DataFrame:
        """query_row, n, t, bucket: the buckets that the rows of asked(row, v, n) visit, whether they hold rows or not."""
        norm, params = self.norm, self.params

        def run(frames):
            makers: dict[int, Hasher] = {}
            for frame in frames:
                for n, part in frame.groupby("n"):
                    make = makers.setdefault(n, Hasher(int(n), norm, params))
                    for at in range(0, len(part), CHUNK):
                        some = part.iloc[at : at + CHUNK]
                        vectors = np.vstack(some.v)
                        for t in range(params.tables):
                            yield pd.DataFrame({"query_row": some.row.to_numpy(), "n": n, "t": t, "b": list(make.probes(vectors, t))})

        return asked.select("row", "v", "n").mapInPandas(run, "query_row long, n int, t int, b array<long>").withColumn("bucket", F.explode("b")).drop("b")


def visits(index: Index, is_query) -> DataFrame:
    """query_id, pairs: how many pairs the probes of each query score (a row in several tables counts in each)."""
    asked = index.rows.where(is_query)
    met = index.probes(asked).join(index.sizes, ["n", "t", "bucket"]).groupBy("query_row").agg(F.sum("size").alias("pairs"))
    return asked.select(F.col("row").alias("query_row"), F.col("id").alias("query_id")).join(met, "query_row", "left").select("query_id", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def _scored(index: Index, asked: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, vec_row, vec_id, score: the k best rows of each group that a query visits."""
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")
    left = index.grouped(index.places).withColumn("part", part).join(index.rows.select("row", "id", "v"), "row")
    visited = index.grouped(probes.join(index.sizes.drop("size"), ["n", "t", "bucket"])).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visited = visited.groupBy("query_row", "n", "t", "group", "part").agg(F.collect_list("bucket").alias("buckets"))  # as many as the probes at most
    right = visited.join(asked.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_row")
    names = {"query_row": "int64", "query_id": "int64", "vec_row": "int64", "vec_id": "int64", "score": "float64"}

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in names.items()})
        query_rows = queries.query_row.to_numpy()
        found, rows_, ids, scores = score_group(rows.row.to_numpy(), rows.id.to_numpy(), np.vstack(rows.v), rows.bucket.to_numpy(), query_rows, np.vstack(queries.qv), list(queries.buckets), k)
        order = np.argsort(query_rows)
        query_ids = queries.query_id.to_numpy()[order][np.searchsorted(query_rows[order], found)]
        return pd.DataFrame(dict(zip(names, (found, query_ids, rows_, ids, scores))))

    keys = ["n", "t", "group", "part"]
    return left.select(*keys, "row", "id", "v", "bucket").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_row long, query_id long, vec_row long, vec_id long, score double")


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that meets is_query (a condition on id)."""
    index = Index(df, id_col, vector_col, params)
    asked = index.rows.where(is_query)

    def best(rows: DataFrame) -> DataFrame:
        once = rows.dropDuplicates(["query_row", "vec_row"])  # a row may be found in several tables
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k)

    found = common.written(best(_scored(index, asked, index.probes(asked), k)), "ann-found")
    counts = found.groupBy("query_row").agg(F.count("*").alias("found"))
    others = index.sizes.where("t = 0").groupBy("n").agg((F.sum("size") - 1).alias("others"))
    short = asked.join(counts, asked.row == counts.query_row, "left").join(F.broadcast(others), "n").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("others"))).select("row", "id", "v", "n")
    short = common.written(short, "ann-short")
    if not short.isEmpty():
        every = short.select(F.col("row").alias("query_row"), "n").join(index.sizes.where("t = 0").select("n", "t", "bucket"), "n")
        whole = best(_scored(index, short, every, k))
        found = found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(whole)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
