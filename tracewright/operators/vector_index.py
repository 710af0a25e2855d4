"""A stored index for approximate cosine search, exact when all cells may be visited.

A coarse quantiser (spherical k-means, fitted on a bounded sample) gives every vector its cell, the centre at the smallest
angle. The inverted lists are one Parquet table, partitioned by cell, that keeps each row's angle to its centre; new rows
are appended to it under the same centres. A query visits cells in the order of their centres' angles, in two rounds: first as many as hold k
rows, then those of its other probes that can still hold a nearer row than the k-th found. What a cell can hold follows from the
triangle inequality of angles: no row of a cell is nearer than the angle to its centre less the cell's largest angle. So the stop loses nothing, and with
as many probes as cells the result is that of ranking.cosine_top_k.

Only the centres and one figure a cell (at most MAX_CELLS) reach the driver. A cell of many rows is joined in parts, so a hot cell
spreads over tasks. Null vectors are not stored; vectors of (nearly) no length have a cell of their own that every query visits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import settled
from . import blocks, ranking

#: Most cells, and most rows of the sample that the centres are fitted on; rows and about how many queries of a cell's part.
MAX_CELLS, SAMPLE_ROWS, PART_ROWS, PART_QUERIES = 4096, 20_000, 50_000, 8192
#: The cell of vectors shorter than SHORT, whose direction says little; slack of bounds for rounded angles.
NO_CELL, SHORT, SLACK = -1, 1e-2, 2e-6


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """Unit centres of spherical k-means; a centre that loses all its rows moves to the row worst served."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        close = unit @ centres.T
        own = close.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        worst = np.argsort(close[np.arange(len(unit)), own], kind="stable")
        centres = np.where(size[:, None] < 1e-9, centres, sums / np.maximum(size, 1e-9)[:, None])
        centres[lost] = unit[worst[: len(lost)]]
    return centres


class CosineIndex:
    """The stored index at a path: build() or open it, append() rows, search()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{self.path}/centres").collect())
        self.centres = np.array([r.centre for r in rows], float) if rows else np.zeros((0, 1))
        self._figures = None

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> CosineIndex:
        """Write the index of rows(id, vec); about the root of the number of rows as cells if none is given."""
        spark, path = rows.sparkSession, path.rstrip("/")
        known = rows.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
        cells = min(MAX_CELLS, cells or max(1, int(known.count() ** 0.5)))
        sample = known.where(vectors.norm("vec") >= SHORT).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_rows).select("vec").collect()
        centres = fit_centres(np.array([r.vec for r in sample], float), cells) if sample else np.zeros((0, 0))
        spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        known.limit(0).write.parquet(f"{path}/schema")
        index = cls(spark, path)
        index.append(known)
        return index

    def append(self, rows: DataFrame) -> None:
        """Add rows(id, vec) to the lists; centres and rows already stored stay as they are."""
        centres, kind = self.spark.sparkContext.broadcast(self.centres), rows.schema["id"].dataType.simpleString()

        def assign(frames):
            for frame in frames:
                v = np.vstack(frame.vec) if len(frame) else np.zeros((0, 1))
                size = np.linalg.norm(v, axis=1)
                cell, angle = np.full(len(v), NO_CELL), np.zeros(len(v))
                long = np.flatnonzero(size >= SHORT)
                if len(long) and len(centres.value):
                    close = (v[long] / size[long, None]) @ centres.value.T
                    cell[long] = close.argmax(axis=1)
                    angle[long] = np.arccos(np.clip(close.max(axis=1), -1, 1))
                yield pd.DataFrame({"id": frame.id, "vec": frame.vec, "angle": angle, "cell": cell})

        known = rows.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))
        known.mapInPandas(assign, f"id {kind}, vec array<double>, angle double, cell int").write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")
        self._figures = None

    def lists(self) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.path}/schema").schema.add("angle", "double").add("cell", "integer")
        return self.spark.read.schema(stored).parquet(f"{self.path}/lists")

    def figures(self) -> pd.DataFrame:
        """cell, n, radius: a row a cell, read from two columns of the lists and kept until the next append."""
        if self._figures is None:
            rows = self.lists().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()
            self._figures = pd.DataFrame([r.asDict() for r in rows], columns=["cell", "n", "radius"])
        return self._figures

    def probes(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, query_vec, cell, n, at (the query's angle to the centre), near (no row of the cell is at a smaller angle), early
        (the first round visits it): the cells of each query, likeliest first."""
        figures, centres = self.figures(), self.centres
        real = figures[figures.cell != NO_CELL]
        cells, sizes, radius = real.cell.to_numpy(int), real.n.to_numpy(int), real.radius.to_numpy(float)
        loose = figures[figures.cell == NO_CELL].n.sum()
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(frames):
            for frame in frames:
                for query_id, v in zip(frame.query_id, frame.query_vec):
                    size = float(np.linalg.norm(v))
                    at = np.arccos(np.clip(centres[cells] @ (v / size), -1, 1)) if size >= SHORT and len(cells) else np.zeros(len(cells))
                    near = np.maximum(0.0, at - radius) if size >= SHORT else at  # a query without direction stops nowhere
                    order = np.argsort(at, kind="stable")[:probes]
                    before = np.cumsum(sizes[order]) - sizes[order] + loose
                    rows = pd.DataFrame({"cell": cells[order], "n": sizes[order], "at": at[order], "near": near[order], "early": before <= k})
                    if loose:
                        rows = pd.concat([pd.DataFrame({"cell": [NO_CELL], "n": [loose], "at": [0.0], "near": [0.0], "early": [True]}), rows])
                    rows.insert(0, "query_id", query_id)
                    rows.insert(1, "query_vec", [v] * len(rows))
                    yield rows

        known = queries.where(F.col("query_vec").isNotNull()).select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
        return known.mapInPandas(run, f"query_id {kind}, query_vec array<double>, cell int, n long, at double, near double, early boolean")

    def _scored(self, visits: DataFrame, k: int, digits: int | None) -> DataFrame:
        """query_id, id, distance of what can be among the k nearest rows of a visited cell, no farther than the visit's `most`. Cells meet their visits in parts of
        PART_ROWS rows and about PART_QUERIES queries, each by one matrix product (blocks.nearest)."""
        figures, slack = self.figures(), 10.0**-digits if digits is not None else 0.0
        groups = max(1, -(-visits.select("query_id").distinct().count() // PART_QUERIES))
        parts = self.spark.createDataFrame([(int(c), -(-int(n) // PART_ROWS)) for c, n in zip(figures.cell, figures.n)], "cell int, parts int")  # MAX_CELLS rows at most
        own = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        whole = lambda c: f"not exists({c}, x -> x is null)"
        rows = self.lists().where(whole("vec")).join(F.broadcast(parts), "cell").withColumn("part", own("id", F.col("parts"))).withColumn("asked", every(F.lit(groups)))
        asked = visits.where(whole("query_vec")).join(F.broadcast(parts), "cell").withColumn("part", every(F.col("parts"))).withColumn("asked", own("query_id", F.lit(groups)))
        keys = ["cell", "part", "asked"]
        kinds = visits.schema["query_id"].dataType.simpleString(), self.lists().schema["id"].dataType.simpleString()
        left, right = asked.select(*keys, "query_id", "query_vec", "most"), rows.select(*keys, "id", "vec")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda q, r: blocks.nearest(q, r, k, slack), f"query_id {kinds[0]}, id {kinds[1]}, distance double")
        return found.withColumn("distance", F.round("distance", digits)) if digits is not None else found

    def rounds(self, queries: DataFrame, k: int, probes: int | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(found in the first round, visits of the first round, visits of the second)."""
        every = settled(self.probes(queries, k, probes or MAX_CELLS))
        early = every.where("early")
        first = settled(ranking.top_k(self._scored(early.withColumn("most", F.lit(float("inf"))), k, digits), ["query_id"], ["distance", "id"], k))
        limits = first.groupBy("query_id").agg(F.max("distance").alias("limit"), F.count("*").alias("found"))
        open_ = F.coalesce(F.col("found"), F.lit(0)) < k
        reach = F.when(open_, F.lit(4.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), 1 - F.col("limit") - SLACK)) + SLACK)
        late = every.where("not early").join(limits, "query_id", "left").withColumn("reach", reach)
        short = vectors.norm("query_vec") < SHORT
        late = late.withColumn("reach", F.when(short, F.lit(4.0)).otherwise(F.col("reach"))).where("near <= reach")
        late = late.withColumn("most", F.when(open_, F.lit(float("inf"))).otherwise(F.col("limit")))
        return first, early, late

    def search(self, queries: DataFrame, k: int, probes: int | None = None, digits: int | None = None) -> DataFrame:
        """query_id, id, distance, rank: the k nearest rows found for queries(query_id, query_vec) in at most `probes` cells (all, if
        none is given); the query itself is left out, ties go to the smaller id."""
        first, _, late = self.rounds(queries, k, probes, digits)
        rows = first.select("query_id", "id", "distance").unionByName(self._scored(late, k, digits))
        return ranking.top_k(rows, ["query_id"], ["distance", "id"], k)

    def visited(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, rows: how many stored rows lie in the cells that a search visits."""
        _, early, late = self.rounds(queries, k, probes)
        return early.select("query_id", "n").unionByName(late.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("rows"))
