"""A kept store of embeddings: one table keyed by (configuration, modality, level, id), to which only missing entries are added.

An entry's key is a hash of what it was made with, so other sizes, or another version of a modality, live beside it. A sweep asks the store
first; rows that it has are read, the others are computed and appended, and a second run of the same sweep computes nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

Config = tuple[str, int, int]


def key_of(modality: str, coarse: int, fine: int, version: str = "1") -> str:
    return hashlib.sha256(f"{modality}|{coarse}|{fine}|{version}".encode()).hexdigest()[:16]


class EmbeddingStore:
    """The store at a path; it begins empty."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"level string, id {id_type}, vec array<double>, modality string, key string"
        self.spark.createDataFrame([], self.schema).write.mode("append").partitionBy("modality", "key").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _wanted(self, configs: list[Config], modalities: list[str], version: str) -> list[tuple[str, str, Config]]:
        return [(m, key_of(m, c[1], c[2], version), c) for c in configs for m in modalities]

    def missing(self, rows: DataFrame, modality: str, key: str) -> DataFrame:
        """The rows(id, level, …) that have no entry under a key."""
        had = self.entries().where((F.col("modality") == modality) & (F.col("key") == key)).select("level", "id")
        return rows.join(had, ["level", "id"], "left_anti").select(*rows.columns)

    def ensure(self, rows: DataFrame, configs: list[Config], kinds: dict, velocity: str | None = None, version: str = "1") -> int:
        """Compute and append what rows(id, level, …) lack of a sweep (see search.embedding_sweep); how many entries that were."""
        before, done = self.entries().count(), set()
        for modality, key, config in self._wanted(configs, [*kinds, *(["velocity"] if velocity else [])], version):
            if (modality, key) in done:
                continue
            done.add((modality, key))
            lacking = self.missing(rows, modality, key)
            made = search.embedding_sweep(lacking, [config], {m: f for m, f in kinds.items() if m == modality}, velocity if modality == "velocity" else None)
            made.select("level", "id", F.col("vec").cast("array<double>").alias("vec"), F.lit(modality).alias("modality"), F.lit(key).alias("key")).write.mode("append").partitionBy("modality", "key").parquet(self.path)
        return self.entries().count() - before

    def sweep(self, rows: DataFrame, configs: list[Config], kinds: dict, velocity: str | None = None, version: str = "1") -> DataFrame:
        """search.embedding_sweep(rows, …) out of the store, after ensure(): config, modality, id, level (and parent), vec."""
        self.ensure(rows, configs, kinds, velocity, version)
        names = [(c[0], m, k) for m, k, c in self._wanted(configs, [*kinds, *(["velocity"] if velocity else [])], version)]
        names = self.spark.createDataFrame(names, "config string, modality string, key string")  # a row a configuration and modality
        keep = ["id", "level", *[c for c in ("parent",) if c in rows.columns]]
        return self.entries().join(F.broadcast(names), ["modality", "key"]).join(rows.select(*keep), ["id", "level"]).select("config", "modality", *keep, "vec")
