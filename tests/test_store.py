"""The embedding store: only missing entries are computed, for five modalities at two levels."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import vectors
from tracewright.plans import search
from tracewright.plans.store import EmbeddingStore
from tracewright.sources.scratch import scratch_path


def test_a_second_sweep_computes_nothing_and_new_rows_are_added(spark):
    rng = np.random.default_rng(2)
    walk = lambda n, d: np.cumsum(rng.normal(size=(n, d)), axis=0).tolist()
    rows = [(i, level, i // 3, walk(12 + i, 3), walk(12 + i, 4), float(i)) for level in ("trajectory", "segment") for i in range(9)]
    rows = spark.createDataFrame(rows, "id long, level string, parent long, seq array<array<double>>, turns array<array<double>>, length double")
    kinds = {
        "position": lambda c, f: vectors.position_embedding("seq", c, f), "joint": lambda c, f: vectors.joint_embedding("seq", c, f, 3),
        "orientation": lambda c, f: vectors.axis_embedding("turns", c, f), "metadata": lambda c, f: F.array(F.col("length") * c, F.lit(1.0)),
    }
    configs = [("a", 4, 0), ("b", 4, 8)]
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    assert store.ensure(rows.where("id < 6"), configs[:1], kinds, "seq") == 5 * 12
    assert store.ensure(rows, configs, kinds, "seq") == 5 * 6 + 5 * 18  # three more rows a level, and the other configuration
    assert store.ensure(rows, configs, kinds, "seq") == 0 == store.ensure(rows.limit(0), configs, kinds, "seq")
    assert store.ensure(rows, configs[:1], {"position": kinds["position"]}, version="2") == 18
    got = {(r.config, r.modality, r.level, r.id, r.parent): r.vec for r in EmbeddingStore(spark, store.path).sweep(rows, configs, kinds, "seq").collect()}
    want = {(r.config, r.modality, r.level, r.id, r.parent): r.vec for r in search.embedding_sweep(rows, configs, kinds, "seq").collect()}
    assert set(got) == set(want) and len(want) == 5 * 2 * 18 and all(np.allclose(got[k], want[k]) for k in want)
