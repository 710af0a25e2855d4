"""Whitening against a dense eigensolver, resampling against a plain loop, on tables and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import common, resampling, whitening


def matrices():
    rng = np.random.default_rng(1)
    for n, d in ((5, 1), (50, 2), (500, 7), (300, 64), (10, 16), (400, 90)):
        x = rng.normal(size=(n, d))
        yield x
        yield x * np.logspace(0, -6, d)
        yield np.repeat(x[:, :1], d, axis=1)  # one direction
        yield np.vstack([np.eye(d), -np.eye(d)])  # all eigenvalues equal


@pytest.mark.parametrize("x", list(matrices()), ids=lambda x: f"{x.shape}")
def test_components_equal_a_dense_solver(x):
    x = x - x.mean(axis=0)
    r = whitening.triangular([x[:3], x[3:]] if len(x) > 3 else [x])
    a, b, v = whitening.bidiagonal(r)
    assert np.allclose(np.abs(v.T @ v - np.eye(len(v))), 0, atol=1e-12)
    want = np.linalg.svd(r, compute_uv=False)
    got = whitening.dqds(a, b)
    big = want > 1e-11 * want[0]
    assert np.allclose(got[big], want[big], rtol=1e-11)
    w, e, trace = whitening.components(r, len(x))
    cov = x.T @ x / len(x)
    assert np.abs(cov @ w - w * e).max() < 1e-12 * e[0] and np.abs(w.T @ w - np.eye(w.shape[1])).max() < 1e-10
    assert math.isclose(trace, np.trace(cov), rel_tol=1e-12) and w.shape[1] == min(8, big.sum())


def test_small_singular_values_are_accurate():
    # a graded bidiagonal matrix whose product form would lose the small ones: det = product of the diagonal
    a, b = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1.0, 1e-4, 1e-8])
    assert math.isclose(np.prod(whitening.dqds(a, b)), 1e-24, rel_tol=1e-10)


def whitened(vectors):
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    return x, x - x.mean(axis=0)


def test_whitened_rows_of_the_table(spark, sf):
    table = {r.vec_id: r.embedding for r in common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()}
    rows = whitening.op11_whitening(spark, sf).collect()
    ids = sorted(table)
    x, centred = whitened([table[i] for i in ids])
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = np.zeros((len(x), 8))
    for r in rows:
        got[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert r.n == len(x) and math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-10
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(rows) == 8 * len(x) and np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    exact = {i: sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for i, row in zip(ids, x)}
    assert all(exact[r.vec_id] == r.deviation for r in rows)


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (None, [2.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [3.0, 3.5]), (7, [3.0, 3.5]), (8, [1.0]), (9, [5.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, n int, d string, whitened double")
    got = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == [("1", 1, 4), ("1", 2, 4), ("7", 1, 4), ("7", 1, 4), ("7", 2, 4), ("7", 2, 4), ("8", 1, 2), ("9", 1, 2), ("None", 1, 4), ("None", 2, 4)]
    two = [r for r in got if r.n == 4]
    w = np.array([[r.whitened for r in two if r.component == k] for k in (1, 2)])
    assert np.allclose(w @ w.T / 4, np.eye(2)) and all(r.identity_error < 1e-12 for r in got)
    assert whitening.whiten(df.limit(0)).count() == whitening.whiten(df.where("vec_id in (2, 10)")).count() == 0


def test_whitening_fit_in_a_tree_of_many_tasks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(70)
    rows = whitening.usable(df)
    sums = whitening.exact_sums(rows)
    _, centred = whitened(vectors)
    r = whitening.factors(rows, sums)[5]
    assert np.allclose(r.T @ r, centred.T @ centred)


def test_deviations_beyond_a_long():
    fit = whitening.Fit(3_000_000, np.array([3_000_000 * 100_000] * 2), np.eye(2))
    assert fit.deviations(np.array([[100_000, 100_000], [100_900, 100_000], [102_024, 100_001]])) == [0, (3_000_000 * 900) ** 2, None]


# ---- resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_buckets(text):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=5, least=20):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in docs:
        np.add.at(s, plain_buckets(text), 1)
    for text in target:
        np.add.at(t, plain_buckets(text), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        b = plain_buckets(text)
        weight = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], (ranks.get(r[:4]) or [None]).pop(0) if ranks.get(r[:4]) else None) for r in rows), key=str)


WORD = "ab cd Ef gh ij kl mn op qr st uv wx yz 12 34 né "
ODD_DOCS = [
    (1, WORD * 3), (1, WORD * 3), (2, None), (3, ""), (None, WORD * 2), (4, "--- ..."), (5, "one"), (6, "x" * 5000 + " " + "y" * 64 + " " + "z" * 63 + " a " + WORD * 9),
    (7, (WORD + "q" * 70 + " ") * 3000), (8, "A,b;c\x00d e f " * 9), *[(i, f"{WORD * 2} {i % 7} {i % 3}") for i in range(10, 160)],
]


@pytest.mark.parametrize("percent,margin", [(5, 0.002), (5, 0.0), (40, 0.0), (100, 0.002), (1, 0.5)])
def test_resampling_equals_a_plain_loop(spark, percent, margin):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in ODD_DOCS], "doc_id long, text string, row int, rank string, score double")
    target = spark.createDataFrame([(WORD,), (None,), ("né 12 34",)], "text string")
    gain = resampling.gains(resampling.bucket_counts(df), resampling.bucket_counts(target))
    rows = resampling.draw(resampling.weighed(df, gain), percent, margin=margin).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str)
    assert got == plain_resample(ODD_DOCS, [WORD, None, "né 12 34"], percent)


def test_resampling_of_equal_scores_and_empty_tables(spark):
    docs = [(5, WORD * 2)] * 300 + [(6, "too short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = df.limit(0).select("text")
    rows = resampling.resample(df, none).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 16)) and len(rows) == 301
    assert resampling.resample(df.limit(0), none).count() == 0
    assert [r["rank"] for r in resampling.resample(df.where("doc_id = 6"), none).collect()] == [None]


def test_crc_of_appended_words():
    crc = resampling.Crc()
    for n in (0, 1, 63, 64, 65, 127, 128, 1000, 100_000):
        tail = bytes(i * 7 % 251 for i in range(n))
        c = np.array([zlib.crc32(b"head"), zlib.crc32(b"")], np.uint32)
        assert (crc.shift(c, np.array([n, n])) ^ np.uint32(zlib.crc32(tail))).tolist() == [zlib.crc32(b"head" + tail), zlib.crc32(tail)]
