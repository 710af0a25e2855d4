"""The attention model against plain loops and difference quotients, and scoring of tables and odd rows against plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tracewright.llm import attention as A
from tracewright.llm import bpe, common, lm_scoring

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


def small_model(precise=False):
    model = A.Model.fresh(A.Vocabulary.of(np.array([5, 0, 3, 9, 1, 1, 2, 0, 4])))
    rng = np.random.default_rng(2)
    for name, w in model.weights.items():
        w = np.where(w < -1e8, w, w + rng.normal(size=w.shape) * 0.3)
        model.weights[name] = w if precise else w.astype(np.float32)
    return model


def steps(rng, lengths):
    texts = [rng.integers(0, 8, n) for n in lengths]
    return texts, A.pieces_to_steps([(t, True) for t in texts], 2)


def plain_log_probability(model, text, end):
    """One id after the other."""
    w, size = model.weights, model.vocabulary.class_size
    x, out = [end, *text[:-1]], []
    for i, y in enumerate(text):
        first = max(0, (i // A.BLOCK - 1) * A.BLOCK)
        e = [w["embed"][t] for t in x]
        q = e[i] @ w["query"]
        logits = np.array([q @ (e[j] @ w["key"]) / math.sqrt(A.DIM) + w["near"][i - j] for j in range(first, i + 1)])
        p = np.exp(logits - logits.max())
        h = e[i] + sum(a * (e[j] @ w["value"]) for a, j in zip(p / p.sum(), range(first, i + 1)))
        h = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        z, u = h @ w["classes"] + w["class_bias"], w["items"][y // size] @ h + w["item_bias"][y // size]
        unseen = model.vocabulary.unseen if y == len(model.vocabulary.counts) - 1 else 1
        out.append(z[y // size] - np.log(np.exp(z).sum()) + u[y % size] - np.log(np.exp(u).sum()) - math.log(unseen))
    return out


@pytest.mark.parametrize("safe", [A.SAFE, 0.0])
def test_windows_score_every_id_once_as_a_plain_loop(monkeypatch, safe):
    monkeypatch.setattr(A, "SAFE", safe)  # 0: exponentials are shifted
    model = small_model().prepared()
    texts, (x, y, start) = steps(np.random.default_rng(3), [1, 40, 5, 16, 100, 1, 33])
    whole = A.log_probabilities(model, x, y, start)[y >= 0]
    assert np.allclose(whole, np.concatenate([plain_log_probability(model, t, 2) for t in texts]), atol=1e-4)
    monkeypatch.setattr(A, "CHUNK", 4 * A.BLOCK)
    monkeypatch.setattr(A, "STORE", 12 * A.BLOCK)  # however the stream is cut, the windows reach over the cuts
    assert np.allclose(A.log_probabilities(model, x, y, start)[y >= 0], whole, atol=1e-5)


def test_probabilities_sum_to_one():
    model = small_model().prepared()
    context = np.array([3, 1, 4, 1, 5, 2])
    total = 0.0
    for y in range(len(model.vocabulary.counts)):
        x, t, s = A.pieces_to_steps([(np.append(context, y), True)], 2)
        unseen = model.vocabulary.unseen if y == len(model.vocabulary.counts) - 1 else 1
        total += unseen * math.exp(A.log_probabilities(model, x, t, s)[6])
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_gradients_are_difference_quotients():
    model, rng = small_model(precise=True), np.random.default_rng(4)
    x, y = rng.integers(0, 8, 64), rng.integers(-1, 8, 64)
    start = np.where(np.arange(64) < 23, 0, np.where(np.arange(64) < 40, 23, 40))
    _, gradients = A.loss_and_gradients(model, x, y, start)
    for name, w in model.weights.items():
        for _ in range(5):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            if w[i] < -1e8:
                continue
            old, sides = w[i], []
            for change in (1e-5, -1e-5):
                w[i] = old + change
                sides.append(A.loss_and_gradients(model, x, y, start)[0])
            w[i] = old
            assert math.isclose((sides[0] - sides[1]) / 2e-5, gradients[name][i], abs_tol=2e-6), name


def test_training_learns_what_precedes():
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(300):  # after 1 comes 2, after 3 comes 4; the last id repeats the first
        first = int(rng.integers(5, 8))
        texts.append(np.array([first, *[v for k in rng.integers(0, 2, 4) for v in ((1, 2), (3, 4))[k]], first]))
    model = A.Model.fresh(A.Vocabulary.of(np.bincount(np.concatenate(texts), minlength=9)))
    place = model.vocabulary.place
    lists = [(place[t], True) for t in texts]
    x, y, s = A.pieces_to_steps(lists, int(place[0]))
    trained = A.train(model, x, y, s, 200, 0.03).prepared()
    logs = A.log_probabilities(trained, x, y, s)[y >= 0].reshape(300, 10)
    assert np.exp(logs[:, 2:9:2]).mean() > 0.95 and np.exp(logs[:, 9]).mean() > 0.6 and A.log_probabilities(model.prepared(), x, y, s)[y >= 0].mean() < logs.mean() - 0.8


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_base(docs):
    counts = Counter(w for i, t in docs if not held(i) for w in plain_words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in ((i, plain_words(t)) for i, t in docs)]


ODD = [
    (1, "The cat sat. The CAT\tsat\x0bon the mat"), (1, "The cat sat. The CAT\tsat\x0bon the mat"), (2, None), (3, ""), (4, " \n\t "), (None, "É é the half ½"),
    (5, "x" * 5000 + " " + "y" * 64 + " " + "z" * 65 + " the"), (6, "x" * 5000 + " " + "z" * 65), (7, "lorem ipsum dolor " * 30_000), (11, "\x85 \xa0 the"), *[(i, f"word{i} the cat {i % 3}") for i in range(20, 60)],
]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 3])
def test_base_scores_and_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)  # 3: all words but a third of all tokens go the way of rare ones
    df = spark.createDataFrame([(*r, 1, "w", 2) for r in ODD], "doc_id long, text string, slice int, word string, c long").repartition(3)
    rows = sorted(lm_scoring.score(df, VOCAB, trained=frequent != 3).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    for got, want in zip(rows, sorted(plain_base(ODD), key=lambda r: (str(r[0]), r[2])), strict=True):
        assert tuple(got)[:5] == want[:5] and math.isclose(got.base_score, want[5], rel_tol=1e-9) and got.score < 0
    same = [r.score for r in rows if r.doc_id == 1]
    assert len(same) == 2 and math.isclose(*same, rel_tol=1e-5)


def test_empty_tables_and_tables_without_training_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert lm_scoring.score(df.limit(0), VOCAB).count() == 0
    i = next(i for i in range(1000) if held(i))
    rows = lm_scoring.score(spark.createDataFrame([(i, "a b"), (i, None)], "doc_id long, text string"), VOCAB).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(math.isclose(r.score, -math.log10(50257) * r.n_tokens, rel_tol=1e-6) for r in rows)


def test_the_score_is_the_sum_over_the_subword_ids(spark, sf):
    """Counts alone (an untrained model still reads its context, so weights are set to zero) give a sum that plain counts repeat."""
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    merges = bpe.Merges(bpe.read_ranks(open(VOCAB, "rb").read()))
    ids = {i: np.concatenate([*[np.frombuffer(b, "<u4") for b in merges.encode_pieces([b" " + w.encode() for w in plain_words(t)[:-1]])], [50256]]) for i, t in docs}
    counts = np.zeros(50257)
    for i, _ in docs:
        if not held(i):
            np.add.at(counts, ids[i], 1)
    flat = A.Model.fresh(A.Vocabulary.of(counts))
    for name in ("classes", "items"):
        flat.weights[name] *= 0
    n, unseen = counts.sum() + 1, (counts == 0).sum()
    logs = np.where(counts > 0, np.log(np.maximum(counts, 1) / n), np.log(1 / (n * unseen)))
    for i, _ in docs[:40]:
        x, y, s = A.pieces_to_steps([(flat.vocabulary.place[ids[i]], True)], int(flat.vocabulary.place[50256]))
        assert math.isclose(A.log_probabilities(flat.prepared(), x, y, s).sum(), logs[ids[i]].sum(), rel_tol=1e-5)


def test_held_out_texts_are_likelier_than_under_word_counts(spark):
    rows = [r for r in lm_scoring.op13_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 150 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_id_of_all_training_rows_is_trained_on(spark):
    """not only those of a sample."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 90))) for i in range(200)] + [(200, None), (201, ""), (202, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranks = spark.sparkContext.broadcast(open(VOCAB, "rb").read())
    counts = lm_scoring.id_counts(lm_scoring.word_counts(df), ranks, 50257, 50256)
    found = lm_scoring.task_weights(df, A.Model.fresh(A.Vocabulary.of(counts)), ranks, 50256).collect()
    assert sum(r.n for r in found) == counts.sum() > 10_000
    assert len({bytes(r.weights) for r in found if r.n}) == sum(r.n > 0 for r in found) > 1


def test_words_are_encoded_by_the_library_as_by_matrices():
    words = ["the", "É", "half", "½", "\x85", "\xa0", "\u2028x", "<|endoftext|>", "a" * 256, "\U0001f600" * 60, "'s", "0123"]
    pieces = lm_scoring.Pieces(open(VOCAB, "rb").read(), 50256)
    blobs = [w.encode() for w in words]
    for got, want in zip(pieces.encode(blobs), pieces.encode_long(blobs), strict=True):
        assert got.tolist() == want.tolist()
    numbers, new = pieces.of([b"\xff\xfe", b"the"])
    assert pieces.ids(numbers).tolist() == pieces.encode_long([b"\xff\xfe", b"the"])[0].tolist() and len(new) == 2
