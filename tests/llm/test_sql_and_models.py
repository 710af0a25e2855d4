"""Corpus queries against their SQL, the registered word pieces against greedy matching, and both classifiers' training against plain loops."""

import collections
import time

import numpy as np
import pytest
from test_documents import greedy, words

from tracewright.llm import bpe, common, quality, queries, samples, toxicity, wordpiece



@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    result = c.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(found.columns)
    want = collections.Counter(result.fetchall())
    assert collections.Counter(map(tuple, found.select(*names).collect())) == want and len(want) > 200


def test_registered_word_pieces_are_greedy_longest_matches(spark, sf):
    import public_tokenizers as P

    initial, continuing = wordpiece.pieces_of_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    known: dict[str, int] = {}
    want = {}
    for r in common.table(spark, sf, "documents").collect():
        n = 0
        for w in words(r.text):
            if w not in known:
                known[w] = greedy(w.encode(), initial, continuing)
            n += known[w]
        want[r.doc_id] = (len(words(r.text)), n)
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in queries.QUERIES["op2_token_counts"](spark, sf).collect()} == want
    assert bpe.NO_RANK > len(initial)


TEXTS = ["you are a total idiot and a clown", "the sea is calm and the sky is clear", "what an idiotic clownish thing", "we sail the calm sea", "stupid stupid loser", "clear sky over the calm bay", "", "a"] * 4
LABELS = np.array([1, 0, 1, 0, 1, 0, 0, 0] * 4, float)


def flat(features):
    return np.concatenate([[0], np.cumsum([len(i) for i, _ in features])]), np.concatenate([i for i, _ in features]), np.concatenate([v for _, v in features])


def test_subword_bags_by_hand():
    for word in (b"idiot", b"a", b"sky", b"clownish"):  # its n-grams with boundary marks, and itself
        assert len(toxicity.subwords([word])[1]) == 1 + sum(max(0, len(word) + 2 - n + 1) for n in toxicity.SIZES)
    many = toxicity.subwords([b"idiot", b"idiots"])[1]
    assert len(set(many[:8].tolist()) & set(many[8:].tolist())) >= 5  # an ending leaves most buckets shared
    for text, (ids, vals) in zip(TEXTS, toxicity.document_features([t.encode() for t in TEXTS])):
        want = collections.Counter()
        w = toxicity.words_of(text.encode())
        for word in w:
            own = toxicity.subwords([word])[1]
            for b in own.tolist():
                want[b] += 1 / len(own) / len(w)
        assert dict(zip(ids.tolist(), vals)) == pytest.approx(dict(want))


def test_toxicity_training_equals_a_plain_loop():
    features = toxicity.document_features([t.encode() for t in TEXTS])
    epochs, batch, rate, seed = 4, 8, 0.5, 7
    model = toxicity.train(LABELS, *flat(features), epochs=epochs, batch=batch, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (toxicity.BUCKETS, toxicity.DIM))
    layer, bias = rng.uniform(-1, 1, (toxicity.DIM, 2)), np.zeros(2)
    used = {b for ids, _ in features for b in ids.tolist()}
    vectors = {b: emb[b].copy() for b in used}
    squares, layer_sq, bias_sq = dict.fromkeys(used, 1e-8), np.full((toxicity.DIM, 2), 1e-8), np.full(2, 1e-8)

    def loss(rows, vectors, layer, bias):
        total = 0.0
        for i in rows:
            hidden = sum((v * vectors[b] for b, v in zip(features[i][0].tolist(), features[i][1])), np.zeros(toxicity.DIM))
            z = hidden @ layer + bias
            total -= z[int(LABELS[i])] - np.log(np.exp(z).sum())
        return total / len(rows)

    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs) + 0.01, rng.permutation(len(LABELS))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            g_vec, g_layer, g_bias = {}, np.zeros_like(layer), np.zeros(2)
            for i in rows:
                ids, vals = features[i]
                hidden = sum((v * vectors[b] for b, v in zip(ids.tolist(), vals)), np.zeros(toxicity.DIM))
                z = hidden @ layer + bias
                p = np.exp(z) / np.exp(z).sum()
                p[int(LABELS[i])] -= 1
                p /= len(rows)
                g_layer += np.outer(hidden, p)
                g_bias += p
                for b, v in zip(ids.tolist(), vals):
                    g_vec[b] = g_vec.get(b, 0) + v * (layer @ p)
            if epoch == 0 and at == 0:  # the gradients are those of the loss
                for b in list(g_vec)[:5]:
                    for k in range(toxicity.DIM):
                        up, down = ({**vectors, b: vectors[b] + e * np.eye(toxicity.DIM)[k]} for e in (1e-5, -1e-5))
                        assert (loss(rows, up, layer, bias) - loss(rows, down, layer, bias)) / 2e-5 == pytest.approx(g_vec[b][k], abs=1e-7)
                up, down = (layer + e * np.eye(toxicity.DIM)[:, [0]] * [1, 0] for e in (1e-5, -1e-5))
                assert (loss(rows, vectors, up, bias) - loss(rows, vectors, down, bias)) / 2e-5 == pytest.approx(g_layer[0, 0], abs=1e-7)
            layer_sq += g_layer**2
            layer = layer - step * g_layer / np.sqrt(layer_sq)
            bias_sq += g_bias**2
            bias = bias - step * g_bias / np.sqrt(bias_sq)
            for b, g in g_vec.items():
                squares[b] += (g**2).mean()
                vectors[b] = vectors[b] - step * g / np.sqrt(squares[b])
    values = {b: v @ (layer[:, 1] - layer[:, 0]) for b, v in vectors.items()}
    assert {b: float(model.value[b]) for b in used} == pytest.approx(values, rel=1e-4, abs=1e-5)
    assert model.offset == pytest.approx(bias[1] - bias[0])


def test_rare_buckets_are_left_out():
    features = toxicity.document_features([t.encode() for t in TEXTS])
    kept = toxicity.frequent(LABELS, *flat(features))
    have = collections.Counter(b for label, (own, _) in zip(LABELS, features) if label for b in own.tolist())
    least = max(1, int(LABELS.sum()) // 16)
    for i, (own, weights) in enumerate(features):
        want = {b: v for b, v in zip(own.tolist(), weights) if have[b] >= least}
        assert dict(zip(kept[2][kept[1][i] : kept[1][i + 1]].tolist(), kept[3][kept[1][i] : kept[1][i + 1]])) == want


def test_most_toxic_passage_by_hand():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25)
    for n in (0, 1, 5, 16, 17, 60):
        text = " ".join(rng.choice(["one", "two", "three", "four", "five"], n)).encode()
        read = toxicity.words_of(text)
        own = [float(np.mean(model.value[toxicity.subwords([w])[1]].astype(float))) for w in read]
        kept = [s for i, s in enumerate(own) if i == 0 or read[i] != read[i - 1]]
        parts = [kept[i : i + toxicity.PASSAGE] for i in range(max(1, len(kept) - toxicity.PASSAGE + 1))]
        want = 0.25 + (max(sum(p) / len(p) for p in parts) if kept else 0)
        best = toxicity.words_of(toxicity.Scorer(model).most_toxic(text))
        if kept:
            assert 0.25 + np.mean([float(np.mean(model.value[toxicity.subwords([w])[1]].astype(float))) for w in best]) == pytest.approx(want, abs=1e-6) and len(best) <= toxicity.PASSAGE
        assert toxicity.Scorer(model)([text])[0] == pytest.approx(want, abs=1e-9)


def test_neutral_words_dilute_a_passage():
    """Words whose value is equal are still words of their own, as long as they differ."""
    value = np.zeros(toxicity.BUCKETS, np.float32)
    value[toxicity.subwords([b"idiot"])[1]] = 4.0
    score = toxicity.Scorer(toxicity.Model(value, 0.0))
    neutral = [f"w{i}q".encode() for i in range(300)]
    around = lambda n: score([b" ".join([*neutral[:n], b"idiot", *neutral[150 : 150 + n]])])[0]
    assert around(3) == pytest.approx(4 / 7, abs=1e-3) and around(15) == around(150) == pytest.approx(4 / toxicity.PASSAGE, abs=1e-3)
    assert score([b"idiot " * 9])[0] == pytest.approx(4) and score([b" ".join(neutral)])[0] == pytest.approx(0, abs=1e-3)


def test_long_words_are_counted_as_short_ones_are(monkeypatch):
    initial, continuing = {b"a", b"ab", b"abcd", b"the"}, {b"a", b"b", b"c", b"cd", b"bcx", b"d", b"x"}
    matcher, rng = wordpiece.LinearMatcher(initial, continuing), np.random.default_rng(3)
    some = [bytes(rng.choice(list(b"abcdx"), rng.integers(0, 40)).tolist()) for _ in range(3000)] + [b"a" * 5000, b"the" * 700, b"a" + b"bcx" * 500]
    monkeypatch.setattr(wordpiece, "LONG", 7)
    assert matcher.counts(some).tolist() == [greedy(w, initial, continuing) for w in some]
    monkeypatch.undo()
    start = time.time()
    assert matcher.counts([b"ab" * 500_000, *some[:100]])[0] == greedy(b"ab" * 20, initial, continuing) + 2 * (500_000 - 20) and time.time() - start < 5


def test_quality_features_training_and_verdict_by_hand():
    texts = [t.encode() for t in TEXTS]
    part = quality.Slice(texts)
    features = part.features()
    for i, (ids, vals) in enumerate(features):  # shares of each family add up to one
        for family in range(quality.FAMILIES):
            inside = vals[ids >> quality.BITS == family]
            grams = len(texts[i]) - quality.CHAR_SIZES[family] + 1 if family < 2 else len(texts[i].split()) - (family - 2)
            assert inside.sum() == pytest.approx(1 if grams > 0 else 0) and len(inside) <= max(0, grams)
    epochs, batch, rate, decay, seed = 3, 8, 1.0, 1e-6, 5
    model = quality.train(LABELS, *flat(features), epochs=epochs, batch=batch, rate=rate, decay=decay, seed=seed)
    size = quality.FAMILIES << quality.BITS
    weights, square, bias, bias_sq = np.zeros(size), np.full(size, 1e-7), 0.0, 1e-7
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(LABELS))
    fit = order[: 2 * len(LABELS) // 3]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows, grad, g_bias = fit[at : at + batch], decay * weights, 0.0
            for i in rows:
                ids, vals = features[i]
                g = (1 / (1 + np.exp(-(weights[ids] @ vals + bias))) - LABELS[i]) / len(rows)
                grad[ids] += g * vals
                g_bias += g
            square += grad**2
            weights -= step * grad / np.sqrt(square)
            bias_sq += g_bias**2
            bias -= step * g_bias / np.sqrt(bias_sq)
    assert np.allclose(model.weights, weights, atol=1e-4) and model.bias == pytest.approx(bias, abs=1e-6)
    logits = part.logits(model.weights, model.bias)
    assert logits == pytest.approx([model.weights[i].astype(float) @ v + model.bias for i, v in features], abs=1e-5)
    p = model.probability(logits)
    assert p == pytest.approx(1 / (1 + np.exp(-(model.slope * logits + model.intercept))))
    slope, intercept = samples.platt(logits, LABELS)
    high, low = (LABELS.sum() + 1) / (LABELS.sum() + 2), 1 / ((1 - LABELS).sum() + 2)

    def loss(a, b):
        t, q = np.where(LABELS > 0, high, low), 1 / (1 + np.exp(-(a * logits + b)))
        return -(t * np.log(q) + (1 - t) * np.log(1 - q)).sum()

    assert all(loss(slope, intercept) <= loss(slope * (1 + e), intercept + d) + 1e-2 for e in (-0.1, 0, 0.1) for d in (-0.3, 0, 0.3))
