"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hashed form and its hashed character n-grams (4 and 5 code units, with word-boundary marks);
its vector is the mean of the bag's embeddings, a passage's vector the mean of its words' vectors, and a softmax layer
reads that. Embeddings and layer are trained together in numpy (minibatches, Adagrad). Because the model is linear
in the embeddings, a trained model is one number per bucket; scoring needs one look-up per distinct word of a task.
Misspellings never seen share n-gram buckets, hence vectors, with the words they come from.

A document is scored by its most toxic passage: means are taken over all overlapping passages of `PASSAGE` words
(a shorter document is one passage), so a long document does not dilute an insult; a word repeated in a row counts
once there. The largest passage value is calibrated to a probability on
the training rows.

Training goes in two steps: on whole documents first, briefly, and then on the most toxic passage that this first model
finds in each document, so that an insult is not diluted by the text around it. Only buckets that occur in several toxic texts
are trained (a sixteenth of them, between one and `FREQUENT`): a name that stands in one toxic document says nothing.

Training reads at most `per_class` labelled rows (documented bound; default 2000 of label 0, 1000 of label 1) among rows whose
crc32(doc_id as text) mod 3 is not 1. Labels, language, source and id never enter a score.

Defined cases: null, empty and word-less texts get the model's value for an empty bag; repeated rows repeat their
score; a null doc_id is scored (held_out false); without rows of both classes every score is the neutral base rate;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .samples import platt, row_sums, sample_ids, sampled_rows, sparse_rows

BUCKETS = 1 << 17
SIZES = (4, 5)
DIM = 4
PASSAGE = 16
THRESHOLD = 0.7
#: Most training rows with label 0 and with label 1.
PER_CLASS = (2000, 1000)
#: Epochs of the first step, and the most toxic texts that a bucket must occur in.
FIRST_EPOCHS, FREQUENT = 8, 16
#: Most words of a task's score cache, and bytes of them; a full cache is emptied.
CACHE_WORDS, CACHE_BYTES = 400_000, 64 << 20
_BREAKS = bytes(32 if (b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128) and b != 39 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates them."""
    text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return text.translate(_BREAKS).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bucket ids) of the words' bags, words one after the other."""
    n = len(words)
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    ends = np.cumsum(lengths)
    power = np.uint64(0x100000001B3)
    owner = np.repeat(np.arange(n), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # code units up to the end of the word
    ids, owners = [], []
    h = np.zeros(len(data), np.uint64)
    for size in range(1, max(SIZES) + 1):
        shifted = np.zeros_like(data)
        shifted[: max(0, len(data) - size + 1)] = data[size - 1 :]
        h = h * power + shifted + np.uint64(1)
        if size in SIZES:
            ok = left >= size
            ids.append(_bucket(h[ok] + np.uint64(size)))
            owners.append(owner[ok])
    import xxhash

    ids.append(_bucket(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n)))
    owners.append(np.arange(n))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))]), ids[order]


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(47)).astype(np.int32)


def document_features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's average bag: weight of each bucket in the mean of the words' means."""
    out = []
    for text in texts:
        words, counts = np.unique(np.array(words_of(text), object), return_counts=True) if text else ([], [])
        if not len(words):
            out.append((np.zeros(0, np.int32), np.zeros(0)))
            continue
        starts, ids = subwords(list(words))
        sizes = np.diff(starts)
        weights = np.repeat(counts / counts.sum() / sizes, sizes)
        used, place = np.unique(ids, return_inverse=True)
        out.append((used, np.bincount(place, weights)))
    return out


@dataclass
class Model:
    """value[b]: what bucket b adds to the difference of the two logits; offset, slope, intercept: layer bias and calibration."""

    value: np.ndarray
    offset: float
    slope: float = 1.0
    intercept: float = 0.0

    def probability(self, passage: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * passage + self.intercept, -40, 40)))


def train(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, vals: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.5, seed: int = 7) -> Model:
    """Embeddings and softmax layer from sparse average bags."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    emb_sq, layer_sq, bias_sq = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    target = np.stack([1 - y, y], 1)
    trained = np.zeros(BUCKETS, bool)
    trained[ids] = True
    emb[~trained] = 0  # a bucket that no training text uses says nothing
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            n = starts[rows + 1] - starts[rows]
            place = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            row, b, w = np.repeat(np.arange(len(rows)), n), ids[place], vals[place]
            hidden = row_sums(emb[b] * w[:, None], np.concatenate([[0], np.cumsum(n)]))
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            down = g @ layer.T
            grad = np.stack([np.bincount(b, w * down[row, k], BUCKETS) for k in range(DIM)], 1)
            for value, square, change in ((layer, layer_sq, hidden.T @ g), (bias, bias_sq, g.sum(0))):
                square += change**2
                value -= step * change / np.sqrt(square)
            emb_sq += (grad**2).mean(1)
            emb -= grad * (step / np.sqrt(emb_sq))[:, None]
    return Model((emb @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def frequent(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, vals: np.ndarray) -> tuple:
    """(y, row starts, ids, values) without the buckets that too few toxic texts have."""
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    least = min(FREQUENT, max(1, int(y.sum()) // 16))
    keep = np.bincount(ids[y[row] == 1], minlength=BUCKETS)[ids] >= least
    return y, np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(y)))]), ids[keep], vals[keep]


class Scorer:
    """texts -> value of the most toxic passage; words are scored once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.values, self.held = np.zeros(0), 0

    def words(self, texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray]]:
        """Each text's words, without those that repeat the word before, and their numbers."""
        if len(self.numbers) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._empty()
        lists = [words_of(t) for t in texts]
        new = list(set(chain.from_iterable(lists)) - self.numbers.keys())
        if new:
            starts, ids = subwords(new)
            self.values = np.append(self.values, row_sums(self.model.value[ids].astype(np.float64), starts) / np.diff(starts))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.values)), strict=True))
            self.held += sum(map(len, new))
        return [(words, np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))) for words in lists]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.passage(self.values[numbers[_changes(numbers)]]) for _, numbers in self.words(texts)])

    def most_toxic(self, text: bytes) -> bytes:
        """The words of the most toxic passage."""
        [(words, numbers)] = self.words([text])
        kept = np.flatnonzero(_changes(numbers))
        if len(kept) > PASSAGE:
            total = np.concatenate([[0.0], np.cumsum(self.values[numbers[kept]])])
            at = int((total[PASSAGE:] - total[:-PASSAGE]).argmax())
            kept = kept[at : at + PASSAGE]
        return b" ".join(words[i] for i in kept)

    def passage(self, scores: np.ndarray) -> float:
        """The largest mean of PASSAGE words in a row, or the mean of a shorter text."""
        if not len(scores):
            return self.model.offset
        if len(scores) <= PASSAGE:
            return self.model.offset + float(scores.mean())
        total = np.concatenate([[0.0], np.cumsum(scores)])
        return self.model.offset + float((total[PASSAGE:] - total[:-PASSAGE]).max()) / PASSAGE


def _changes(numbers: np.ndarray) -> np.ndarray:
    """False where a word repeats the one before."""
    return np.concatenate([[True], numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, bool)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the bounded sample in two steps, then calibrate passage values of the same rows, scored once more as documents are."""
    chosen = sample_ids(labels, label, lambda c: ~held_out(c), per_class, id_col)
    rows = sampled_rows(docs, chosen, id_col, text_col)
    whole = sparse_rows(rows, lambda: document_features)
    y = whole[0]
    model = train(*frequent(*whole), epochs=FIRST_EPOCHS)
    if len(y) and y.min() < y.max():
        model = train(*frequent(*sparse_rows(most_toxic_passages(rows, model), lambda: document_features)))
        passages = passage_values(rows, model, ["y"]).collect()
        model.slope, model.intercept = platt(np.array([r.passage for r in passages]), np.array([r.y for r in passages], float))
    return model


def most_toxic_passages(rows: DataFrame, model: Model) -> DataFrame:
    """sampled_rows() with the most toxic passage of each text in its place."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def kernel():
        score = Scorer(shared.value)
        return lambda batch: [batch.column(0), [score.most_toxic(t).decode("utf-8", "replace") for t in common.bytes_of(batch.column(1))], batch.column(2)]

    return common.map_texts(rows, ["sample_id", "text", "y"], f"sample_id {dict(rows.dtypes)['sample_id']}, text string, y int", kernel)


def passage_values(df: DataFrame, model: Model, keys: list, text_col: str = "text") -> DataFrame:
    """The key columns and passage, the value of the most toxic passage."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one number per bucket: half a megabyte
    chosen = df.select(*keys, common.text_column(df, text_col))

    at = len(keys)

    def kernel():
        score = Scorer(shared.value)
        return lambda batch: [*batch.columns[:at], score(common.bytes_of(batch.column(at)))]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return common.map_texts(chosen, chosen.columns, f"{types}, passage double", kernel, text=at)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df."""
    rows = passage_values(df, model, [F.col(f"`{id_col}`").alias("doc_id")], text_col)
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("passage") * model.slope + model.intercept))
    rows = rows.select("doc_id", held_out("doc_id").alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the documents predicted toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        value = Scorer(shared.value)
        return lambda texts: (shared.value.probability(value(texts)) < threshold).tolist()

    return common.keep_rows(df, text_col, kernel)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
