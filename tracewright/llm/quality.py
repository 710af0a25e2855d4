"""Quality verdicts: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Character n-grams (2 and 4 bytes) and words (one and two) are hashed into one weight table. A text's features are the
shares of its n-grams of each family, so length does not count. Weights are trained by minibatch Adagrad on a bounded
sample of labelled rows (`per_class` of each label, documented bound; default 1500 each); two thirds of it fit the
weights, one third the calibration of the logit to a probability. Texts are scored in Arrow slices, all positions
of a slice at once.

Before the verdict come base figures and two base rules (fewer than 50 words; over half of the words in repeated
3-word windows). Words are the runs of bytes other than space and \\t..\\r.

Defined cases: null, empty and word-less texts have no words, fail the base rules and are not kept; repeated rows get
equal rows; without labelled rows of both classes the base rules alone decide; null ids are judged like others; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .samples import platt, row_sums, sample_ids, sampled_rows, sparse_rows

BITS = 16
CHAR_SIZES = (2, 4)
PER_CLASS = (1500, 1500)
#: Bytes of a slice: its arrays have up to sixty times as many.
SLICE_BYTES = 1 << 20
#: A text is kept if it is good with this probability at least.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
FAMILIES = len(CHAR_SIZES) + 2


def _mix(h: np.ndarray, family: int) -> np.ndarray:
    h = (h + np.uint64(family)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


class Slice:
    """Texts of one slice as flat arrays: bytes, and words as numbers that are equal exactly for equal words."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        self.texts = texts
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        lists = [t.split() for t in texts]
        self.word_starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = list(chain.from_iterable(lists))
        numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.words = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        self.distinct = len(numbers)
        self.word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))

    def grams(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each family: bucket at each position, and the first and last-but-one position of each text."""
        out = []
        data, n = self.bytes.astype(np.uint64), len(self.bytes)
        h = np.zeros(n, np.uint64)
        for size in range(1, max(CHAR_SIZES) + 1):
            h = h << np.uint64(8)
            h[: max(0, n - size + 1)] |= data[size - 1 :]
            if size in CHAR_SIZES:
                first = self.byte_starts[:-1]
                out.append((_mix(h, size), first, np.maximum(first, self.byte_starts[1:] - size + 1)))
        h, first = self.word_hash[self.words], self.word_starts[:-1]
        out.append((_mix(h, 100), first, self.word_starts[1:]))
        pair = h * np.uint64(3)
        pair[:-1] += h[1:]
        out.append((_mix(pair, 200), first, np.maximum(first, self.word_starts[1:] - 1)))
        return out

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sparse shares of each text, families side by side."""
        grams, out = self.grams(), []
        for i in range(len(self.texts)):
            ids, vals = [], []
            for family, (bucket, a, b) in enumerate(grams):
                used, counts = np.unique(bucket[a[i] : b[i]], return_counts=True)
                ids.append(used + (family << BITS))
                vals.append(counts / max(1, b[i] - a[i]))
            out.append((np.concatenate(ids), np.concatenate(vals)))
        return out

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        total = np.full(len(self.texts), bias)
        for family, (bucket, a, b) in enumerate(self.grams()):
            sums = np.concatenate([[0.0], np.cumsum(weights[family << BITS : (family + 1) << BITS][bucket], dtype=np.float64)])
            total += (sums[b] - sums[a]) / np.maximum(1, b - a)
        return total

    def repeated_words(self) -> np.ndarray:
        """Words of each text inside 3-word windows that the text has twice or more."""
        n = len(self.words)
        text = np.repeat(np.arange(len(self.texts)), np.diff(self.word_starts))
        if n < 3:
            return np.zeros(len(self.texts), np.int64)
        inside = text[2:] == text[:-2]
        code, many = self.words[:-2], self.distinct
        for nxt in (self.words[1:-1], self.words[2:], text[2:]):  # numbers stay exact: they are renumbered before they could overflow
            code, many = self._renumbered(code, many)
            width = int(nxt.max()) + 1
            code, many = code * width + nxt, many * width
        code = code[inside]
        _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
        again = np.flatnonzero(inside)[counts[place] > 1]
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[again + k] = True
        return row_sums(covered.astype(np.float64), self.word_starts).round().astype(np.int64)

    @staticmethod
    def _renumbered(code: np.ndarray, many: int) -> tuple[np.ndarray, int]:
        if many < 1 << 32:
            return code, many
        used, place = np.unique(code, return_inverse=True)
        return place, len(used)

    def base(self) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        chars, symbols, lines = [], [], []
        for text in self.texts:
            solid = text.translate(None, BLANKS)
            chars.append(len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace")))
            symbols.append(len(solid) - len(solid.translate(None, SYMBOLS)))
            with_words = [x for x in text.split(b"\n") if x.strip(BLANKS)]
            lines.append(len(with_words) - len(set(with_words)))
        return [np.diff(self.word_starts), np.array(chars), np.array(symbols), np.array(lines), self.repeated_words()]


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    intercept: float = 40.0

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.intercept, -40, 40)))


def train(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, vals: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 1.0, decay: float = 1e-6, seed: int = 5) -> Model:
    """Logistic regression on two thirds of the rows, calibration on the rest."""
    size = FAMILIES << BITS
    weights, square = np.zeros(size), np.full(size, 1e-7)
    if not len(y) or y.min() == y.max():
        return Model(weights.astype(np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, rest = order[: 2 * len(y) // 3 or 1], order[2 * len(y) // 3 :]
    bias, bias_sq = 0.0, 1e-7
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            n = starts[rows + 1] - starts[rows]
            place = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            b, w = ids[place], vals[place]
            z = row_sums(weights[b] * w, np.concatenate([[0], np.cumsum(n)])) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
            grad = np.bincount(b, w * np.repeat(g, n), size) + decay * weights
            square += grad**2
            weights -= step * grad / np.sqrt(square)
            bias_sq += g.sum() ** 2
            bias -= step * g.sum() / np.sqrt(bias_sq)
    model = Model(weights.astype(np.float32), float(bias))
    logits = row_sums(weights[ids] * vals, starts) + bias
    check = rest if len(rest) and y[rest].min() < y[rest].max() else order
    model.slope, model.intercept = platt(logits[check], y[check])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = sample_ids(labels, label, lambda c: F.lit(True), per_class, id_col)
    return train(*sparse_rows(sampled_rows(docs, chosen, id_col, text_col), lambda: lambda texts: Slice(texts).features()))


def judge(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, base_failed, quality (probability of a good text) and kept, one row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of hash buckets: one megabyte

    def kernel():
        def step(batch):
            part, own = Slice(common.bytes_of(batch.column(1))), shared.value
            figures = part.base()
            failed = base_failed(figures[0], figures[4])
            p = own.probability(part.logits(own.weights, own.bias))
            return [batch.column(0), *figures, failed, p, ~failed & (p >= threshold)]

        return step

    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], schema, kernel, limit=SLICE_BYTES)


def kept_rows(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the rows that judge() does not keep."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        def step(texts):
            part, own = Slice(texts), shared.value
            failed = base_failed(np.diff(part.word_starts), part.repeated_words())
            return (~failed & (own.probability(part.logits(own.weights, own.bias)) >= threshold)).tolist()

        return step

    return common.keep_rows(df, text_col, kernel, SLICE_BYTES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, common.table(spark, sf_dir, "labels")))
