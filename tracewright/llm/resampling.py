"""Importance resampling towards a target distribution: the documents that look most like the `benchmark` texts, with Gumbel noise.

Features are hashed runs of one to three words. `TARGET` and corpus counts of their buckets give each bucket a gain
(a scaled log ratio); a document's weight is the sum of its features' gains, and its score adds seeded Gumbel noise, so that
the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Buckets are arrays, not strings: a task computes the CRC of each distinct word once, and the CRC of a run from those of its
words, because a CRC continues over appended bytes by a linear map that depends only on their number.

The cutoff is found without sorting the corpus. A mergeable quantile sketch gives a bracket around the wanted place; one
exact count of the rows above and inside validates the bracket or widens it; only the rows inside are sorted, in ranges, to
locate the last row that is drawn. Drawn rows are then ranked in ranges, whose sizes are added.

Defined cases: null and empty texts have no features, weight 0, and are never drawn (under `least_words` words); repeated rows
are rows of their own, each with the score of its id; a null id is hashed as an empty one and comes first among equal scores; without
target texts all t are 0; ties go to the smaller id, then in the order of the written rows; other columns are ignored, whatever their names;
an empty table gives an empty result. Texts and words of any length are taken whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, ORDER = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
#: Half the width of the first bracket, as a share of the rows, and the sketch's accuracy.
MARGIN, ACCURACY = 0.002, 10_000
#: Most words of a task's table; a full table is emptied.
CACHE_WORDS = 400_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and bytes over 127."""
    return text.translate(_FOLD).split()


class Crc:
    """CRC-32 of appended byte strings, for arrays: shift(c, n) is what c becomes before the CRC of n more bytes is added."""

    SHORT = 64

    def __init__(self):
        one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        step = one ^ one[0]  # the linear part
        every = np.arange(256, dtype=np.uint32)
        table = np.stack([every << np.uint32(8 * j) for j in range(4)])  # of no byte
        short = [table]
        for _ in range(self.SHORT - 1):
            table = (table >> np.uint32(8)) ^ step[table & np.uint32(255)]
            short.append(table)
        self.short = np.stack(short)
        self.doubled = [self.short[self.SHORT // 2]]  # of 32, 64, 128 ... bytes

    def _power(self, k: int) -> np.ndarray:
        while len(self.doubled) <= k:
            last = self.doubled[-1]
            self.doubled.append(self._apply(last, last))
        return self.doubled[k]

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = table[0][c & np.uint32(255)]
        for j in (1, 2, 3):
            out = out ^ table[j][(c >> np.uint32(8 * j)) & np.uint32(255)]
        return out

    def shift(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        low = n % self.SHORT
        out = self.short[low, 0, c & np.uint32(255)]
        for j in (1, 2, 3):
            out ^= self.short[low, j, (c >> np.uint32(8 * j)) & np.uint32(255)]
        rest, k = n // self.SHORT, 1
        while rest.any():
            rows = np.flatnonzero(rest & 1)
            out[rows] = self._apply(self._power(k), out[rows])
            rest, k = rest >> 1, k + 1
        return out


class Featurizer:
    """texts -> (row of each feature, its bucket, words of each text); distinct words are hashed once in a task."""

    def __init__(self, buckets: int = BUCKETS, order: int = ORDER):
        self.crc, self.buckets, self.order = Crc(), np.uint32(buckets), order
        self._empty()

    def _empty(self):
        self.known: dict[bytes, int] = {}
        self.alone = self.spaced = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)

    def _add(self, words: list[bytes]) -> None:
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        n = len(words)
        self.alone = np.append(self.alone, np.fromiter(map(zlib.crc32, words), np.uint32, n))
        self.spaced = np.append(self.spaced, np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in words), np.uint32, n))
        self.lengths = np.append(self.lengths, np.fromiter(map(len, words), np.int64, n) + 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = [w for ws in lists for w in ws]
        if len(self.known) > CACHE_WORDS:
            self._empty()
        new = list(set(flat) - self.known.keys())
        if new:
            self._add(new)
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(lists)), sizes)
        c, rows, found = self.alone[ids], [row], [self.alone[ids] % self.buckets]
        for k in range(1, self.order):  # runs of k + 1 words: the last word appended to runs of k
            if len(ids) <= k:
                break
            c = self.crc.shift(c[:-1], self.lengths[ids[k:]]) ^ self.spaced[ids[k:]]
            whole = row[k:] == row[:-k]
            rows.append(row[k:][whole])
            found.append(c[whole] % self.buckets)
        return np.concatenate(rows), np.concatenate(found).astype(np.int64), sizes


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts fall in each bucket; tasks send one total a bucket."""

    def run(batches):
        count, total = Featurizer(buckets, order), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch, 0):
                total += np.bincount(count(common.bytes_of(part.column(0)))[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = df.select(common.text_column(df, text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) for each bucket."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of each row of df, written to the shared folder."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = dict(df.dtypes)[id_col]

    def kernel():
        features = Featurizer(len(shared.value), order)

        def step(batch):
            row, bucket, sizes = features(common.bytes_of(batch.column(1)))
            running = np.zeros(batch.num_rows, np.int64)
            np.add.at(running, row, shared.value[bucket])
            return [batch.column(0), sizes, np.bincount(row, minlength=batch.num_rows), running]

        return step

    rows = common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], f"doc_id {kind}, n_words long, n_features long, weight long", kernel)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return common.written(rows.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "weighed")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with rank, 1 for the highest score: sorted in ranges, the sizes of the ranges before added. No range holds many equal scores, since ids and rows cut them."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = common.written(ranged.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside")).drop("at"), "ranked")
    sizes = sorted(ranged.groupBy("part").count().collect())  # one row for each range
    before = dict(zip([r[0] for r in sizes], np.cumsum([0, *[r[1] for r in sizes]]).tolist()))
    bases = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, base long")
    return ranged.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("inside") + 1).drop("part", "inside", "base")


def bracket(rows: DataFrame, wanted: int, n: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the row of place `wanted`, counted from the highest score, has a score from low to high, and `above` rows have a higher one than high.

    Sketched quantiles propose the bracket; exact counts of the rows above and inside accept it or say which side must give way."""
    under, over = margin, margin
    while True:
        shares = [min(1.0, max(0.0, 1 - wanted / n - under)), min(1.0, max(0.0, 1 - wanted / n + over))]
        low, high = rows.agg(F.percentile_approx("score", shares, accuracy)).first()[0]
        ends = rows.agg(F.min("score"), F.max("score")).first()
        low, high = ends[0] if shares[0] <= 0 else low, ends[1] if shares[1] >= 1 else high
        above, inside = rows.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score").between(low, high), 1))).first()
        if above < wanted <= above + inside:
            return low, high, above
        under, over = (max(8 * under, 1 / n), over) if wanted > above + inside else (under, max(8 * over, 1 / n))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, margin: float = MARGIN) -> DataFrame:
    """weighed() rows with rank: 1, 2, 3 ... for the drawn ones, else null."""
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.count()
    wanted = percent * n // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(fit, wanted, n, margin)
    last = _in_order(fit.where(F.col("score").between(low, high)).select("score", "doc_id", "row")).where(F.col("rank") == wanted - above).first()
    same = F.col("doc_id").eqNullSafe(F.lit(last.doc_id))
    sooner = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(last.doc_id))
    tied = (F.col("score") == last.score) & (F.coalesce(sooner, F.lit(False)) | same & (F.col("row") <= last.row))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last.score) | tied)
    return _in_order(rows.where(drawn)).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs; `percent` of those with enough words have a rank."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    return draw(weighed(docs, gain, seed, id_col, text_col), percent, least_words).drop("row")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC: it is folded over the bytes of each distinct run, by the usual table of 256 entries.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
  source AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
  d AS MATERIALIZED (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM source),
  f AS MATERIALIZED (SELECT side, rid, run, count(*) AS k FROM (SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM d) GROUP BY ALL),
  h AS (SELECT run, hex(encode(run)) AS x FROM (SELECT DISTINCT run FROM f)),
  b AS MATERIALIZED (SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
  n AS (SELECT bucket, sum(k) FILTER (side = 'd') AS s, sum(k) FILTER (side = 'b') AS t FROM f JOIN b USING (run) GROUP BY bucket),
  g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0)::DOUBLE + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
  w AS (SELECT rid, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM f JOIN b USING (run) JOIN g USING (bucket) WHERE side = 'd' GROUP BY rid),
  z AS (SELECT doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (rid) WHERE side = 'd'),
  r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM r"""
