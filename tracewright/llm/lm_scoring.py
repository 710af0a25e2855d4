"""Log probabilities of whole texts under a causal self-attention model of subword ids, beside those of word counts.

A text is its words with A-Z lowered, then one end. The base adds the smoothed logs of the words' shares in the training rows.
The model (attention.py) reads the subword ids of the same words, each with its leading space, and of the end: overlapping windows
score every id once, so the sum is the log probability of the whole text.

What is learned comes from all training rows, those whose crc32(doc_id as text) mod 5 is not 1:

* one pass counts words; the distinct words, encoded once each, give the counts of the subword ids, the model's biases;
* a start is made on the driver from some stretches of `STRETCH` words (`WARM_IDS` ids at most), from which all tasks set out alike; from
  there each task trains on every id of all its training rows once, and the tasks' weights are averaged in a tree, each by its number of ids.

Scoring reads every row once. Words that hold a 200,000th of all tokens or more, at most 200,000 of them, are broadcast with their
counts; all others leave a task as (word, rows), a row for each word and slice of text, meet their count in one join and
return to their slice as numbers. No join key thus holds more than a small share of all tokens.

Defined cases: null, empty and word-less texts are the end alone; a null id is training text; repeated rows count and are scored as often
as they occur; without training rows N and V are 0 and the model spreads evenly; words of any length are taken whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, common
from .bpe import Merges, _file_bytes, read_ranks

FOLDS, HELD = 5, 1
STRETCH = 64
#: The start reads at most so many ids, at least three times and at most eight, so that small tables take as many steps.
WARM_IDS, WARM_EPOCHS, WARM_RATE = 1 << 21, (3, 8), 0.03
#: The rate of a task's first step, the steps after which it has halved, and ids of a step.
TASK_RATE, TASK_STEPS, TASK_BATCH = 0.006, 64, 1 << 14
#: A word of at least one in so many tokens is frequent.
FREQUENT = 200_000
#: Bytes of text that a task takes at once.
SLICE_BYTES = 2 << 20
#: Bytes of a word that the library encodes.
LONG = 256
#: Most words of a task's tables, and bytes of them; full tables are emptied.
CACHE_WORDS, CACHE_BYTES = 500_000, 48 << 20
FAN_IN = 16
END = b""


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """The words in order, A-Z lowered, and the end."""
    words = text.lower().split()
    words.append(END)
    return words


class _Numbers(dict):
    """word -> its number; a new word gets the next number and is noted."""

    def __init__(self):
        super().__init__({END: 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Pieces:
    """Subword ids of words, one flat array; distinct words are encoded together when they are first met."""

    def __init__(self, ranks: bytes, end_id: int):
        found = read_ranks(ranks)
        self.merges, self.end_id, self.line = Merges(found), end_id, found[b"\n"]
        self.library = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=found, special_tokens={})
        self.clear()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each after a space, one word after the other; how many each has). Words hold no line feed, which stands between them."""
        text = b"".join(b" %b\n" % w for w in words).decode()
        ids = self.library.encode_to_numpy(text, disallowed_special=())
        ends = np.flatnonzero(ids == self.line)
        return ids[ids != self.line].astype(np.int32), np.diff(ends, prepend=-1) - 1

    def encode_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by matrices: the library takes the square of the time for long words."""
        blobs = self.merges.encode_pieces([b" " + w for w in words], "<u4")
        return np.frombuffer(b"".join(blobs), "<u4").astype(np.int32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4

    def clear(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        self.flat, self.sizes, self.starts = np.array([self.end_id], np.int32), np.ones(1, np.int64), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.numbers) > CACHE_WORDS or self.held > CACHE_BYTES

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(the words' numbers, the words that are new, in the order of their numbers)."""
        numbers = np.array(list(map(self.numbers.__getitem__, words)), np.int64)
        new, self.numbers.new = self.numbers.new, []
        if new:
            try:
                ids, sizes = self.encode_long(new) if max(map(len, new)) > LONG else self.encode(new)
            except UnicodeDecodeError:  # the library takes text only
                ids, sizes = self.encode_long(new)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.flat = np.append(self.flat, ids)
            self.held += sum(map(len, new)) + 4 * int(sizes.sum())
        return numbers, new

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words one after the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c: how often each word and the end occur in all rows, written."""

    def run(batches):
        had: Counter[bytes] = Counter()
        for batch in batches:
            for part in common.slices(batch, 0, SLICE_BYTES):
                for text in common.bytes_of(part.column(0)):
                    had.update(words_of(text))
                if len(had) > CACHE_WORDS:
                    yield from rows(had)
                    had = Counter()
        yield from rows(had)

    def rows(had):
        words, counts = list(had), list(had.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "c"])

    parts = training.select(common.text_column(training, text_col)).mapInArrow(run, "word binary, c long")
    return common.written(parts.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def id_counts(words: DataFrame, ranks, size: int, end_id: int) -> np.ndarray:
    """How often each subword id occurs in the counted words; every distinct word is encoded once."""

    def run(batches):
        pieces, total = Pieces(ranks.value, end_id), np.zeros(size, np.int64)
        for batch in batches:
            for part in common.slices(batch, 0):
                if pieces.full():
                    pieces.clear()
                texts, counts = part.column(0).to_pylist(), part.column(1).to_numpy()
                numbers, _ = pieces.of(texts)
                np.add.at(total, pieces.ids(numbers), np.repeat(counts, pieces.sizes[numbers]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(size)
    for r in words.select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def stretches(texts: list[bytes], row_hashes: list[int], share: int) -> list[tuple[list[bytes], bool]]:
    """The chosen stretches of the texts; True marks one that begins its text."""
    out = []
    for text, h in zip(texts, row_hashes, strict=True):
        words = words_of(text)
        places = np.arange(-(-len(words) // STRETCH), dtype=np.uint64)
        mixed = (places * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(h & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)
        for k in np.flatnonzero(mixed % np.uint64(share) == 0).tolist():
            out.append((words[max(0, k * STRETCH - 1) : (k + 1) * STRETCH], k == 0))
    return out


def some_ids(training: DataFrame, ranks, vocabulary: attention.Vocabulary, share: int, row_share: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stretches that a hash chooses for the start, as places of subword ids."""
    row_hash = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col("text"))
    place = training.sparkSession.sparkContext.broadcast(vocabulary.place)

    def run(batches):
        pieces = Pieces(ranks.value, end_id)
        for batch in batches:
            for part in common.slices(batch, 0):
                chosen = stretches(common.bytes_of(part.column(0)), part.column(1).to_pylist(), share)
                if pieces.full():
                    pieces.clear()
                pieces.of([w for words, _ in chosen for w in words])  # new words are encoded together
                found = [(place.value[pieces.ids(pieces.of(words)[0])], begins) for words, begins in chosen]
                hashes = [int(hash_of(p)) for p, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([b for _, b in found], pa.bool_()), pa.array(hashes, pa.int64())], ["places", "begins", "hash"])

    rows = training.select(F.coalesce(common.text_column(training, text_col), F.lit("")).alias("text"), F.col(f"`{id_col}`"))
    rows = rows.select("text", row_hash.alias("row_hash"))
    return rows.where(F.pmod("row_hash", F.lit(row_share)) == 0).mapInArrow(run, "places binary, begins boolean, hash long")  # texts of other rows do not reach Python


def hash_of(places: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(places.tobytes()) >> 1


def task_weights(training: DataFrame, model: attention.Model, ranks, end_id: int, text_col: str = "text") -> DataFrame:
    """weights, n: what each task makes of the model by training on the n ids of all its rows, slice by slice."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces, trainer, rng = Pieces(ranks.value, end_id), attention.Trainer(shared.value), np.random.default_rng(5)
        for batch in batches:
            for part in common.slices(batch, 0, SLICE_BYTES):
                if pieces.full():
                    pieces.clear()
                (x, y, start, _), *_ = laid_out(pieces, shared.value.vocabulary.place, [words_of(t) for t in common.bytes_of(part.column(0))])
                steps = attention.batches(x, y, start, TASK_BATCH)
                for k in rng.permutation(len(steps)):
                    trainer.step(*steps[k], TASK_RATE / (1 + trainer.steps / TASK_STEPS))
        blob = trainer.model.flat().tobytes() if trainer.ids else b""
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([float(trainer.ids)])], ["weights", "n"])

    return training.select(common.text_column(training, text_col)).mapInArrow(run, "weights binary, n double")


def fit(training: DataFrame, counts: np.ndarray, ranks, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> attention.Model:
    """The start on the driver, then one round of all tasks over all training rows, averaged."""
    vocabulary = attention.Vocabulary.of(counts)
    model = attention.Model.fresh(vocabulary)
    total = int(counts.sum())
    if not total:
        return model
    end = int(vocabulary.place[end_id])
    warm_share = max(1, -(-total // WARM_IDS))  # of rows and stretches together
    warm_rows = max(1, int(warm_share**0.5))
    some = some_ids(training, ranks, vocabulary, -(-warm_share // warm_rows), warm_rows, end_id, id_col, text_col)
    picked = some.orderBy("hash", "begins").limit(4 * WARM_IDS // STRETCH).collect()  # about what was chosen; a bound for skewed rows
    lists, n = [], 0
    for r in picked:
        p = np.frombuffer(r.places, "<i4")
        if n + len(p) > WARM_IDS * 5 // 4:
            break
        lists.append((p, r.begins))
        n += len(p)
    epochs = min(WARM_EPOCHS[1], max(WARM_EPOCHS[0], WARM_EPOCHS[0] * WARM_IDS // max(1, n)))
    model = attention.train(model, *attention.pieces_to_steps(lists, end), epochs, WARM_RATE)
    def average(key, table):
        total, n = 0.0, 0.0
        for blob, k in zip(table.column("weights").to_pylist(), table.column("n").to_pylist(), strict=True):
            if k:
                total, n = total + k * np.frombuffer(blob, np.float32).astype(float), n + k
        blob = (total / n).astype(np.float32).tobytes() if n else b""
        return pa.table({"weights": pa.array([blob], pa.binary()), "n": pa.array([n]), "node": pa.array([key[0].as_py() // FAN_IN], pa.int64())})

    parts = task_weights(training, model, ranks, end_id, text_col)
    parts = common.written(parts.withColumn("node", F.shiftright(F.monotonically_increasing_id(), 33) * 1), "task-weights")
    count = int(parts.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]) + 1
    parts = parts.withColumn("node", F.floor(F.col("node") / FAN_IN))
    while count > 1:
        parts = parts.groupBy("node").applyInArrow(average, "weights binary, n double, node long")
        count = -(-count // FAN_IN)
    last = [r for r in parts.collect() if r.n]
    return model.with_flat(np.frombuffer(last[0].weights, np.float32)) if last else model


def laid_out(pieces: Pieces, place: np.ndarray, lists: list[list[bytes]]):
    """(attention.stream() of whole texts, given as their words; the numbers of all words and the text that each is of, the new words, the texts'
    numbers of words and of ids)."""
    numbers, new = pieces.of([w for words in lists for w in words])
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    row = np.repeat(np.arange(len(lists)), sizes)
    y = place[pieces.ids(numbers)].astype(np.int64)
    lengths = np.bincount(row, pieces.sizes[numbers], len(sizes)).astype(np.int64)  # one at least
    x = np.roll(y, 1)
    x[np.cumsum(lengths) - lengths] = place[pieces.end_id]
    return attention.stream(x, y, lengths), numbers, row, new, sizes, lengths


def score(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", trained: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; an untrained model knows the ids' counts alone."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_file_bytes(vocab_path))
    end_id = max(read_ranks(ranks.value).values()) + 1
    training = docs.where(~held_out(F.col(f"`{id_col}`")))
    words = word_counts(training, text_col)
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = {bytes(r.word): r.c for r in words.where(F.col("c") >= max(1, -(-n // FREQUENT))).select("word", "c").collect()} if n else {}
    counts = id_counts(words, ranks, end_id + 1, end_id)
    model = fit(training, counts, ranks, end_id, id_col, text_col) if trained else attention.Model.fresh(attention.Vocabulary.of(counts))
    shared = spark.sparkContext.broadcast((model, frequent))
    smooth = n + 0.5 * (v + 1)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"kind int, slice long, at int, doc_id {kind}, n_tokens long, known long, base double, score double, word binary, rows binary"
    out = common.arrow_schema(schema)

    def run(batches):
        (model, frequent), pieces = shared.value, Pieces(ranks.value, end_id)
        model.prepared()
        place = model.vocabulary.place
        counts = np.array([frequent.get(END, -1)], np.int64)  # of words by number; -1: not frequent
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                if pieces.full():
                    pieces.clear()
                    counts = counts[:1]
                lists = [words_of(t) for t in common.bytes_of(part.column(1))]
                (x, y, start, spot), numbers, row, new, sizes, lengths = laid_out(pieces, place, lists)
                counts = np.append(counts, np.fromiter((frequent.get(w, -1) for w in new), np.int64, len(new)))
                logs = attention.log_probabilities(model, x, y, start)[spot]
                logs = np.bincount(np.repeat(np.arange(len(sizes)), lengths), logs, len(sizes)) / np.log(10)
                c = counts[numbers]
                often = c >= 0
                base = np.bincount(row[often], np.log10((c[often] + 0.5) / smooth), len(lists))
                known = np.bincount(row[often & (c > 0)], minlength=len(lists))
                first, blobs = _by_word(numbers[~often], row[~often])
                flat = [w for ws in lists for w in ws]
                names = [flat[i] for i in np.flatnonzero(~often)[first].tolist()]
                slice_id += 1
                del lists, flat
                yield _rows(out, len(sizes), kind=np.zeros(len(sizes)), slice=np.full(len(sizes), slice_id), at=np.arange(len(sizes)), doc_id=part.column(0), n_tokens=sizes, known=known, base=base, score=logs)
                for at in range(0, len(names), 20_000):
                    some = names[at : at + 20_000]
                    yield _rows(out, len(some), kind=np.ones(len(some)), slice=np.full(len(some), slice_id), word=some, rows=blobs[at : at + 20_000])

    found = common.written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), common.text_column(docs, text_col)).mapInArrow(run, schema), "lm-scores", by="kind")
    rare = found.where("kind = 1").select("slice", "word", "rows").join(words.select("word", "c"), "word", "left").select("slice", "rows", F.coalesce("c", F.lit(0)).alias("c"))

    def add_up(key, table):
        c, blobs = table.column("c").to_numpy(), table.column("rows").to_pylist()
        pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2)
        c = np.repeat(c, [len(b) // 8 for b in blobs])
        base = np.bincount(pairs[:, 0], pairs[:, 1] * np.log10((c + 0.5) / smooth))
        known = np.bincount(pairs[:, 0], pairs[:, 1] * (c > 0))
        used = np.unique(pairs[:, 0])
        return pa.table({"slice": pa.array(np.full(len(used), key[0].as_py())), "at": pa.array(used, pa.int32()), "more_known": pa.array(known[used].astype(np.int64)), "more": pa.array(base[used])})

    more = rare.groupBy("slice").applyInArrow(add_up, "slice long, at int, more_known long, more double")
    rows = found.where("kind = 0").join(more, ["slice", "at"], "left")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _by_word(numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each distinct word, (where it first stands, the rows that have it with how often, as pairs of unsigned 32-bit integers)."""
    keys, place, n = np.unique(numbers << 32 | row, return_index=True, return_counts=True)
    _, first = np.unique(keys >> 32, return_index=True)
    data = np.stack([keys & 0xFFFFFFFF, n], axis=1).astype("<u4").tobytes()
    cuts = (8 * np.append(first, len(keys))).tolist()
    return place[first], [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of the given columns, the others null."""
    make = lambda f: columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
    return pa.RecordBatch.from_arrays([make(f) for f in schema], schema=schema)


def op13_lm_scoring(spark: SparkSession, sf_dir: str, trained: bool = True) -> DataFrame:
    import public_tokenizers

    return score(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), trained=trained)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op13: counts and the base score, rounded."""
    return op13_lm_scoring(spark, sf_dir, trained=False).withColumn("base_score", F.round("base_score", 4)).drop("score")


#: DuckDB has no CRC: it is folded over the digits of the id.
BASE_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS b))),
  d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 5 = 1 AS held_out FROM documents, crc),
  e AS MATERIALIZED (SELECT rid, held_out, w, count(*) AS k FROM (SELECT rid, held_out, unnest(w) AS w FROM d) GROUP BY ALL),
  c AS MATERIALIZED (SELECT w, sum(k) AS c FROM e WHERE NOT held_out GROUP BY w),
  n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
  b AS (SELECT rid, sum(k)::BIGINT AS n_tokens, coalesce(sum(k) FILTER (c.w IS NOT NULL), 0)::BIGINT AS n_known, sum(k * log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base FROM e LEFT JOIN c USING (w), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM d JOIN b USING (rid), n"""
