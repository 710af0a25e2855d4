"""Sequence packing along a Hilbert curve.

A document's vector is the mean of fixed pseudo-random sign vectors of its token ids in `DIMS` dimensions (a hashed
bag of tokens, projected); its cell on the Hilbert curve is its key. Documents are range-sorted by key, and their tokens, each document
ended by `END_ID`, form one stream in that order that is cut every `LENGTH` tokens. Neighbours on the curve thus share
sequences, pieces are gapless, and only the last sequence of all is padded.

Tokens are written once, with key and length. Only key and length are sorted (a range sort with the row number in the
key, so equal keys, such as copies, spread over ranges); sums within ranges and one row per range of totals give each
document's place in the stream. Token ids then meet their place in one equi-join on the unique row number.

Ids are those that the tokenizers library gives for the file: its merges are read into the matrix encoder of
bpe.py, which encodes each distinct piece of a task once (the tests hold the ids against the library's). Strings of the file's
added tokens, such as <|endoftext|>, become their ids, as the library has it; add_special_tokens=False keeps none out that a text holds.

Defined cases: null and empty texts have the end id alone; repeated rows are packed as often as they occur; null ids
are packed like others; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import _file_bytes, added_tokens, encoder, read_tokenizer

LENGTH = 2048
END_ID = 1
DIMS, BITS = 3, 16
SEED = 3


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of non-negative cell coordinates (after Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


#: Bits of one dimension's sum in a packed 64-bit sum, and the most tokens that cannot overflow them.
FIELD, MOST = 21, 1 << 20


def signs(size: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """For each id a pseudo-random 0 or 1 in each of the packed fields (0 stands for -1)."""
    bits = np.random.default_rng(seed).integers(0, 2, (size, dims))
    return (bits << FIELD * np.arange(dims)).sum(axis=1)


def document_keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert key of each id array: the mean sign vector, scaled by its usual spread and put on the grid."""
    if not ids:
        return np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in ids])
    packed = table[np.concatenate(ids)]
    if sizes.max() <= MOST:
        sums = np.add.reduceat(packed, np.cumsum(sizes) - sizes)[:, None] >> FIELD * np.arange(DIMS) & (1 << FIELD) - 1
    else:  # field by field, which no length overflows
        fields = packed[:, None] >> FIELD * np.arange(DIMS) & 1
        sums = np.add.reduceat(fields, np.cumsum(sizes) - sizes, axis=0)
    mean = 2 * sums / sizes[:, None] - 1
    return hilbert_keys(np.clip((np.tanh(3 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


def tokenized(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, key, n, ids (little-endian unsigned 32-bit with the end id): written to the shared folder."""
    data = df.sparkSession.sparkContext.broadcast(_file_bytes(tokenizer_path))

    def kernel():
        merges, size = read_tokenizer(data.value)  # the size counts added tokens, too
        kind = "<u2" if size <= 1 << 16 else "<u4"
        encode, cut, table = encoder(merges, pattern, kind), added_tokens(data.value), signs(max(size, end_id + 1))

        def step(batch):
            texts = common.texts_of(batch.column(1))
            special = {i: parts for i, t in enumerate(texts) if len(parts := cut(t)) > 1 or parts and parts[0][0] is None}  # few, if any
            blobs = encode(["" if i in special else t for i, t in enumerate(texts)] if special else texts)
            for i, parts in special.items():
                some = iter(encode([t for t, _ in parts if t is not None]))
                blobs[i] = b"".join([next(some) if t is not None else np.array(x, kind).tobytes() for t, x in parts])
            ids = [np.append(np.frombuffer(b, kind), np.array(end_id, kind)) for b in blobs]
            return [batch.column(0), document_keys(ids, table), [len(x) for x in ids], [_thin(x) for x in ids]]

        return step

    schema = f"doc_id {dict(df.dtypes)[id_col]}, key long, n long, ids binary"
    rows = common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], schema, kernel)
    return common.written(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _thin(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else in four; the first byte says which."""
    return b"2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"4" + ids.astype("<u4").tobytes()


def ids_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[:1] == b"2" else "<u4", offset=1)


def places(tokens: DataFrame) -> DataFrame:
    """row, first: where each row's tokens start in the stream."""
    ranged = tokens.select("row", "key", "n").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id())
    ranged = common.written(ranged, "packing-order")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each range
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.select("row", "part", F.coalesce(inside, F.lit(0)).alias("inside"))
    return placed.join(bases, placed.part == bases.base_part).select("row", (F.col("base") + F.col("inside")).alias("first"))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row of df."""
    tokens = tokenized(df, tokenizer_path, pattern, end_id, id_col, text_col)
    joined = tokens.select("row", "doc_id", "ids").join(places(tokens), "row").select("doc_id", "first", "ids")
    schema = f"doc_id {dict(df.dtypes)[id_col]}, {PIECES}"
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 2):
                who, rows = [], []
                for i, (first, blob) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    ids = ids_of(blob).astype("<u4")
                    data, start = ids.tobytes(), 0
                    while start < len(ids):
                        at = first + start
                        size = min(length - at % length, len(ids) - start)
                        who.append(i)
                        rows.append((start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), len(ids), at // length, at % length))
                        start += size
                columns = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who, pa.int64())), *map(pa.array, columns)], schema=out)

    return joined.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
