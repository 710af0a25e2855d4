"""SimHash near-duplicate classes with BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 values of its 3-word shingles. Equal fingerprints collapse
to one row before anything is compared. Two fingerprints within `radius` bits agree on at least `BANDS - radius` of
`BANDS` bit bands, so each fingerprint is dealt, once for every choice of that many bands, to the shard named by those
bands' bits; two linked fingerprints meet in some shard. A shard is a BK-tree whose children are keyed by their
integer Hamming distance to the parent, and a search follows only the edges within the radius of the distance
just measured.

All shards together grow with the corpus, so they are not broadcast as a whole: the shuffle carries each shard tree to
the one task that searches it (noted in the README). A shard has the same bits in 4 of 6 bands, hence at most 2^22
distinct fingerprints whatever the data; searching it emits one link from each member to its smallest linked member,
never all pairs. Components of these links over all shards give the classes.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows share a fingerprint
and a class; a null doc_id takes part in its class but never names it (component_id is null if no id is known);
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
BANDS = 6
#: Most fingerprints that are named by a broadcast.
MOST_HOT = 1000
#: Queries that walk a block's trees at once, and rows after which the complete shards of a block are searched.
QUERY_BLOCK = 20_000
SHARD_ROWS = 500_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64; words are lower-cased already. No words: 0."""
    import xxhash

    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64) if len(hashes) < 1 << 16 else sum(b.sum(axis=0, dtype=np.int64) for b in np.array_split(bits, len(hashes) >> 14))
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row for each row of df; with row_col, a column of longs, also row."""

    def kernel():
        def step(batch):
            values = [fingerprint(text.lower().split()) for text in common.bytes_of(batch.column(1))]
            return [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), *batch.columns[2:]]

        return step

    columns, schema = [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], f"doc_id {dict(df.dtypes)[id_col]}, fp long"
    if row_col:
        columns, schema = [*columns, F.col(f"`{row_col}`").alias("row")], schema + ", row long"
    return common.map_texts(df, columns, schema, kernel)


def band_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each choice of bands - radius bands."""
    edges = np.linspace(0, 64, bands + 1).round().astype(int).tolist()
    band = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(band, bands - radius)]


class Forest:
    """The BK-trees of many shards at once, built and searched level by level. Rows are sorted by shard."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values = values
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        root_of = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        self.root = root_of
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rows = np.flatnonzero(~first)
        at = root_of[rows]
        while len(rows):  # each level: the first row of each (node, distance) becomes that child, the others go below it
            d = np.bitwise_count(values[rows] ^ values[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            child = rows[new][np.cumsum(new) - 1]
            parent[rows[new]], edge[rows[new]] = key[new] // 65, key[new] % 65
            rows, at = rows[~new], child[~new]
        kids = np.flatnonzero(parent >= 0)
        key = parent[kids] * 65 + edge[kids]
        order = np.argsort(key)
        self.kids, self.key = kids[order], key[order]

    def links(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, other row of its shard) within the radius."""
        out_q, out_n = [], []
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            out_q.append(q[hit])
            out_n.append(node[hit])
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
            q = np.repeat(q, many)
            inner = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
            node = self.kids[np.repeat(low, many) + inner]
        return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (queries[:0], queries[:0])

    def roots(self, radius: int, block: int = QUERY_BLOCK) -> np.ndarray:
        """For each row the smallest row that links reach inside its shard."""
        label = np.arange(len(self.values))
        sizes = np.bincount(self.root, minlength=len(label))[self.root]
        rows = np.flatnonzero(sizes > 1)
        start = 0
        while start < len(rows):
            take = max(1, min(block, int(20_000_000 // max(1, sizes[rows[start : start + block]].max()))))
            a, b = self.links(rows[start : start + take], radius)
            start += take
            while len(a):  # union by pointer jumping over what this block found
                x, y = label[a], label[b]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    jumped = label[label]
                    if (jumped == label).all():
                        break
                    label = jumped
                open_ = label[a] != label[b]
                a, b = a[open_], b[open_]
        return label


def shard_links(distinct: DataFrame, radius: int = RADIUS, block: int = SHARD_ROWS) -> DataFrame:
    """distinct(fp) -> links(a, b) that connect all fingerprints within the radius of each other."""
    masks = band_masks(radius=radius)
    signed = [int(np.uint64(m).astype(np.int64)) for m in masks]
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "bits"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            part = tuple(batch.column(i).to_numpy() for i in range(3))
            if not len(part[0]):
                continue
            held.append(part)
            size += len(part[0])
            if size >= block:  # search all shards but the last, which may go on
                rows = tuple(np.concatenate(x) for x in zip(*held))
                last = int(((rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])).argmax())
                yield from searched(*(x[:last] for x in rows))
                held, size = [tuple(x[last:] for x in rows)], 0
        if held:
            yield from searched(*(np.concatenate(x) for x in zip(*held)))

    def searched(fp, choice, bits):
        if not len(fp):
            return
        new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
        shard = np.cumsum(new) - 1
        met = np.bincount(shard)[shard] > 1  # a shard of one has nothing to search
        fp, shard = fp[met], shard[met]
        label = Forest(shard, fp.view(np.uint64)).roots(radius)
        star = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[label[star]]), pa.array(fp[star])], names=["a", "b"])

    # sorted, so that a task streams its shards and holds a block of them, or one large one, at a time
    return dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of df."""
    prints = common.written(fingerprints(df, id_col, text_col), "simhash")
    groups = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    linked = common.written(components(shard_links(groups.select("fp"), radius)), "simhash-classes")
    named = linked.join(groups, linked.node == groups.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    each = groups.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    each = common.written(each, "simhash-named")
    # Fingerprints with a thousandth of all rows or more number a thousand at most: they are broadcast, so that no task
    # gets all rows of one; the others meet by a shuffle.
    hot = F.col("n") >= max(1000, prints.count() // MOST_HOT)
    frequent = each.where(hot).select("fp", "component_id")
    out = prints.join(F.broadcast(frequent), "fp").unionByName(prints.join(F.broadcast(frequent), "fp", "left_anti").join(each.where(~hot).select("fp", "component_id"), "fp"))
    return out.select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """df with one row of each class: the first of those whose id names it. Rows without an id stay.

    Rows are told apart by a written number, not by their ids, which may repeat within a class or over several."""
    row = "simhash_row"
    while row.lower() in {c.lower() for c in df.columns}:
        row += "_"
    numbered = common.written(df.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = fingerprints(numbered, id_col, text_col, row)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    groups = common.written(prints.groupBy("fp").agg(first), "simhash-distinct")
    linked = common.written(components(shard_links(groups.select("fp"), radius)), "simhash-classes")
    rooted = groups.join(linked, groups.fp == linked.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).where("first is not null").select(F.col("first.row").alias(row))
    without = numbered.where(F.col(f"`{id_col}`").isNull())
    # the rows meet their decisions in the same way at every size
    return numbered.join(common.written(kept, "simhash-kept").hint("merge"), row, "left_semi").unionByName(without).select(*[f"`{c}`" for c in df.columns])
