"""Byte-level BPE encoding and decoding with length-bucketed, padded numpy matrices.

Texts are cut by the tokenizer's pattern. Pieces that a task has not met before are put, as rows of byte ids, into
matrices of equal padded length; in every round each row merges its leftmost pair of minimum rank, pair ranks come
from an open-addressing hash table, and the row is compacted. Rows without a mergeable pair leave the matrix.
Rows of over `LONG` bytes are compacted by links instead of copies, and merge in one round all pairs of the smallest rank
as far as that is the same as one after the other; a word of any length takes time in proportion to it.

Defined cases: a null or empty text gives no ids (n_tokens 0, digests of the empty string); repeated rows give repeated
results; other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NO_RANK = np.int32(2**31 - 1)
#: Bytes of a row from which compaction is by links, and pairs that a round looks at whose merging may make smaller ranks.
LONG, FEW = 256, 256
#: Most entries of a task's piece cache; a full cache is emptied, which costs time but never changes a result.
CACHE_ENTRIES = 400_000
#: Cells of one padded matrix.
CELLS = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the text of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """Rank tables of a byte-level BPE and the matrix encoder over them."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int] | None = None):
        """ranks: token -> rank, which is its id. Any two tokens merge whose bytes together are a token, and a piece that is a
        token is not cut; with `pairs` ((left, right) -> rank) only those pairs merge, and every piece is built from bytes."""
        self.ranks = ranks if pairs is None else {}
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        if pairs is None:
            cuts = ((ranks.get(token[:cut]), ranks.get(token[cut:]), rank) for token, rank in ranks.items() for cut in range(1, len(token)))
            pairs = {(left, right): rank for left, right, rank in cuts if left is not None and right is not None}
        # tokens that are part of a token of lower rank
        self.unordered = frozenset(part for pair, rank in pairs.items() for part in pair if part > rank)
        keys = np.array([left << 32 | right for left, right in pairs], np.uint64)
        self._build(keys, np.array(list(pairs.values()), np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_ranks = np.full(1 << bits, NO_RANK)
        self.probes = 1
        slot = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.slot_keys[slot[rest]] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot[rest], -1 - np.arange(len(rest))), return_index=True)
            won = first[free[first]]
            self.slot_keys[slot[rest[won]]] = keys[rest[won]]
            self.slot_ranks[slot[rest[won]]] = values[rest[won]]
            rest = np.delete(rest, won)
            slot[rest] = (slot[rest] + 1) & self.mask
            self.probes += bool(len(rest))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK for pairs that do not merge (ids below 0 are padding)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slot = self._slot(keys)
        out = np.where(self.slot_keys[slot] == keys, self.slot_ranks[slot], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.slot_keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot = (slot[open_] + 1 if len(slot) == len(keys) and len(open_) != len(keys) else slot + 1) & self.mask
            found = self.slot_keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ranks[slot[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            open_, slot = open_[go], slot[go]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[bytes], dtype: str = "<u4") -> list[bytes]:
        """Ids of each piece, each piece by itself, as little-endian bytes."""
        whole = list(map(self.ranks.get, pieces))
        alone = np.array([0 if r is None else r for r in whole], dtype).tobytes()
        size = np.dtype(dtype).itemsize
        out: list = [alone[i * size : (i + 1) * size] if r is not None else b"" for i, r in enumerate(whole)]
        open_ = np.array([i for i, r in enumerate(whole) if r is None and pieces[i]], np.int64)
        lengths = np.fromiter((len(pieces[i]) for i in open_), np.int64, len(open_))
        wide, open_, lengths = open_[lengths > LONG], open_[lengths <= LONG], lengths[lengths <= LONG]
        at = 0
        while at < len(wide):  # by rows of together so many cells, one row at least
            upto, cells = at + 1, len(pieces[wide[at]])
            while upto < len(wide) and cells + len(pieces[wide[upto]]) <= CELLS:
                cells += len(pieces[wide[upto]])
                upto += 1
            for i, ids in zip(wide[at:upto].tolist(), self._linked([pieces[i] for i in wide[at:upto]]), strict=True):
                out[i] = ids.astype(dtype).tobytes()
            at = upto
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for width in np.unique(widths):
            rows = open_[widths == width]
            step = max(1, CELLS // int(width))
            for at in range(0, len(rows), step):
                self._matrix(pieces, rows[at : at + step], int(width), out, dtype)
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list, dtype: str) -> None:
        lengths = np.array([len(pieces[i]) for i in rows])
        data = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[data]
        left, ranks = rows, self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(left):
            at = ranks.argmin(axis=1)  # the leftmost minimum
            best = ranks[np.arange(len(at)), at]
            done = best == NO_RANK
            if done.any():
                ended, kept = ids[done], lengths[done]
                flat = ended[np.arange(ended.shape[1]) < kept[:, None]].astype(dtype).tobytes()
                ends = np.cumsum(kept * np.dtype(dtype).itemsize)
                start = 0
                for row, end in zip(left[done].tolist(), ends.tolist(), strict=True):
                    out[row] = flat[start:end]
                    start = end
                keep = ~done
                ids, ranks, left, lengths, at, best = ids[keep], ranks[keep], left[keep], lengths[keep], at[keep], best[keep]
                if not len(left):
                    return
            # compaction: each row loses the cell right of the merged pair's left part, and one pair
            line, n, width = np.arange(len(at)), len(at), ids.shape[1]
            ids[line, at] = best
            stays = np.ones((n, width), bool)
            stays[line, at + 1] = False
            ids = ids[stays].reshape(n, width - 1)
            lengths = lengths - 1
            if width == 2:
                ranks = np.full((n, 1), NO_RANK)
                continue
            stays = np.ones((n, width - 1), bool)
            stays[line, at] = False
            ranks = ranks[stays].reshape(n, width - 2)
            for shift in (-1, 0):  # only the pairs beside the new token have new ranks
                pair = at + shift
                ok = (pair >= 0) & (pair < lengths - 1)
                row, pair = line[ok], pair[ok]
                ranks[row, pair] = self.pair_ranks(ids[row, pair], ids[row, pair + 1])

    def _linked(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of long rows. Their cells lie in one flat matrix whose compaction is by links, so a round costs what it merges
        and not the width of the rows. A round takes the smallest rank left in any row and merges its pairs from the left in
        all rows, up to the first whose new token makes a pair of a smaller rank, which comes first then."""
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        size = int(ends[-1])
        # cell `size` is a stop: it is the neighbour of both ends of every row and merges with nothing
        ids = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(-1))
        after, before = np.arange(1, size + 2), np.arange(-1, size)
        after[ends - 1], before[ends - lengths] = size, size
        after[size] = before[size] = size
        ranks = np.full(size + 1, NO_RANK)
        ranks[:size] = self.pair_ranks(ids[:size], ids[after[:size]])
        waiting: dict[int, list[np.ndarray]] = {}  # rank -> cells that had it when they were put there
        heap: list[int] = []
        looked: dict[int, int] = {}  # how many pairs of a rank the next round looks at

        def put(cells: np.ndarray) -> None:
            found = ranks[cells]
            order = np.argsort(found, kind="stable")
            cells, found = cells[order], found[order]
            cells = cells[: np.searchsorted(found, NO_RANK)]
            cuts = np.flatnonzero(np.diff(found[: len(cells)])) + 1
            for part in np.split(cells, cuts) if len(cells) else ():
                rank = int(ranks[part[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        put(np.arange(size))
        while heap:
            rank = heapq.heappop(heap)
            lists = waiting.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            if rank in self.unordered and len(at) > (few := looked.get(rank, FEW)):  # the round may end early
                waiting[rank] = [at[few:]]
                heapq.heappush(heap, rank)
                at, looked[rank] = at[:few], 2 * few
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            run = np.concatenate([[0], np.cumsum(after[at[:-1]] != at[1:])])  # in a run of overlapping pairs every second one merges
            first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            right = after[at]
            if rank in self.unordered:
                beside = np.concatenate([[False], before[at[1:]] == right[:-1]])  # the cell before is a token of this round
                lower = self.pair_ranks(np.where(beside, np.int32(rank), ids[before[at]]), np.full(len(at), rank, np.int32)) < rank
                lower |= self.pair_ranks(np.full(len(at), rank, np.int32), ids[after[right]]) < rank
                if lower.any():
                    upto, looked[rank] = int(lower.argmax()) + 1, FEW
                    if upto < len(at):  # overlapping pairs wait with them: each is a cell of this run of pairs
                        later = np.union1d(at[upto:], right[upto - 1 :])
                        later = later[ranks[later] == rank]
                        if rank not in waiting:
                            waiting[rank] = []
                            heapq.heappush(heap, rank)
                        waiting[rank].append(later)
                    at, right = at[:upto], right[:upto]
            far = after[right]
            ids[at], ids[right], ranks[right] = rank, -1, NO_RANK
            after[at] = far
            before[far] = at
            before[size] = size
            left = before[at]
            ranks[at] = self.pair_ranks(ids[at], ids[after[at]])
            ranks[left] = self.pair_ranks(ids[left], ids[after[left]])
            ranks[size] = NO_RANK
            put(np.unique(np.concatenate([at, left])))
        ids = ids[:size]
        row = np.repeat(np.arange(len(pieces)), lengths)[ids >= 0]
        return np.split(ids[ids >= 0], np.cumsum(np.bincount(row, minlength=len(pieces)))[:-1])


class _Numbers(dict):
    """piece -> its number; a new piece gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class PieceCache:
    """Little-endian ids of pieces; pieces that a slice meets for the first time are encoded together."""

    def __init__(self, encode_many, entries: int = CACHE_ENTRIES):
        self.encode_many, self.entries = encode_many, entries
        self.numbers, self.store = _Numbers(), []

    def blobs(self, piece_lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces, joined."""
        if len(self.store) > self.entries:
            self.numbers, self.store = _Numbers(), []
        number = self.numbers.__getitem__
        found = [list(map(number, pieces)) for pieces in piece_lists]
        self.store += self.encode_many(self.numbers.new)
        self.numbers.new = []
        get = self.store.__getitem__
        return [b"".join(map(get, numbers)) for numbers in found]


#: The usual byte-level pattern, and the same cuts for Python's faster engine. Its classes agree with the Unicode
#: properties on the characters that SIMPLE allows; other texts take the pattern itself.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIMPLE_CUT = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
NOT_SIMPLE = "[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"


def cutter(pattern: str):
    """text -> its pieces under the pattern."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != USUAL:
        return general
    simple, odd = re.compile(SIMPLE_CUT).findall, re.compile(NOT_SIMPLE).search
    return lambda text: general(text) if odd(text) else simple(text)


def encoder(merges: Merges, pattern: str, dtype: str = "<u4", entries: int = CACHE_ENTRIES):
    """texts -> list of little-endian id bytes."""
    cut = cutter(pattern)
    cache = PieceCache(lambda pieces: merges.encode_pieces([p.encode() for p in pieces], dtype), entries)
    return lambda texts: cache.blobs([cut(t) for t in texts])


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabulary files write for bytes: printable Latin ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(data: bytes) -> tuple[Merges, int]:
    """(merges, number of ids) of a tokenizer file: byte-level BPE whose ids follow the order of its merges."""
    file = json.loads(data)
    model, letters = file["model"], byte_letters()
    if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"] or file["normalizer"]:
        raise ValueError("not a plain byte-level BPE file")
    vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    pairs, last = {}, -1
    for merge in model["merges"]:
        left, right = (bytes(letters[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
        rank = vocab[left + right]
        if rank <= last:
            raise ValueError("ids do not follow the merges")
        pairs[vocab[left], vocab[right]] = last = rank
    return Merges(vocab, pairs), max([*vocab.values(), *(t["id"] for t in file.get("added_tokens") or [])]) + 1


def added_tokens(data: bytes):
    """text -> its stretches as (text, None) or (None, id): the strings of a tokenizer file's added tokens are cut out first,
    the leftmost, and of those the longest, with the blanks around them that the file gives to them."""
    tokens = sorted(json.loads(data).get("added_tokens") or [], key=lambda t: -len(t["content"]))
    ids = {t["content"]: t["id"] for t in tokens}
    if not tokens:
        return lambda text: [(text, None)]
    side = lambda t, key, lone: (r"\s*" if t[key] else "") if not t["single_word"] else lone
    found = re.compile("|".join(side(t, "lstrip", r"(?<!\w)") + f"({re.escape(t['content'])})" + side(t, "rstrip", r"(?!\w)") for t in tokens))
    contents = tuple(ids)

    def cut(text: str) -> list[tuple[str | None, int | None]]:
        if not any(c in text for c in contents):
            return [(text, None)]
        out, at = [], 0
        for m in found.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], None))
            out.append((None, ids[m[m.lastindex]]))
            at = m.end()
        return [*out, (text[at:], None)] if at < len(text) else out

    return cut


def decode(vocab: dict[int, bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(vocab.__getitem__, ids))


def encode_decode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids (little-endian unsigned 32-bit), decoded (bytes of the ids decoded again), one row for each row of df."""
    data = df.sparkSession.sparkContext.broadcast(_file_bytes(vocab_path))

    def kernel():
        ranks = read_ranks(data.value)
        encode, vocab = encoder(Merges(ranks), pattern), {v: k for k, v in ranks.items()}

        def step(batch):
            blobs = encode(common.texts_of(batch.column(1)))
            return [batch.column(0), blobs, [decode(vocab, np.frombuffer(b, "<u4").tolist()) for b in blobs]]

        return step

    kind = dict(df.dtypes)[id_col]
    return common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], f"doc_id {kind}, token_ids binary, decoded binary", kernel)


def digests(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with the two byte columns replaced by their length and digests, all in the JVM."""
    rows = encode_decode(df, vocab_path, pattern, id_col, text_col)
    return rows.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
