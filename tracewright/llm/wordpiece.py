"""Word-piece token counts by a linear longest-match automaton.

A word's tokens are its greedy longest matches: the first from the initial pieces, the others from the continuing
pieces. The vocabulary is a trie with one root for either kind, failure links, and for each link the number of tokens
it pops, all computed once; a word is then counted in one walk over its bytes without building a piece. Many
words walk the automaton side by side in numpy; each distinct word of a task walks once.

A word that cannot be cut counts as one unknown token. Documents are independent: no shuffle.

Defined cases: null, empty and word-less texts have 0 words and 0 tokens; repeated rows get equal rows; null ids are
counted like others; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import _file_bytes, read_ranks
from .samples import row_sums

#: Most words of a task's count cache; a full cache is emptied.
CACHE_WORDS = 400_000
#: Words of more bytes are walked alone.
LONG = 1024


class LinearMatcher:
    """Trie with failure links and popped-token counts over initial and continuing pieces (non-empty byte strings)."""

    START, CONTINUE = 0, 1

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        child: dict[int, int] = {}
        final = [False, False]
        for root, pieces in ((self.START, initial), (self.CONTINUE, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    key = node << 8 | b
                    if key not in child:
                        child[key] = len(final)
                        final.append(False)
                    node = child[key]
                final[node] = True
        n = len(final)
        fail, pops = [-1] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in child.items():
            below[key >> 8].append((key & 255, node))
        queue = deque((self.START, self.CONTINUE))
        while queue:
            u = queue.popleft()
            for b, v in below[u]:
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = self.CONTINUE, 1
                    continue
                z, popped = fail[u], pops[u]
                while z >= 0 and (z << 8 | b) not in child:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = child[z << 8 | b], popped
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        self.fail, self.pops = np.array(fail), np.array(pops)
        self.child, self.fail_list, self.pops_list = child, fail, pops

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1) if len(self.keys) else np.full(len(node), -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word; 1 for a word that cannot be cut, 0 for an empty word."""
        n = len(words)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        state, total, dead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        longest = min(int(lengths.max()) if n else 0, LONG)
        longer = n - np.cumsum(np.bincount(np.minimum(lengths, LONG), minlength=longest + 1))  # words longer than i, in one pass
        first = int((lengths > LONG).sum())  # these few are walked alone: a step over all words for each of their bytes would be wasted
        for i in range(longest):
            live = order[first : max(first, longer[i])] if i < LONG else order[:0]
            self._read(live[~dead[live]], data, starts, i, state, total, dead)
        self._finish(np.flatnonzero(~dead & (lengths > 0) & (lengths <= LONG)), state, total, dead)
        total[dead] = 1
        for w in order[:first].tolist():
            total[w] = self._walk(words[w])
        return total

    def _walk(self, word: bytes) -> int:
        """The count of one word, byte by byte."""
        child, fail, pops, node, total = self.child, self.fail_list, self.pops_list, self.START, 0
        for b in word:
            while (to := child.get(node << 8 | b)) is None:
                if fail[node] < 0:
                    return 1
                total, node = total + pops[node], fail[node]
            node = to
        while node != self.CONTINUE:
            if fail[node] < 0:
                return 1
            total, node = total + pops[node], fail[node]
        return total

    def _read(self, rows, data, starts, i, state, total, dead) -> None:
        byte = data[starts[rows] + i]
        while len(rows):
            to = self._child(state[rows], byte)
            ok = to >= 0
            state[rows[ok]] = to[ok]
            rows, byte = self._pop(rows[~ok], byte[~ok], state, total, dead)

    def _finish(self, rows, state, total, dead) -> None:
        rows = rows[state[rows] != self.CONTINUE]
        while len(rows):
            rows, _ = self._pop(rows, rows, state, total, dead)
            rows = rows[state[rows] != self.CONTINUE]

    def _pop(self, rows, byte, state, total, dead):
        at = state[rows]
        to = self.fail[at]
        stuck = to < 0
        dead[rows[stuck]] = True
        rows, byte, at, to = rows[~stuck], byte[~stuck], at[~stuck], to[~stuck]
        total[rows] += self.pops[at]
        state[rows] = to
        return rows, byte


def pieces_of_ranks(data: bytes) -> tuple[set[bytes], set[bytes]]:
    """Initial and continuing pieces from a byte-level rank file: tokens with a leading space start a word; so do single bytes."""
    tokens = read_ranks(data)
    single = {bytes([b]) for b in range(256)}
    return {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | single, {t for t in tokens if t[:1] != b" "} | single


def token_counts(df: DataFrame, initial_continuing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for each row of df. initial_continuing() gives the two piece sets, in each task."""

    def kernel():
        matcher = LinearMatcher(*initial_continuing())
        known: dict[bytes, int] = {}

        def step(batch):
            if len(known) > CACHE_WORDS:
                known.clear()
            lists = [t.split() for t in common.bytes_of(batch.column(1))]
            new = list(set(chain.from_iterable(lists)) - known.keys())
            known.update(zip(new, matcher.counts(new).tolist(), strict=True))
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            each = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.float64, int(n.sum()))
            return [batch.column(0), n, row_sums(each, np.concatenate([[0], np.cumsum(n)])).astype(np.int64)]

        return step

    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_words long, n_tokens long"
    return common.map_texts(df, [F.col(f"`{id_col}`").alias("doc_id"), common.text_column(df, text_col)], schema, kernel)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = spark.sparkContext.broadcast(_file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return token_counts(common.table(spark, sf_dir, "documents"), lambda: pieces_of_ranks(shared.value))
