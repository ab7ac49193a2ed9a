"""Token counts by a linear longest-match automaton.

Greedy word-piece encoding takes the longest vocabulary piece that the rest of a word starts with,
again and again.  The automaton does so in one pass over the characters: nodes of the vocabulary's
trie have a failure link, followed when no edge fits, and the number of pieces that following it
pops; both are computed once, so a word's count is a sum and no piece is ever built.

The vocabulary marks pieces that begin a word with a prefix (``Ġ``), the others go on with one.  Words
are runs of letters, digits or other marks between white space, in the vocabulary's byte alphabet;
the first after white space, or in the text, gets the prefix.  A word that can't be cut into pieces
counts as one unknown token; with every byte in the vocabulary there is none.

Nulls: a null text counts 0, like an empty one.  Repeated rows are counted alike; an empty table
gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import Shield, arrow_map, extended

MAX_WORDS = 400_000
_WORD = regex.compile(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+")
PREFIX = "Ġ"


def byte_alphabet() -> dict[int, str]:
    """Bytes as printable characters, the common byte-level rule: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """``edges[node]`` maps a character to a node, ``fail`` and ``pops`` are by node."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        final: list[bool] = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if (to := self.edges[node].get(c)) is None:
                    to = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = to
            final[node] = True
        n = len(self.edges)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z != -1 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 if there is no way to cut it."""
        u, total = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for c in word:
            while c not in edges[u]:
                total += pops[u]
                u = fail[u]
                if u == -1:
                    return 1
            u = edges[u][c]
        while u:
            total += pops[u]
            u = fail[u]
            if u == -1:
                return 1
        return total


def vocabulary_pieces(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["model"]["vocab"])


class Counter(dict):
    """White-space-separated chunk -> tokens, remembered for a bounded number of chunks."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.letters = {b: c for b, c in byte_alphabet().items()}
        self.words: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        total, prefix = 0, PREFIX
        for w in _WORD.findall(chunk):
            if (n := self.words.get(word := prefix + w)) is None:
                n = self.automaton.count(word if w.isascii() and w.isalnum() else prefix + "".join(self.letters[b] for b in w.encode()))
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[word] = n
            total, prefix = total + n, ""
        if len(self) >= MAX_WORDS:
            self.clear()
        self[chunk] = total
        return total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``n_tokens``.  The vocabulary's size is fixed, so its automaton is built by each worker once."""
    shield = Shield(docs, "text")
    names = shield.inner.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(Automaton(vocabulary_pieces(vocabulary)))
        counter = _COUNTERS[vocabulary]
        get, at = counter.__getitem__, names.index("text")
        for b in batches:
            counts = [sum(map(get, t.split())) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], [*b.schema.names, "n_tokens"])

    schema = extended(shield.inner.schema, StructField("n_tokens", LongType()))
    return shield.restore(arrow_map(shield.inner, work, schema), n_tokens=F.col("n_tokens"))
