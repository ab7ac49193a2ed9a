"""Quality scores learned from preference pairs (Bradley-Terry).

Of a pair of documents, one marked good and one not, the good one is preferred with probability
sigmoid(s(good) - s(other)), where s(x) = w . steps(x).  The weights w come from the logistic loss on
the differences of the pairs' features, so a bias never matters and the share of good documents doesn't
either.  The features are the plain figures of ``FIGURES`` about a whole text, each cut into steps at
quantiles of the learning rows (1 for every cut that the figure is above), which lets a figure say "too
little" as well as "too much".  Labels, language, source and id are never inputs.

The threshold is a quantile of the learning rows' scores: of all levels the one that parts the two kinds
of rows best (greatest share of good rows above it plus share of others below it), in the middle where
several do.  ``score`` is the logistic function of s, shifted so that this quantile falls on
``THRESHOLD``: ``predicted`` is 1 where the score is ``THRESHOLD`` or more.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest seeded hash of the id, and at
most ``PAIRS`` pairs of them, and runs inside one task on that bounded sample; only cuts and weights pass
through the driver.

Nulls: a null text is empty; rows whose doc_id or label is null aren't used for fitting.  Repeated rows
are scored alike.  Labels of one kind only, or none, tell nothing: the score is then 1 everywhere (nothing
is rejected).  A text of any length counts whole (one text at a time is held in memory).  Other columns
pass unchanged; one named like an output, in any case, is replaced by it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import Shield, arrow_map, extended, text_or_empty

SAMPLE_ROWS, PAIRS, CUTS, ROUNDS, RIDGE, THRESHOLD = 6000, 60_000, 16, 300, 1e-3, 0.7
FIGURES = (
    "words", "word length", "spread of word length", "letters", "capitals", "digits", "sentence marks", "other marks", "spaces", "words like the one before", "distinct words",
    "distinct pairs of words", "most frequent word", "words of marks only", "words that end in a mark", "words in capitals", "lines", "distinct lines", "words a line", "words a sentence",
)
_WORD = re.compile(r"\S+")
_END = ".!?…。"


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 other letters, 1 capitals, 2 digits, 3 sentence marks, 4 other marks, 5 spaces, of every code point."""
    kinds = {"Lu": 1, "Lt": 1, "Nd": 2, "Zs": 5, "Zl": 5, "Zp": 5, "Cc": 5}
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))
        out[i] = kinds.get(c, 4 if c[0] in "PS" else 0)
    out[[ord(c) for c in _END]] = 3
    return out


def figures(text: str) -> list[float]:
    """The values of ``FIGURES``; 0 throughout for an empty text."""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * len(FIGURES)
    n = len(words)
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=6)
    chars = max(1, int(kinds[:5].sum()))
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    # what depends on a word alone is asked once a distinct word
    bare = sum(k for w, k in counts.items() if not any(map(str.isalnum, w)))
    ends = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in _END + ",;:")
    shouted = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(n), sizes.mean(), sizes.std(), (kinds[0] + kinds[1]) / chars, kinds[1] / max(1, kinds[0] + kinds[1]), kinds[2] / chars, kinds[3] / n, kinds[4] / chars, kinds[5] / n,
        sum(map(eq, words, words[1:])) / max(1, n - 1), len(counts) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), max(counts.values()) / n, bare / n, ends / n, shouted / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), n / (1 + kinds[3]),
    ]


@dataclass
class Ranker:
    """Cuts of the figures, weights of the steps (figure by cut) and the shift of the scores."""

    cuts: np.ndarray
    weights: np.ndarray
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """s of rows of figures."""
        return np.einsum("nfc,fc->n", x[:, :, None] > self.cuts, self.weights)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.raw(np.array([figures(t) for t in texts])) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def preferences(good: int, other: int, most: int = PAIRS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the good, row of the other): all of them, or ``most`` in which every row takes part about equally."""
    if good * other <= most:
        return np.repeat(np.arange(good), other), np.tile(np.arange(other), good)
    rng = np.random.default_rng(seed)
    turn = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-most // n))])[:most]
    return turn(good), turn(other)


def fit(x: np.ndarray, labels: np.ndarray) -> Ranker:
    """Gradient descent with momentum on the mean logistic loss of the pairs' differences."""
    if not (labels == 1).any() or not (labels == 0).any():
        return Ranker(np.full((len(FIGURES), CUTS), np.inf), np.zeros((len(FIGURES), CUTS)), 30.0)
    cuts = np.quantile(x, np.arange(1, CUTS + 1) / (CUTS + 1), axis=0, method="lower").T
    steps = (x[:, :, None] > cuts).reshape(len(x), -1).astype(np.float32)
    good, other = steps[labels == 1], steps[labels == 0]
    i, j = preferences(len(good), len(other))
    w, speed, rate = np.zeros(steps.shape[1]), np.zeros(steps.shape[1]), 4.0 / max(1.0, float(steps.var(0).sum()))
    for _ in range(ROUNDS):
        # the pull of each row is the sum over its pairs, so differences are never held for all pairs
        pull = 1 / (1 + np.exp(np.clip((good @ w)[i] - (other @ w)[j], -30, 30)))
        slope = np.bincount(i, pull, len(good)) @ good - np.bincount(j, pull, len(other)) @ other
        speed = 0.9 * speed + rate * (slope / len(i) - RIDGE * w)
        w = w + speed
    found = Ranker(cuts, w.reshape(cuts.shape), 0.0)
    found.shift = np.log(THRESHOLD / (1 - THRESHOLD)) - parting(found.raw(x), labels)
    return found


def parting(raw: np.ndarray, labels: np.ndarray) -> float:
    """The score between two quantiles that parts the labels best."""
    order = np.argsort(raw, kind="stable")
    s, y = raw[order], labels[order]
    below = np.concatenate([[0.0], np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()])
    edges = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1], [True]]))  # a level can't part equal scores
    best = edges[below[edges] >= below[edges].max() - 1e-12]
    at = int(best[len(best) // 2])
    if at == 0 or at == len(s):
        return float(s[0] - 1.0 if at == 0 else s[-1] + 1.0)
    return float((s[at - 1] + s[at]) / 2)


def held_out(doc_id: Column) -> Column:
    """The quarter of ids that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ranker:
    """Fit on labelled rows outside the held-out quarter."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    picked = ok.select("doc_id", F.col(target).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(11), F.col("doc_id")), "doc_id", "y").limit(sample_rows)
    # at most sample_rows ids are broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([figures(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64())), b.column(2)], ["y", "x", "h"])

    # an id may stand for many rows, so the bound is kept again
    sample = arrow_map(texts.select("y", "text", F.xxhash64("doc_id", "text").alias("h")), work, "y int, x array<double>, h bigint").orderBy("h", "y").limit(sample_rows)

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, x) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        m = fit(np.array([x for _, x in rows]).reshape(-1, len(FIGURES)), np.array([y for y, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.cuts.ravel().tolist()]), pa.array([m.weights.ravel().tolist()]), pa.array([float(m.shift)])], ["cuts", "weights", "shift"])

    got = arrow_map(sample.coalesce(1), fitted, "cuts array<double>, weights array<double>, shift double").first()
    if got is None:
        return fit(np.zeros((0, len(FIGURES))), np.zeros(0, np.int64))
    shape = (len(FIGURES), CUTS)
    return Ranker(np.reshape(got.cuts, shape), np.reshape(got.weights, shape), got.shift)


def score(docs: DataFrame, ranker: Ranker, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with ``score`` and ``predicted``."""
    broadcast, shield = docs.sparkSession.sparkContext.broadcast(ranker), Shield(docs, "text")
    names = shield.inner.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            out = broadcast.value.score([str(t) if t is not None else "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    scored = arrow_map(shield.inner, work, extended(shield.inner.schema, StructField("score", DoubleType())))
    return shield.restore(scored, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their own columns."""
    shield = Shield(docs, "doc_id", "text")
    return shield.restore(score(shield.inner, train(docs, labels)).where("predicted = 1"))
