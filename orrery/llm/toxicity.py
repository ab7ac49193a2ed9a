"""Toxicity by a factorization machine over hashed terms.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

The pair term learns that two terms together, such as an insult beside the mention of a group, say
more than each alone.  Terms are the distinct lower-cased words of the whole text and their
beginnings (languages that inflect or compound hide an insult in many words), hashed into
``BUCKETS``; x is 1 for those that occur.  Labels, language, source and id are never inputs.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest seeded hash of the id, so
what the driver holds is bounded.  A term counts if ``MIN_ROWS`` of them have it and its chi-squared
statistic against the label is ``SIGNIFICANT`` or more, or if having it together with another term has
a statistic greater than each alone by ``PAIR_GAIN`` or more (all pairs that can reach it are counted).
The others are left out: a text has hundreds of terms that say nothing, by which it would be learned by
heart (without any screen 71 to 83 of 144 toxic held-out documents are found at sf0.1).  The machine is fitted inside one task
on that bounded sample; only its weights (of the terms that count) pass through the driver to executors.

Nulls: a null text is empty and has no terms, so its score is that of the bias; rows whose doc_id
or label is null aren't used for fitting.  Repeated rows are scored alike; ties in the sample's order are
between equal rows.  Labels of one kind only, or none, tell nothing: the score is then 0.5 at most everywhere
(0 without a label 1), so nothing is predicted toxic.  A text of any length counts whole.  Other columns pass unchanged;
one named like an output, in any case, is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import Shield, arrow_map, extended, text_or_empty

BUCKETS, FACTORS, SAMPLE_ROWS, MIN_ROWS, SIGNIFICANT, PAIR_GAIN, THRESHOLD = 1 << 17, 4, 6000, 3, 15.0, 60.0, 0.7
PREFIXES = (3, 4, 5, 6, 7)
_TERM = re.compile(r"\w+")


def buckets(word: str) -> set[int]:
    """Hashes of a word and of its beginnings."""
    return {zlib.crc32(t.encode()) % BUCKETS for t in (word, *("^" + word[:n] for n in PREFIXES if n < len(word)))}


def terms(text: str) -> set[int]:
    """Hashes of all terms of a text."""
    return set().union(*map(buckets, set(_TERM.findall(text.lower()))))


@dataclass
class Machine:
    """Fitted weights; ``known`` marks the buckets that have any."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    known: np.ndarray

    def score(self, text: str) -> float:
        x = np.array(sorted(terms(text)), dtype=np.int64)
        return self.of(x[self.known[x]])

    def of(self, x: np.ndarray) -> float:
        v = self.v[x]
        z = self.bias + float(self.w[x].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chi2(have: np.ndarray, have1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Chi-squared statistic of having a term against the label."""
    a, b, c = have1.astype(float), (have - have1).astype(float), float(n1) - have1
    d = n - a - b - c
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)


def paired(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, with1: np.ndarray, block: int = 512) -> np.ndarray:
    """Terms of which some pair says more than each alone, by ``PAIR_GAIN`` of chi-squared or more."""
    n, n1 = len(labels), int(labels.sum())
    alone = chi2(counts, with1, n, n1)
    # a pair has some of the rows of each term, so at best all toxic or all clean ones of them
    best = np.maximum(chi2(with1, with1, n, n1), chi2(counts - with1, with1 * 0, n, n1))
    can = np.flatnonzero((counts > 0) & (best >= alone + PAIR_GAIN))
    place = np.full(BUCKETS, -1)
    place[can] = np.arange(len(can))
    bits = np.zeros(((n + 7) // 8, len(can)), np.uint8)
    for i, x in enumerate(rows):
        at = place[x]
        bits[i >> 3, at[at >= 0]] |= 128 >> (i & 7)
    # terms with the same rows (a word and its beginnings) are one
    have, first, same = np.unique(bits.T, axis=0, return_index=True, return_inverse=True)
    alone, found = alone[can[first]], np.zeros(len(first), bool)
    toxic = labels == 1
    for a in range(0, len(have), block):
        one = np.unpackbits(have[a : a + block], axis=1, count=n).astype(np.float32)
        for b in range(a, len(have), block):
            two = np.unpackbits(have[b : b + block], axis=1, count=n).astype(np.float32).T
            gain = chi2(one @ two, one[:, toxic] @ two[toxic], n, n1) - np.maximum(alone[a : a + block, None], alone[b : b + block])
            i, j = np.nonzero(gain >= PAIR_GAIN)
            found[a + i] = found[b + j] = True
    out = np.zeros(BUCKETS, bool)
    out[can] = found[same.ravel()]
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 20, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss; the rarer label weighs as much as the other in all."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(BUCKETS), rng.normal(0, 0.01, (BUCKETS, FACTORS)), 0.0
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for x in rows:
        counts[x] += 1
    n1 = int(labels.sum())
    if not len(labels) or n1 == 0 or n1 == len(labels):  # nothing to tell apart
        return Machine(0.0 if n1 else -30.0, w, v * 0, np.zeros(BUCKETS, dtype=bool))
    with1 = np.zeros(BUCKETS, dtype=np.int64)
    for x, y in zip(rows, labels, strict=True):
        if y:
            with1[x] += 1
    known = (counts >= MIN_ROWS) & (chi2(counts, with1, len(labels), n1) >= SIGNIFICANT) | paired(rows, labels, counts, with1)
    rows = [x[known[x]] for x in rows]
    gain = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * (len(labels) - n1)))
    gw, gv, gb = np.full(BUCKETS, 1e-6), np.full((BUCKETS, FACTORS), 1e-6), 1e-6
    # a word that half of all documents have says little: steps are damped by how common it is
    damp = np.minimum(1.0, np.sqrt(len(rows) / 50 / np.maximum(counts, 1)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i], labels[i]
            vx = v[x]
            total = vx.sum(0)
            z = bias + w[x].sum() + 0.5 * ((total**2).sum() - (vx**2).sum())
            g = gain[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            d = g + decay * w[x]
            gw[x] += d * d
            w[x] -= rate * damp[x] * d / np.sqrt(gw[x])
            d = g * (total - vx) + decay * vx
            gv[x] += d * d
            v[x] -= 0.2 * rate * damp[x, None] * d / np.sqrt(gv[x])
    return Machine(float(bias), w, v, known)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on labelled rows outside the held-out third."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    picked = ok.select("doc_id", F.col(target).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(3), F.col("doc_id")), "doc_id", "y").limit(sample_rows)
    # at most sample_rows ids are broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(terms(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(2)], ["y", "x", "h"])

    # an id may stand for many rows, so the bound is kept again; the order makes reruns agree
    sample = arrow_map(texts.select("y", "text", F.xxhash64("doc_id", "text").alias("h")), work, "y int, x array<int>, h bigint").orderBy("h", "y").limit(sample_rows)

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for b in batches:
            stops = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy()
            rows += [flat[a:z].copy() for a, z in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            labels += b.column(0).to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i].tobytes()))
        m = fit([rows[i] for i in order], np.array([labels[i] for i in order], np.int64))
        at = np.flatnonzero(m.known)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([m.w[at].tolist()], pa.list_(pa.float64())), pa.array([m.v[at].ravel().tolist()], pa.list_(pa.float64()))], ["bias", "at", "w", "v"])

    got = arrow_map(sample.coalesce(1), fitted, "bias double, at array<bigint>, w array<double>, v array<double>").first()
    m = Machine(-30.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), np.zeros(BUCKETS, dtype=bool))
    if got:
        m.bias, m.w[got["at"]], m.v[got["at"]], m.known[got["at"]] = got.bias, got.w, np.reshape(got.v, (-1, FACTORS)), True
    return m


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with ``score`` and ``predicted``; every word of every text counts."""
    broadcast, shield = docs.sparkSession.sparkContext.broadcast(machine), Shield(docs, "text")
    names, schema = shield.inner.columns, shield.inner.schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bucket = broadcast.value, _Buckets(broadcast.value.known)
        at = names.index("text")
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                found = set().union(*map(bucket.__getitem__, set(_TERM.findall(t.lower())))) if t else ()
                out.append(m.of(np.array(sorted(found), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    scored = arrow_map(shield.inner, work, extended(schema, StructField("score", DoubleType())))
    return shield.restore(scored, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))


class _Buckets(dict):
    """Word -> its known buckets, remembered for a bounded number of words."""

    def __init__(self, known: np.ndarray):
        self.known = known

    def __missing__(self, w: str) -> tuple[int, ...]:
        found = tuple(i for i in buckets(w) if self.known[i])
        if len(self) >= 300_000:
            self.clear()
        self[w] = found
        return found


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    shield = Shield(docs, "doc_id", "text")
    return shield.restore(score(shield.inner, train(docs, labels)).where("predicted = 0"))
