"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles (words: runs without white space, lower-cased, without
marks at their ends; a text of fewer words is one shingle).  Documents with equal sets form one node,
so exact copies cost nothing.  The steps:

1. MinHash bands bring together nodes that may be linked; each bucket is a star around its least node,
   so a bucket of n nodes gives n - 1 edges.  The stars' components are candidate groups: a pair that
   shares a bucket is in one group.  ``BANDS`` and ``BAND_ROWS`` miss a pair of similarity 0.8 with
   probability 3e-6, and rarer above.
2. A group is compared block by block (``BLOCK`` nodes each), every pair of blocks in a task of its own.
   MinHash values are compared ``CHUNK`` at a time; a pair is dropped once the posterior probability
   that its similarity reaches the threshold (uniform prior) is below ``TOLERANCE``.
3. The rest are verified on their whole shingle sets.  A task returns a row a node: how many documents
   it is linked with, and its union-find root; pairs never become rows.
4. Components of the roots are the classes.

Nulls: rows with a null doc_id, and texts without words (null, empty or blank), are linked with
nothing and are classes of their own.  Repeated rows and rows with the same doc_id are documents of
their own in the counts.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settled, text_or_empty
from .components import components

SHINGLE, THRESHOLD, BANDS, BAND_ROWS, BLOCK = 5, 0.8, 42, 6, 256
SIGNATURE, CHUNK, TOLERANCE = 128, 16, 1e-7
_MARKS = ".,;:!?\"'()[]|"
_P = np.uint64(0x9E3779B97F4A7C15)


def _draws(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


_BAND_DRAWS, _SIGN_DRAWS = _draws(BANDS * BAND_ROWS, 1), _draws(SIGNATURE, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(split.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.strip(_MARKS) or w) for w in names] or [0], dtype=np.uint64)
    codes, empty = coded.indices.to_numpy(zero_copy_only=False), np.array([w == "" for w in names] or [False])
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    words = hashes[codes[keep]] if len(codes) else np.zeros(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    n = len(words)
    rolled = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * _P + words[k : n - SHINGLE + 1 + k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = _mix(h * _P + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], draws: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each (non-empty) set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(draws[0]), len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(*draws, strict=True)):
        v = x * a + b
        v ^= v >> np.uint32(15)
        out[k] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), at)
    return out.T


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    return int(_mix(_mix(s + _P).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _P).view(np.int64)[0])


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the least number of equal ones with which a pair stays.

    With m of n equal and a uniform prior the similarity is Beta(m + 1, n - m + 1); the probability that it
    reaches the threshold is a binomial sum.
    """

    def reach(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if reach(m, n) >= tolerance) for n in range(CHUNK, SIGNATURE + 1, CHUNK)}


_NEEDED = needed()


def _nodes(docs: DataFrame, bands: bool) -> DataFrame:
    """doc_id, node and either a hash of the text and the bucket keys, or the shingles and signature; texts without words are left out."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("th"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            ok = [i for i, s in enumerate(sets) if len(s)]
            if not ok:
                continue
            sets = [sets[i] for i in ok]
            ids, nodes = batch.column(0).take(pa.array(ok)), pa.array([node_of(s) for s in sets], pa.int64())
            if bands:
                values = minhashes(sets, _BAND_DRAWS).astype(np.uint64).reshape(len(sets), BANDS, BAND_ROWS)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
                for k in range(BAND_ROWS):
                    keys = _mix(keys * _P + values[:, :, k])
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([ids, nodes, batch.column(2).take(pa.array(ok)), lists], ["doc_id", "node", "th", "keys"])
            else:
                signs = minhashes(sets, _SIGN_DRAWS)
                yield pa.RecordBatch.from_arrays([ids, nodes, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in signs], pa.binary())], ["doc_id", "node", "shingles", "signature"])

    return arrow_map(rows, work, "doc_id bigint, node bigint, th bigint, keys array<bigint>" if bands else "doc_id bigint, node bigint, shingles binary, signature binary")


def linked(sets: list[np.ndarray], signs: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similarity ``THRESHOLD`` or more: all, or those between the first ``first`` and the rest."""
    n = len(sets)
    rows, cols = np.triu_indices(n, 1) if first is None else (x.ravel() for x in np.meshgrid(np.arange(first), np.arange(first, n), indexing="ij"))
    size = np.array([len(s) for s in sets])
    ok = np.minimum(size[rows], size[cols]) >= THRESHOLD * np.maximum(size[rows], size[cols]) - 1e-9
    rows, cols, done = rows[ok], cols[ok], 0
    same = np.zeros(len(rows), np.int16)
    while done < SIGNATURE and len(rows):
        for k in range(done, done + CHUNK):
            same += signs[rows, k] == signs[cols, k]
        done += CHUNK
        ok = same >= _NEEDED[done]
        rows, cols, same = rows[ok], cols[ok], same[ok]
    if not len(rows):
        return rows, cols
    if len(rows) < 4 * n:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)])
    else:  # many pairs: count common shingles of all at once, some thousand shingles at a time
        names, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        own = np.repeat(np.arange(n), size)
        keep = counts[inverse] > 1
        column = np.cumsum(counts > 1) - 1
        own, at = own[keep], column[inverse[keep]]
        common = np.zeros((n, n), np.float32)
        for lo in range(0, int((counts > 1).sum()), 4096):
            part = (at >= lo) & (at < lo + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[own[part], at[part] - lo] = 1
            common += m @ m.T
        both = common[rows, cols].astype(np.int64)
    ok = both >= THRESHOLD * (size[rows] + size[cols] - both) - 1e-9
    return rows[ok], cols[ok]


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links inside one block, or between two: a row a node."""
    rows = rows.sort_values(["block", "node"], kind="stable").reset_index(drop=True)
    blocks = rows["block"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    signs = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
    i, j = rows["bi"].iloc[0], rows["bj"].iloc[0]
    a, b = linked(sets, signs, None if i == j else int((blocks == i).sum())) if len(rows) > 1 else (np.zeros(0, int), np.zeros(0, int))
    weight, links, root = rows["copies"].to_numpy(), np.zeros(len(rows), np.int64), list(range(len(rows)))
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    node = rows["node"].to_numpy()
    return pd.DataFrame({"node": node, "links": links, "root": node[[find(x) for x in range(len(rows))]]})


def _classes(docs: DataFrame) -> DataFrame:
    """Per document that has an id and words: doc_id, th (hash of the text), label (of its class), class_id, n_links."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    named = settled(_nodes(docs, bands=True), "nodes")
    nodes = named.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    spots = named.select("node", F.explode("keys").alias("key"))
    buckets = spots.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a != top").select("key", "a")
    stars = spots.join(buckets, "key").where("a != node").select("a", F.col("node").alias("b"))
    groups = settled(components(stars), "groups")

    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = groups.join(sizes, "label").join(nodes, "node").select("node", "label", "n", "copies", "doc_id")
    # texts of the members only; equal ids with other texts fall out as their node differs
    held = _nodes(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), bands=False).drop("doc_id").dropDuplicates(["node"])
    held = held.join(members.drop("doc_id"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = held.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "copies", "shingles", "signature")
    compared = settled(dealt.groupBy("label", "bi", "bj").applyInPandas(_compare, "node bigint, links bigint, root bigint"), "compared")

    classes = components(compared.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    facts = settled(nodes.join(links, "node", "left").join(classes, "node", "left").select("node", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")), "facts")
    # tables of their own, so that the join is between plain shuffles and a large class can be split
    least = settled(facts.groupBy("label").agg(F.min("doc_id").alias("class_id")), "least")
    final = facts.join(least, "label").select("node", "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return named.select("doc_id", "th", "node").join(final, "node").select("doc_id", "th", "label", "class_id", "n_links")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), n_links (documents of similarity 0.8 or more)."""
    docs = docs.select("doc_id", "text")
    classes = settled(_classes(docs), "classes")
    found = classes.select("doc_id", "class_id", "n_links")
    # whatever isn't among them has no id or no words
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"))
    alone = rows.join(classes.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    return found.unionByName(alone.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_id").cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class, the one with the least (id, hash of the text).

    Only rows of one class stand for each other, so an id may stay with several texts; rows without an id
    or words are classes of their own and stay.
    """
    spare = [f"_{c}{'_' * max(map(len, docs.columns))}" for c in ("id", "th")]
    classes = settled(_classes(docs).select("doc_id", "th", "label"), "classes")
    known = classes.select(F.col("doc_id").alias(spare[0]), F.col("th").alias(spare[1]))
    stay = classes.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("s")).select(F.col("s.doc_id").alias(spare[0]), F.col("s.th").alias(spare[1]))
    rows = docs.withColumns({spare[0]: F.col("doc_id").cast("bigint"), spare[1]: F.xxhash64(text_or_empty())})
    one = rows.join(stay, spare, "left_semi").dropDuplicates(spare)
    return one.unionByName(rows.join(known, spare, "left_anti")).drop(*spare)
