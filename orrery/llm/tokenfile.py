"""Token-ID output: raw id payloads with a minimal perfect hash index from document key to offset.

Format: one Parquet row per block, written by Spark's own committer, so it works on any file
system that Spark reaches and survives lost executors.  Blocks follow ascending ``doc_id``
(nulls first, then text) and hold

``part, seq``       range partition and position in it; blocks in (part, seq) order are the whole
``start_in_part``   ids of the partition before the block
``n_docs, n_ids``   counts
``first_id, last_id, has_null``  least and greatest key, and whether there is a null one
``keys``            document keys in payload order
``width``           bytes of an id in the payload (2 if the vocabulary fits, else 4)
``payload``         the ids, little-endian, documents one after another
``index``           minimal perfect hash: key -> slot, and per slot fingerprint, offset, length

The hash is a cascade of bit arrays: a key that is alone at its place of a level is settled
there, the rest go on to the next; its slot is the number of set bits before it.  Look-ups take
constant time and the stored 32-bit fingerprint tells foreign keys apart.  A key is the document
id together with its number among rows of the same id, so repeated ids stay apart.

Nulls: a null text is the empty text, which gives the end id alone; a null doc_id is a key of its
own.  An empty table gives no blocks.  Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, text_or_empty
from .encoders import WordCache

BLOCK_IDS = 1 << 19
GATHERED_BYTES = 3 << 20
_GAMMA = 2
_LEVELS = 48
BLOCK_SCHEMA = "part int, seq int, start_in_part bigint, n_docs int, n_ids bigint, first_id bigint, last_id bigint, has_null boolean, keys array<bigint>, width int, payload binary, index binary"


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), over a whole array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hashes(keys: list[int | None], turns: np.ndarray) -> np.ndarray:
    """Hashes of (document id, number among equal ids)."""
    null = np.array([k is None for k in keys], dtype=bool)
    ids = np.array([0 if k is None else k for k in keys], dtype=np.int64).view(np.uint64)
    return mix(mix(ids, 1) ^ mix(turns.astype(np.uint64), 2) ^ np.where(null, np.uint64(0xA5A5A5A5), np.uint64(0)), 3)


def turns_of(keys: list[int | None]) -> np.ndarray:
    """For each key how many equal keys stand before it (equal keys are neighbours)."""
    out, last, n = np.zeros(len(keys), dtype=np.int64), object(), 0
    for i, k in enumerate(keys):
        n = n + 1 if k == last and i else 0
        last = k
        out[i] = n
    return out


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        self.bits = [np.unpackbits(x) for x in levels]
        self.base, before = [], 0
        for b in self.bits:
            rank = np.cumsum(b, dtype=np.int64)
            self.base.append(rank - b + before)
            before += int(rank[-1])
        self.placed = before

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest = [], hashes
        while len(rest) and len(levels) < _LEVELS:
            size = max(8, -(-_GAMMA * len(rest) // 8) * 8)
            at = mix(rest, 10 + len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone))
            rest = rest[~alone[at.astype(np.int64)]]
        return cls(levels, np.sort(rest))  # equal hashes of different keys: kept in a list

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for those surely not stored."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for n, (bits, base) in enumerate(zip(self.bits, self.base, strict=True)):
            if not len(open_):
                break
            at = (mix(hashes[open_], 10 + n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = base[at[hit]]
            open_ = open_[~hit]
        for i in open_ if len(self.left) else ():
            j = int(np.searchsorted(self.left, hashes[i]))
            if j < len(self.left) and self.left[j] == hashes[i]:
                out[i] = self.placed + j
        return out


def build_index(keys: list[int | None], lengths: np.ndarray) -> bytes:
    h = key_hashes(keys, turns_of(keys))
    ph = PerfectHash.build(h)
    slot = ph.slots(h)
    n = len(keys)
    marks, offs, lens = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    marks[slot] = (mix(h, 4) >> np.uint64(32)).astype("<u4")
    offs[slot] = np.cumsum(lengths) - lengths
    lens[slot] = lengths
    head = struct.pack(f"<3I{len(ph.levels)}I", n, len(ph.levels), len(ph.left), *map(len, ph.levels))
    return head + b"".join(x.tobytes() for x in (*ph.levels, ph.left.astype("<u8"), marks, offs, lens))


class Index:
    """The stored index of a block, for keyed access."""

    def __init__(self, raw: bytes):
        n, n_levels, n_left = struct.unpack_from("<3I", raw)
        sizes = struct.unpack_from(f"<{n_levels}I", raw, 12)
        at = 12 + 4 * n_levels

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        self.hash = PerfectHash([take("u1", s) for s in sizes], take("<u8", n_left))
        self.marks, self.offsets, self.lengths = take("<u4", n), take("<u8", n), take("<u8", n)

    def find(self, keys: list[int | None], turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, offset and length (in ids) for each key."""
        h = key_hashes(keys, turns)
        slot = self.hash.slots(h)
        safe = np.where(slot < 0, 0, slot)
        if not len(self.marks):
            return np.zeros(len(h), bool), safe, safe
        ok = (slot >= 0) & (self.marks[safe] == (mix(h, 4) >> np.uint64(32)).astype("<u4"))
        return ok, self.offsets[safe].astype(np.int64), self.lengths[safe].astype(np.int64)


# ------------------------------------------------------------------ writing
def _block(part: int, seq: int, before: int, keys: list, ids: list[np.ndarray], width: int) -> dict:
    lengths, known = np.array([len(x) for x in ids], dtype=np.int64), [k for k in keys if k is not None]
    return {
        "part": part, "seq": seq, "start_in_part": before, "n_docs": len(keys), "n_ids": int(lengths.sum()),
        "first_id": min(known, default=None), "last_id": max(known, default=None), "has_null": len(known) < len(keys), "keys": keys, "width": width,
        "payload": np.concatenate(ids).astype("<u2" if width == 2 else "<u4").tobytes(), "index": build_index(keys, lengths),
    }


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``GATHERED_BYTES``, so that a word is looked up once for many documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()), ("keys", pa.list_(pa.int64())), ("width", pa.int32()), ("payload", pa.binary()), ("index", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Encode every document and write the blocks to ``path``.

    Rows are range-partitioned by (doc_id, hash of text, source partition): a repeated id or text
    spreads over tasks, and only the texts are shuffled, once.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache.of(tokenizer)
        width = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        for batch in _gathered(batches):
            for key, got in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                keys.append(key)
                ids.append(np.concatenate((got, end)))
                held += len(ids[-1])
                if held >= block_ids:
                    yield pa.RecordBatch.from_pylist([_block(part, seq, before, keys, ids, width)], _ARROW)
                    seq, before, held, keys, ids = seq + 1, before + held, 0, [], []
        if keys:
            yield pa.RecordBatch.from_pylist([_block(part, seq, before, keys, ids, width)], _ARROW)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("nth"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "text")
    arrow_map(ordered.select("doc_id", "text"), encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


# ------------------------------------------------------------------ reading
def _starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each range partition.  One row a partition comes to the driver, whatever the corpus."""
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    order = sorted(sums)
    return dict(zip(order, accumulate([0, *(sums[p] for p in order)][:-1]), strict=True))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, through the index of its block: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    starts = _starts(blocks)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                payload = np.frombuffer(b["payload"], "<u2" if b["width"] == 2 else "<u4")
                ok, at, n = Index(b["index"]).find(b["keys"], turns_of(b["keys"]))
                if not ok.all():
                    raise ValueError("a key of the block isn't in its index")
                first = starts[b["part"]] + b["start_in_part"]
                crc = [zlib.crc32(payload[i : i + k].astype("<u4").tobytes()) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b["keys"], pa.int64()), pa.array(first + at), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(blocks, digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents by key: doc_id, ids (end id included).

    Blocks are sorted by id, so Parquet's statistics of ``first_id`` and ``last_id`` leave those that
    may hold a key; each asks its own index, in constant time a key.
    """
    maybe = F.col("has_null") if None in doc_ids else F.lit(False)
    for k in (k for k in set(doc_ids) if k is not None):
        maybe = maybe | ((F.col("first_id") <= k) & (F.col("last_id") >= k))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(maybe)

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                index, payload = Index(b["index"]), np.frombuffer(b["payload"], "<u2" if b["width"] == 2 else "<u4")
                turn, ask = 0, list(dict.fromkeys(doc_ids))
                while ask:
                    ok, at, n = index.find(ask, np.full(len(ask), turn))
                    hits = [(k, payload[i : i + m].tolist()) for k, o, i, m in zip(ask, ok, at, n, strict=True) if o]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])
                    ask, turn = [k for k, _ in hits], turn + 1

    return arrow_map(blocks, get, "doc_id bigint, ids array<int>")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` in the file format and return what reading it again gives."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
