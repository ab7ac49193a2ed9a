"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered as a whole, turn after turn::

    <|turn|>ROLE<|text|>TEXT<|end|>\\n

and encoded once, with the offsets of its tokens.  The spans of assistant texts are sorted, as are
the tokens, so a binary search finds the tokens that meet each span; their parts inside the spans
are the text under the loss mask.  The three control strings can't occur inside a role or text:
there ``<``, any number of ``\\``, ``|`` gets one ``\\`` more, which reading back takes away.

Nulls: a null text or role is the empty string; a null turn stands first, a null conv_id is a
conversation of its own.  Rows with equal turns are ordered by role, then text; repeated rows stay.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .encoders import load

#: Conversations encoded at a time: offsets take far more memory than ids.
ENCODED = 16

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_PARTS = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END) + r"\n", re.S)
SCHEMA = "conv_id bigint, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts to train on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END, "\n"]
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARTS.finditer(formatted)]


def masked(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and what of the text lies in both, joined where it touches.

    ``offsets`` and ``spans`` are sorted; the tokens of one character share its offsets.
    """
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, found = np.zeros(len(offsets), dtype=bool), []
    for a, b in spans:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        here: list[list[int]] = []
        for k in range(first, last):
            x, y = max(starts[k], a), min(ends[k], b)
            if x < y:
                mask[k] = True
                if here and x <= here[-1][1]:
                    here[-1][1] = max(here[-1][1], y)
                else:
                    here.append([x, y])
        found += [(x, y) for x, y in here]
    return mask, found


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    tok = load(path)
    tok.encode_special_tokens = True
    return tok


def format_chats(conversations: DataFrame, tokenizer: str, trained: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, input_ids, loss_mask (by token), loss_spans.

    ``loss_spans`` are code points of ``formatted`` under the mask.  A conversation is one example,
    so its turns meet in one row; the aggregation merges before and after the only shuffle.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for batch in (b.slice(k, ENCODED) for b in batches for k in range(0, b.num_rows, ENCODED)):
            ids, turns = batch.column(0), batch.column(1).to_pylist()
            rendered = [render([(t["role"], t["text"]) for t in c], trained) for c in turns]
            encoded = tok.encode_batch([r[0] for r in rendered], add_special_tokens=False)
            masks = [masked(e.offsets, spans) for e, (_, spans) in zip(encoded, rendered, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[0] for r in rendered], pa.string()), pa.array([e.ids for e in encoded], pa.list_(pa.int32())), pa.array([m.tolist() for m, _ in masks], pa.list_(pa.bool_())), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in masks], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
            )

    return arrow_map(chats, work, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the mask."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
                out.append({
                    "conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(r["formatted"]),
                    "n_tokens": len(r["input_ids"]), "n_loss_tokens": sum(r["loss_mask"]),
                })
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())]))

    return arrow_map(formatted, work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint")
