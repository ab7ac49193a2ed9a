"""Personal data: fixed patterns, and what a character-level BiLSTM with CRF transitions adds.

Kinds are email, ip, card and phone.  ``base_spans`` finds them by pattern; a tagger trained in
numpy adds forms that the patterns miss, such as national phone numbers and shorter cards.  It is
trained from labelled spans: seeded sentences whose spans are known by construction, with dates,
prices and reference numbers among them that are none.

A text is tagged in windows of ``WINDOW`` characters that overlap by half.  The emissions of all windows
that hold a character are averaged, by its distance from their edges, and a run of windows that touch is
decoded by one Viterbi over the whole run, so spans run over any number of windows and no window's edge decides.
Every kind holds a digit or ``@``; a window is tagged only if it or a neighbour has one in its middle (any further from
them can't be part of a span, whose characters stand within half a window of one).  A span
that the tagger adds must not overlap a pattern's, and must pass its kind's plain rules.  Very long texts are
read whole: what is held of a text is some 100 bytes a character near digits and ``@``.

Nulls: a null text is empty and holds nothing.  Repeated rows are treated alike; an empty table gives
no rows; other columns pass unchanged.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Shield, arrow_map, extended

KINDS = ("email", "ip", "card", "phone")
WINDOW, HIDDEN, EMBED, SENTENCES, EPOCHS = 64, 12, 8, 1200, 8
TAGS = 1 + 2 * len(KINDS)  # none, then begin and go on of each kind
Span = tuple[str, int, int]

# ------------------------------------------------------------------ patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The same as searching with the whole pattern, but linear: from each @ both ways."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


# ------------------------------------------------------------------ characters
_MARKS = "@._%+-():/,;'\"#=&|*!?[]{}<>$"
_CLASSES = 35 + len(_MARKS)


def _table() -> np.ndarray:
    """Class of each code point up to 255; 256 stands for all above."""
    out = np.full(257, 33, dtype=np.int16)
    for c in range(257):
        s = chr(c)
        if "0" <= s <= "9":
            out[c] = 1
        elif s == " ":
            out[c] = 2
        elif s.isspace():
            out[c] = 3
        elif "a" <= s.lower() <= "z" and s.isascii():
            out[c] = 4 + ord(s.lower()) - ord("a")
        elif s in _MARKS:
            out[c] = 35 + _MARKS.index(s)
        elif s.isalpha():
            out[c] = 34
    return out


_CLASS_OF = _table()


def classes(text: str) -> np.ndarray:
    return _CLASS_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 256)]


# ------------------------------------------------------------------ labelled sentences
def sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence and the spans it holds."""
    n = rng.randint
    dig = lambda k: "".join(str(n(0, 9)) for _ in range(k))
    word = lambda: "".join(rng.choice(("ba", "lo", "th", "er", "in", "on", "de", "st", "an", "ki", "mu", "que", "ver", "s")) for _ in range(n(1, 4)))

    def card(sizes: tuple[int, ...]) -> str:
        size = rng.choice(sizes)
        body = str(n(1, 9)) + dig(size - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(("", " ", "-"))
        return gap.join(body[i : i + 4] for i in range(0, size, 4)) if size != 15 else gap.join((body[:4], body[4:10], body[10:]))

    def phone() -> str:
        kind = n(0, 4)
        if kind == 0:
            return f"+{n(1, 99)} ({dig(3)}) {dig(3)}-{dig(4)}"
        if kind == 1:
            return f"({n(2, 9)}{dig(2)}) {dig(3)}-{dig(4)}"
        if kind == 2:
            return f"{n(2, 9)}{dig(2)}{(s := rng.choice('-. '))}{dig(3)}{s}{dig(4)}"
        return f"+{n(1, 99)}{(s := rng.choice(' -.'))}{dig(n(2, 4))}{s}{dig(n(5, 7))}" if kind == 3 else f"0{dig(n(2, 4))} {dig(n(5, 7))}"

    made = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', '', '-'))}{word()}{rng.choice(('', dig(2)))}@{word()}{rng.choice(('', '-' + word()))}.{rng.choice(('com', 'org', 'net', 'example', 'de', 'co.uk', 'fr'))}",
        "ip": lambda: ".".join(str(n(0, 255)) for _ in range(4)),
        "card": lambda: card((13, 15, 16, 16, 16, 19)),
        "phone": phone,
    }
    others = (
        lambda: f"{n(1900, 2100)}-{n(10, 12)}-{n(10, 31)}", lambda: f"{n(1, 31)}/{n(1, 12)}/{n(1990, 2030)}", lambda: f"{n(1, 999)},{dig(3)}.{dig(2)}", lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 30)}",
        lambda: f"#{dig(n(3, 9))}", lambda: dig(n(1, 12)), lambda: f"{n(0, 23)}:{dig(2)}", lambda: f"{n(1, 9)}.{n(0, 9)}.", lambda: f"{n(1, 100)} %", lambda: f"@{word()}", lambda: f"{dig(4)}-{dig(4)}", lambda: f"{word()}{dig(n(1, 4))}",
        lambda: f"{dig(2)} {dig(3)} {dig(2)}", lambda: f"{dig(20)}", lambda: f"{dig(8)}-{dig(4)}-{dig(4)}-{dig(4)}-{dig(12)}",
    )
    text, spans = "", []
    for _ in range(n(3, 12)):
        kind = rng.random()
        if kind < 0.25:
            what = rng.choice(KINDS)
            piece = made[what]()
            spans.append((what, len(text), len(text) + len(piece)))
        else:
            piece = rng.choice(others)() if kind < 0.5 else word()
        text += piece + rng.choice((" ", " ", " ", ", ", ". ", "\n", " | ", ": "))
    return text, spans


def tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


# ------------------------------------------------------------------ the tagger
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters by name; ``trans[i, j]`` is the CRF's weight of tag j after tag i."""

    def __init__(self, seed: int = 11):
        rng, h, e = np.random.default_rng(seed), HIDDEN, EMBED
        r = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"emb": r(_CLASSES, e) * 3, "out": r(2 * h, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": r(e, 4 * h), f"h{d}": r(h, 4 * h), f"b{d}": np.zeros(4 * h, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: time x batch x EMBED, in the direction's own order."""
        t, n, h = x.shape[0], x.shape[1], HIDDEN
        pre = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        hs, c, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
        for k in range(t):
            z = pre[k] + hs @ self.p[f"h{d}"]
            g = _sigmoid(z[:, : 3 * h])
            a = np.tanh(z[:, 3 * h :])
            old, c = c, g[:, :h] * c + g[:, h : 2 * h] * a
            tc = np.tanh(c)
            before, hs = hs, g[:, 2 * h :] * tc
            out[k] = hs
            if keep is not None:
                keep.append((g, a, old, tc, before))
        return out

    def emissions(self, symbols: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """batch x time symbols -> time x batch x TAGS."""
        x = self.p["emb"][symbols.T]
        logs: tuple = ([], []) if keep is not None else (None, None)
        hidden = np.concatenate((self._run(x, "f", logs[0]), self._run(x[::-1], "b", logs[1])[::-1]), axis=2)
        if keep is not None:
            keep |= {"x": x, "hidden": hidden, "logs": logs}
        return hidden @ self.p["out"] + self.p["out_b"]

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of runs of positions, which stand one after the other in ``em`` (positions x TAGS); each run is decoded as a whole."""
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        order = np.argsort(-lengths, kind="stable")
        start, lengths = start[order], lengths[order]
        going = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # runs longer than t, the first ones
        best, back = em[start], np.zeros(em.shape, np.int8)
        for t in range(1, int(lengths[0])):
            m = going[t]
            s = best[:m, :, None] + self.p["trans"][None]
            back[start[:m] + t] = s.argmax(1)
            best[:m] = s.max(1) + em[start[:m] + t]
        out, tag = np.zeros(len(em), np.int64), best.argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            m = going[t]
            at = start[:m] + t
            out[at] = tag[:m]
            tag[:m] = back[at, tag[:m]]
        return out

    # -------------------------------------------------------------- training
    def _crf(self, em: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood a window and its gradients by emissions and transitions."""
        t, n, k = em.shape
        trans = self.p["trans"].astype(np.float64)
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty((t, n, k)), np.zeros((t, n, k))
        alpha[0] = em[0]
        for i in range(1, t):
            alpha[i] = lse(alpha[i - 1][:, :, None] + trans, 1) + em[i]
        for i in range(t - 2, -1, -1):
            beta[i] = lse(trans[None] + (em[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        grad = np.exp(alpha + beta - z[None, :, None])
        g_trans = np.zeros((k, k))
        for i in range(1, t):
            g_trans += np.exp(alpha[i - 1][:, :, None] + trans + (em[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
        ti, ni = np.arange(t)[:, None], np.arange(n)[None]
        gold = gold.T
        score = em[ti, ni, gold].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
        grad[ti, ni, gold] -= 1
        np.subtract.at(g_trans, (gold[:-1], gold[1:]), 1)
        return float((z - score).mean()), (grad / n).astype(np.float32), (g_trans / n).astype(np.float32)

    def _back(self, d: str, x: np.ndarray, log: list, g_out: np.ndarray, grads: dict) -> np.ndarray:
        h, w = HIDDEN, self.p[f"h{d}"]
        n = x.shape[1]
        gh, gc, gz = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(log), n, 4 * h), np.float32)
        for k in range(len(log) - 1, -1, -1):
            g, a, old, tc, before = log[k]
            f, i, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            gh = gh + g_out[k]
            gc = gc + gh * o * (1 - tc**2)
            z = gz[k]
            z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :] = gc * old * f * (1 - f), gc * a * i * (1 - i), gh * tc * o * (1 - o), gc * i * (1 - a**2)
            grads[f"h{d}"] += before.T @ z
            gh, gc = z @ w.T, gc * f
        grads[f"b{d}"] += gz.sum((0, 1))
        grads[f"x{d}"] += np.einsum("tne,tnz->ez", x, gz)
        return gz @ self.p[f"x{d}"].T

    def gradients(self, symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        keep: dict = {}
        em = self.emissions(symbols, keep)
        loss, g_em, g_trans = self._crf(em.astype(np.float64), gold)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["trans"] += g_trans
        grads["out"] += np.einsum("tnh,tnk->hk", keep["hidden"], g_em)
        grads["out_b"] += g_em.sum((0, 1))
        g_hidden = g_em @ self.p["out"].T
        gx = self._back("f", keep["x"], keep["logs"][0], g_hidden[:, :, :HIDDEN], grads)
        gx = gx + self._back("b", keep["x"][::-1], keep["logs"][1], g_hidden[::-1, :, HIDDEN:], grads)[::-1]
        np.add.at(grads["emb"], symbols.T, gx)
        return loss, grads

    def fit(self, symbols: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.02, seed: int = 12) -> list[float]:
        """Adam with clipped gradients; the loss of each epoch."""
        rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(symbols)), 0.0
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                loss, grads = self.gradients(symbols[some], gold[some])
                total, step = total + loss * len(some), step + 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(order))
            rate *= 0.8
        return losses


def windows_of(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a labelled text."""
    c, t, half = classes(text), tags(len(text), spans), WINDOW // 2
    n = -(-max(1, len(c)) // half)
    sym, gold = np.zeros((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        a = k * half - half // 2
        lo, hi = max(0, a), min(len(c), a + WINDOW)
        sym[k, lo - a : hi - a], gold[k, lo - a : hi - a] = c[lo:hi], t[lo:hi]
    return sym, gold


@lru_cache(maxsize=1)
def trained(sentences: int = SENTENCES, seed: int = 13) -> Tagger:
    rng, tagger = random.Random(seed), Tagger()
    parts = [windows_of(*sentence(rng)) for _ in range(sentences)]
    tagger.fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return tagger


# ------------------------------------------------------------------ tagging whole texts
def joined_emissions(tagger: Tagger, every: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Emissions of the middles of windows (windows x WINDOW symbols), one after the other.

    A character's emissions are the mean of those of the windows that hold it, weighed by its distance from the
    window's edge; ``follows`` tells which windows overlap the one before.
    """
    half, quarter = WINDOW // 2, WINDOW // 4
    weight = (half - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)).astype(np.float32)[:, None]
    total = np.zeros((len(every), half, TAGS), np.float32)
    parts = np.tile(weight[quarter : quarter + half, 0], (len(every), 1))
    for a in range(0, len(every), 1024):
        em = tagger.emissions(every[a : a + 1024]).transpose(1, 0, 2) * weight
        total[a : a + 1024] += em[:, quarter : quarter + half]
        left = np.flatnonzero(follows[a : a + 1024])
        total[left + a - 1, quarter:] += em[left, :quarter]
        right = np.flatnonzero(follows[a + 1 : a + 1 + len(em)])
        total[right + a + 1, :quarter] += em[right, -quarter:]
    parts[np.flatnonzero(follows) - 1, quarter:] += weight[:quarter, 0]
    parts[follows, :quarter] += weight[-quarter:, 0]
    return (total / parts[:, :, None]).reshape(-1, TAGS)


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """The tagger's spans in each text."""
    half, jobs, rows, follows = WINDOW // 2, [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        c = classes(text)
        spots = np.flatnonzero((c == 1) | (c == 35)) // half  # digits and @
        near = np.unique(np.concatenate((spots - 1, spots, spots + 1)))
        near = near[(near >= 0) & (near * half < len(c))]
        if len(near):
            at = near[:, None] * half - half // 2 + np.arange(WINDOW)
            rows.append(np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], 0))
            follows.append(np.concatenate(([False], np.diff(near) == 1)))
            jobs.append((i, near, len(c)))
    out: list[list[Span]] = [[] for _ in texts]
    if not jobs:
        return out
    chained = np.concatenate(follows)
    runs = np.diff(np.append(np.flatnonzero(~chained), len(chained))) * half
    got = tagger.decode(joined_emissions(tagger, np.concatenate(rows), chained), runs).reshape(-1, half)
    first = 0
    for i, near, n in jobs:
        own = got[first : first + len(near)].ravel()
        first += len(near)
        where = (near[:, None] * half + np.arange(half)).ravel()
        own, where = own[where < n], where[where < n]
        on = np.flatnonzero(own)
        last = None
        for j in on.tolist():
            p, tag = int(where[j]), int(own[j])
            kind = (tag - 1) // 2
            if last and last[0] == kind and last[2] == p and tag % 2 == 0:
                last[2] = p + 1
            else:
                last = [kind, p, p + 1]
                out[i].append(last)  # type: ignore[arg-type]
        out[i] = [(KINDS[k], a, b) for k, a, b in out[i]]
    return out


def plausible(kind: str, piece: str) -> bool:
    """Plain rules that an added span has to meet."""
    d = digits(piece)
    if kind == "email":
        return piece.count("@") == 1 and "." in piece.rpartition("@")[2][1:-1] and piece[0] != "@"
    if kind == "ip":
        return False  # every address is a pattern's
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(piece) <= len(d) + 6 and piece[0].isdigit() and piece[-1].isdigit()
    return 10 <= len(d) <= 15 and len(piece) <= len(d) + 8 and piece[0] in "(0123456789+" and piece[-1].isdigit() and not piece.isdigit() and set(piece) <= set("0123456789 ().-+")


def merged(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """All spans: the patterns' and those the tagger adds beside them."""
    starts, stops = [], []  # of what the patterns cover, without overlaps
    for a, b in sorted((a, b) for _, a, b in base):
        if stops and a < stops[-1]:
            stops[-1] = max(b, stops[-1])
        else:
            starts.append(a)
            stops.append(b)
    out = list(base)
    for kind, a, b in found:
        k = bisect_left(starts, b) - 1
        free = (k < 0 or stops[k] <= a) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
        if free and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of struct(kind, start, end)."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained())
    shield = Shield(docs, "text")
    names = shield.inner.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [merged(*x) for x in zip(texts, base, tag_texts(tagger.value, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(rows, base), kind), pa.array(map(rows, every), kind)], [*b.schema.names, "base_spans", "spans"])

    shape = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
    found = arrow_map(shield.inner, work, extended(shield.inner.schema, StructField("base_spans", shape), StructField("spans", shape)))
    return shield.restore(found, base_spans=F.col("base_spans"), spans=F.col("spans"))
