"""Encoding with a public tokenizer, remembering what each word became.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across it, so the ids of
a text are those of its white-space-separated words, one after another.  ``WordCache`` asks the
library only for words it hasn't met; texts that hold a special token's string go to it whole, and so do
all texts where the tokenizer's own description says that it works otherwise.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker (about 110 MB); further ones are kept for their batch only, which
#: costs time, not results.
MAX_WORDS = 600_000
#: Marks between a letter and white space: a word of their own to the tokenizer.
_TAIL = r"([a-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)(\s|$)"
#: Words whose number of tokens with word end is known: one of letters, one of marks after them.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]*)")


def load(path: str):
    """The tokenizer, on one thread: a task has one core, and threads' arenas cost memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCache:
    def __init__(self, path: str):
        self.tok, self.plain = load(path), load(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        # only a tokenizer that lowers, drops white space and marks word ends can be asked word by word
        spec = json.loads(self.tok.to_str())
        splits = json.dumps(spec["pre_tokenizer"])
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in json.dumps(spec["normalizer"]) and '"Removed"' in splits and r"[^\\s" in splits
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        # white space to Arrow but not to the tokenizer; specials in any case, as words are lowered before they are looked up
        self.odd = "|".join([r"[\x1c-\x1f]", *(f"(?i:{s})" for s in special)])
        self.ids: dict[str, bytes] = {"": b""}
        from tokenizers import normalizers

        self.plain.normalizer = normalizers.Sequence([])  # for words that it would only lower

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> WordCache:
        return WordCache(path)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        plain, counts, rest = [], [], []
        for w in words:
            if m := _PLAIN.fullmatch(w):
                plain.append(w)
                counts.append(2 if m[1] else 1)
            else:
                rest.append(w)
        for i in range(0, len(plain), 100):
            some, n = plain[i : i + 100], np.cumsum(counts[i : i + 100])
            ids = np.array(self.plain.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != n[-1]:
                rest += some
                continue
            cut = [0, *stops[n - 1].tolist()]
            into.update((w, ids[a:b].tobytes()) for w, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        if rest:
            into.update(zip(rest, self._direct(rest), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls among them).

        Arrow splits the texts and numbers their distinct words; only those are looked up one by one,
        and numpy gathers their ids in the order of the text.
        """
        if not len(texts):
            return []
        if not self.by_word:
            return [np.frombuffer(x, "<u4") for x in self._direct(texts.to_pylist())]
        # fewer different words: A-Z lowered (all is, later), marks that end a word set apart, as they are anyway
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3")
        split = pc.utf8_split_whitespace(plain)
        coded = pc.dictionary_encode(split.flatten())
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = list(map(self.ids.get, names))
        if new := [w for w, got in zip(names, found, strict=True) if got is None]:
            into = self.ids if len(self.ids) + len(new) <= MAX_WORDS else {}
            self._learn(new, into)
            found = [into[w] if got is None else got for w, got in zip(names, found, strict=True)]
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        n = size[codes]
        stop = np.cumsum(n)
        ids = pool[np.repeat(first[codes] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cut = np.concatenate(([0], stop))[bounds]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self._direct([texts[i].as_py()])[0], "<u4")
        return out
