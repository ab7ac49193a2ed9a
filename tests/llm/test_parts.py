"""The parts of the operators against plain versions."""

import json
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import chat, jaccard, lines, mixing, pii, tokenfile, toxicity, wordpiece
from orrery.llm.encoders import WordCache
from orrery.llm.queries import vocabulary


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>"]), st.text("<|\\>endtur \n")), max_size=6))
def test_chat_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_masks_cut_tokens():
    mask, spans = chat.masked([(0, 4), (4, 5), (4, 5), (5, 9), (9, 12)], [(2, 6), (10, 11)])
    assert mask.tolist() == [True, True, True, True, True] and spans == [(2, 6), (10, 11)]


def test_word_cache_equals_library():
    import pyarrow as pa

    texts = ["", "  The cat's <|endoftext|> sat ", "naïve Straße, ÉTÉ! don't 12 + 3", "a\x1cb c d e\tf\n", "x" * 300, "日本語 テスト｡ İstanbul"]
    w = WordCache.of(vocabulary("word_bpe_49k.json"))
    assert [x.tolist() for x in w.encode(pa.array(texts))] == [w.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_perfect_hash():
    keys = list(range(5000)) + [None]
    n = np.arange(len(keys)) + 1
    index = tokenfile.Index(tokenfile.build_index(keys, n))
    ok, at, size = index.find(keys, np.zeros(len(keys), int))
    assert ok.all() and (size == n).all() and (at == np.cumsum(n) - n).all()
    assert sorted(index.hash.slots(tokenfile.key_hashes(keys, np.zeros(len(keys), int)))) == list(range(len(keys)))
    assert not index.find(list(range(10**6, 10**6 + 2000)), np.zeros(2000, int))[0].any()


@given(st.lists(st.integers(1, 30), min_size=1, max_size=8, unique=True), st.integers(0, 200), st.data())
def test_knapsack(lengths, budget, data):
    counts = data.draw(st.lists(st.integers(0, 4), min_size=len(lengths), max_size=len(lengths)))
    take = mixing.knapsack(lengths, counts, budget)
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    assert sum(t * n for t, n in zip(take, lengths, strict=True)) == max(s for s in sums if s <= budget)


def test_targets():
    got = mixing.targets({"a": 10, "b": 1000, None: 90})
    assert got["a"] == 30 and abs(got["b"] + got[None] - 1070) < 1e-6 and got[None] == 270


def test_base_spans_equal_patterns():
    rng = random.Random(1)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        text = "".join(rng.choice("a1.2@-+ ( _%4") for _ in range(rng.randint(0, 60))) + rng.choice(("", " 4111 1111 1111 1111", " a@b.com_c@d.org"))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                    continue
                want.append((kind, *m.span()))
        assert pii.base_spans(text) == want


def test_tagger_gradients_and_accuracy():
    rng, tagger = random.Random(3), pii.Tagger()
    sym, gold = pii.windows_of(*pii.sentence(rng))
    _, grads = tagger.gradients(sym, gold)
    for name in ("emb", "hf", "xb", "out", "trans"):
        g = grads[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = tagger.p[name][at], []
        for e in (0.01, -0.01):
            tagger.p[name][at] = old + e
            losses.append(tagger.gradients(sym, gold)[0])
        tagger.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 1e-3
    good = found = total = 0
    held_out = [pii.sentence(random.Random(1000 + i)) for i in range(200)]
    for (_, spans), got in zip(held_out, pii.tag_texts(pii.trained(), [t for t, _ in held_out]), strict=True):
        good, found, total = good + len(set(spans) & set(got)), found + len(got), total + len(spans)
    assert good / total > 0.85 and good / found > 0.85


def test_greedy_longest_match():
    pieces = set(json.load(open(vocabulary("byte_bpe_50k.json")))["model"]["vocab"])
    auto, rng = wordpiece.Automaton(pieces), random.Random(2)
    for _ in range(2000):
        word = "Ġ" + "".join(rng.choice(("th", "ing", "a", "Ã", "©", "er", "1", "q", "zz", "tion")) for _ in range(rng.randint(0, 8)))
        rest, n = word, 0
        while rest:
            k = next(k for k in range(len(rest), 0, -1) if rest[:k] in pieces)
            rest, n = rest[k:], n + 1
        assert auto.count(word) == n
    small = wordpiece.Automaton(["a", "ab", "abcd", "cde"])
    # abcd is taken, then nothing fits e: one unknown token
    assert [small.count(w) for w in ("abcde", "abcd", "abce", "", "x")] == [1, 1, 1, 0, 1]


def test_greedy_in_random_vocabularies():
    rng = random.Random(7)
    for _ in range(500):
        own = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        auto = wordpiece.Automaton(sorted(own))
        for _ in range(10):
            rest = word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            n = 0
            while rest:
                k = next((k for k in range(len(rest), 0, -1) if rest[:k] in own), 0)
                if not k:
                    n = 1
                    break
                rest, n = rest[k:], n + 1
            assert auto.count(word) == n


@settings(max_examples=200)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        d = [i + 1] + [0] * len(b) if not b else [i + 1, *[0] * len(b)]
        prev = list(range(len(b) + 1)) if i == 0 else last
        for j, y in enumerate(b):
            d[j + 1] = min(prev[j + 1] + 1, d[j] + 1, prev[j] + (x != y))
        last = d
    assert lines.edit_distance(a, b) == (d[-1] if a else len(b))


def test_bayes_bounds():
    need = jaccard.needed()
    assert all(0 < need[n] < 0.8 * n for n in need) and list(need.values()) == sorted(need.values())


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([i for i, on in ((1, a), (2, b)) if on] + [3 + int(rng.integers(5))]))
        labels.append(int(a and b))
    m = toxicity.fit(rows, np.array(labels))
    assert m.of(np.array([1, 2])) > 0.7 > 0.5 > max(m.of(np.array([1])), m.of(np.array([2])))
