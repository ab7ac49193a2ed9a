"""The tagger's overlapping windows against plain loops, and forms written by hand."""

import random

import numpy as np

from orrery.llm import pii

#: text, and the spans in it that somebody would want masked; no template of ``pii.sentence`` makes these sentences.
HAND = (
    ("Reach Dana on 415-555-0134 before noon.", ["415-555-0134"]),
    ("Tel: (020) 7946 0958, ask for the night desk", ["(020) 7946 0958"]),
    ("my cell's 212.555.0187, leave a message", ["212.555.0187"]),
    ("fax 030 1234567 or write to us", ["030 1234567"]),
    ("He gave his card, 378282246310005, over the phone.", ["378282246310005"]),
    ("Amex 3782 822463 10005 was declined twice", ["3782 822463 10005"]),
    ("paid with 4222222222222 in May", ["4222222222222"]),
    ("Order 8841-2210 shipped on 2024-11-02 for 1,204.50.", []),
    ("The server answered after 12.5 ms in version 3.10.4.", []),
    ("Room 415, floor 5, from 10:30 until 12:45", []),
    ("ISBN 978-3-16-148410-0 is out of print", []),
    ("between 1914 and 1918, some 20 000 000 people", []),
    ("Call (312) 555-0142 or (312) 555-0143.", ["(312) 555-0142", "(312) 555-0143"]),
    # forms that the generator has none of
    ("toll-free 1-800-555-0199 all week", ["1-800-555-0199"]),
    ("appelez le 06 12 34 56 78 ce soir", ["06 12 34 56 78"]),
    ("from abroad 0049 30 123456", ["0049 30 123456"]),
    ("mobile 07946 095 812, evenings", ["07946 095 812"]),
    ("text 4155550134 for details", ["4155550134"]),
    ("on file: 3782.822463.10005", ["3782.822463.10005"]),
    ("ping me @morgan about ticket #48213", []),
)


def test_windows_are_reconciled_over_the_whole_run():
    tagger, half = pii.Tagger(5), pii.WINDOW // 2
    tagger.p["trans"] = np.random.default_rng(1).normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    rng = np.random.default_rng(2)
    follows = np.array([False, True, True, False, False] + [True] * 1100)
    every = rng.integers(0, 60, (len(follows), pii.WINDOW)).astype(np.int16)
    em = pii.joined_emissions(tagger, every, follows)
    single = np.concatenate([tagger.emissions(every[k : k + 1]).transpose(1, 0, 2) for k in range(len(every))])
    weight = [half - abs(j - (pii.WINDOW - 1) / 2) for j in range(pii.WINDOW)]
    for w in (0, 1, 2, 3, 4, 1023, 1024, 1025, len(every) - 1):
        for x in range(half):
            held = [(single[w, x + half // 2], weight[x + half // 2])]
            if x < half // 2 and follows[w]:
                held.append((single[w - 1, x + half // 2 + half], weight[x + half // 2 + half]))
            if x >= half // 2 and w + 1 < len(every) and follows[w + 1]:
                held.append((single[w + 1, x - half // 2], weight[x - half // 2]))
            want = sum(e * u for e, u in held) / sum(u for _, u in held)
            assert np.allclose(em[w * half + x], want, atol=1e-4)
    lengths = np.array([3, 1, len(follows) - 4]) * half
    got, at = tagger.decode(em, lengths), 0
    for n in lengths.tolist():
        part = em[at : at + n]
        best, back = part[0].copy(), []
        for t in range(1, n):
            score = best[:, None] + tagger.p["trans"]
            back.append(score.argmax(0))
            best = score.max(0) + part[t]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        assert tags[::-1] == got[at : at + n].tolist()
        at += n


def test_a_span_is_found_wherever_windows_begin():
    piece, rng = "(415) 555-0134", random.Random(4)
    for shift in range(0, 70, 3):
        text = "".join(rng.choice("abcdefgh ") for _ in range(shift)) + " call " + piece + " today"
        assert ("phone", text.index(piece), text.index(piece) + len(piece)) in pii.merged(text, pii.base_spans(text), pii.tag_texts(pii.trained(), [text])[0]), shift


def test_forms_written_by_hand():
    right = found = wanted = 0
    for text, spans in HAND:
        got = {text[a:b] for _, a, b in pii.merged(text, pii.base_spans(text), pii.tag_texts(pii.trained(), [text])[0])}
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
        print(got == set(spans), text, got)
    print(right, found, wanted)
    assert right >= 0.6 * wanted and right >= 0.6 * found


def test_many_spans_in_one_text():
    text = "a@b.cd " * 20_000
    assert len(pii.merged(text, pii.base_spans(text), [("phone", 0, 3)] * 20_000)) == 20_000
