"""Cases where an operator once did less than its whole job."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import jaccard, lines, toxicity
from orrery.llm.encoders import WordCache
from orrery.llm.queries import vocabulary


@pytest.fixture(scope="module")
def edited(spark):
    """Short lines, one changed word and many small edits; what brute force on edit similarity drops, and what the operator does."""
    rng, rows = random.Random(4), []
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20, 40)))]
        other = list(own)
        other[rng.randrange(len(own))] = rng.choice(words)
        x = list(" ".join(own))
        for _ in range(len(x) // 8):
            x[rng.randrange(len(x))] = rng.choice("abc")
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(other)), (3 * i + 2, "".join(x))]
    known = {d: lines.normalise(t) for d, t in rows}
    root = {d: d for d in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in known:
        for b in range(a + 1, len(rows)):
            if lines.similar(known[a], known[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for d in known:
        groups[find(d)].append(d)
    assert sum(len(g) > 1 for g in groups.values()) > 30
    want = {d for d in known if find(d) != d}
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_dropped = 1").collect()
    found = {r.doc_id for r in got}
    short = {d for d in want if max(len(known[x]) for x in groups[find(d)]) <= lines.SHORT}
    word = {d for d in want if d % 3 == 1 and find(d) == find(d - 1)}
    return want, found, short, word


def test_lines_by_edit_similarity_alone(edited):
    """Nothing else goes, no short line is missed, and one changed word is found at any length."""
    want, found, short, word = edited
    assert len(short) > 10 and found <= want and short <= found
    assert len(word) > 20 and len(found & word) >= 0.95 * len(word)


@pytest.mark.xfail(strict=True, reason="letters changed all over a longer line (one in eight, so half of its words) are mostly not found; see README")
def test_lines_edited_all_over(edited):
    want, found, _, _ = edited
    print("recall", len(found) / len(want))
    assert len(found) >= 0.95 * len(want)


def test_special_strings_in_any_case():
    texts = ["a <|ENDOFTEXT|> b", "x<|StartOfText|>y Z", "<|endoftext|> <|EndOfText|>", "plain"]
    w = WordCache.of(vocabulary("word_bpe_49k.json"))
    assert [x.tolist() for x in w.encode(pa.array(texts))] == [w.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_pair_whose_members_say_nothing_alone():
    rng, rows, labels = np.random.default_rng(1), [], []
    for _ in range(3000):
        a, b = [(1, 0), (0, 1), (1, 1), (0, 0)][rng.choice(4, p=[0.06, 0.06, 0.012, 0.868])]
        rows.append(np.unique([*[k for k, on in ((1, a), (2, b)) if on], *rng.integers(10, 2000, 40).tolist()]))
        labels.append(int(a and b or not a and not b and rng.random() < 0.115))
    have = [np.array([k in x for x in rows]) for k in (1, 2)]
    y = np.array(labels)
    assert all(toxicity.chi2(h.sum(), (h & (y == 1)).sum(), len(y), y.sum()) < toxicity.SIGNIFICANT for h in have)
    m = toxicity.fit(rows, y)
    assert m.known[[1, 2]].all() and m.of(np.array([1, 2])) > 0.7 > 0.5 > max(m.of(np.array([1])), m.of(np.array([2])))


def test_an_id_with_unrelated_texts_keeps_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (3, c), (3, c), (4, "")]
    kept = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (1, b), (3, c), (4, "")]


def test_a_text_of_separators_is_a_class_of_its_own(spark):
    rows = [(1, "\x1c\x1d \x1f"), (2, "one two three four five six")]
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, 1, 0), (2, 2, 0)]


def test_other_tokenizers_get_whole_texts():
    texts = ["Some  Words,\n and\tMORE", "", "x"]
    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        w = WordCache.of(vocabulary(name))
        assert w.by_word == by_word and [x.tolist() for x in w.encode(pa.array(texts))] == [w.tok.encode(t, add_special_tokens=False).ids for t in texts]
