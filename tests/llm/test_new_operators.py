"""Operators 11 to 13: brute force, held-out rows, odd rows and planted cases."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from orrery.llm import audit, mixing, quality, variants
from orrery.llm.queries import QUERIES


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, odd):
    return odd if request.param == "odd" else odd.limit(0)


# ------------------------------------------------------------------ quality
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op11_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= out[d].score <= 1 and out[d].predicted == (out[d].score >= 0.7) for d in out)
    judged = [(r.quality, out[r.doc_id]) for r in labels if out[r.doc_id].held_out]
    good, other = [r for q, r in judged if q == 1], [r for q, r in judged if q == 0]
    assert np.mean([a.score > b.score for a in good for b in other]) > 0.97
    assert np.mean([r.predicted for r in good]) >= 0.95 and np.mean([r.predicted for r in other]) <= 0.1


def test_quality_scores_equal_a_plain_model(spark, sf):
    """The query's scores are those of the model text by text, however the rows are dealt."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op11_quality"](spark, sf).collect():
        x = np.array(quality.figures(texts[r.doc_id]))
        z = sum(w for f, own in enumerate(model.weights) for c, w in enumerate(own) if x[f] > model.cuts[f, c]) + model.shift
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_learns_a_preference():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FIGURES)))
    y = (x[:, 3] + 0.05 * rng.normal(size=400) > 0.8).astype(int)
    m = quality.fit(x, y)
    s = m.raw(x) + m.shift
    assert np.mean((s >= np.log(7 / 3)) == (y == 1)) > 0.95
    assert m.weights[3].sum() > 3 * np.abs(np.delete(m.weights, 3, 0).sum(1)).max()
    # the slope of the loss over pairs, by its definition
    i, j = quality.preferences(7, 5)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(7) for b in range(5)]
    i, j = quality.preferences(1000, 300, 9000)
    assert len(i) == 9000 and set(Counter(i.tolist()).values()) == {9} and set(Counter(j.tolist()).values()) == {30}


def test_quality_parting():
    assert quality.parting(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) == 2.5
    assert quality.parting(np.array([1.0, 1.0, 1.0]), np.array([0, 1, 1])) in (0.0, 2.0)


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, None), (None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0 and out.count() == docs.count()
    one = quality.score(docs, quality.train(docs, labels.where("quality = 1")))
    assert one.where("predicted = 0").count() == 0
    kept = quality.drop_low_quality(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


# ------------------------------------------------------------------ audit
def plain_audit(rows, labels):
    """Every order applied in turn to lists of documents."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    texts = [(d, t or "", p or "") for d, t, p in rows]
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    fails = []
    for d, t, p in texts:
        ws = [w for w in __import__("re").split("[ \t-\r]+", t) if w]
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        fails.append((p, d, {k for k, v in f.items() if v}))
    out, removed_by = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(d, f) for p, d, f in fails if p == part]
            gone = []
            for k, name in enumerate(order, 1):
                now = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                removed_by[part, name] += len(now)
                out[part, "".join(order), k] = [len(left), len(now), sum(name in f for _, f in gone), sum(f == {name} for p, _, f in fails if p == part), sum(d in good for d, _ in now), sum(d in toxic for d, _ in now)]
                gone += now
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(150)]

    def text():
        kind = rng.randrange(6)
        some = rng.sample(words, 110) if kind % 2 else rng.choices(words[:9], k=rng.choice((5, 120)))
        t = rng.choice((" ", "\t", "\x0b \n")).join(some)
        return t.upper() if kind == 2 else t + " |" if kind == 3 else t

    pool = [text() for _ in range(25)] + ["", None, "é" * 9 + "A"]
    rows = [(rng.choice((None, *range(60))), rng.choice(pool), rng.choice(("en", "de", None, ""))) for _ in range(200)]
    rows += [(7, pool[0], "en")] * 20 + [(None, pool[0], "en")] * 5  # repeats of an id, and unknown ids
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as mask", "'x' as part", "2 as good")
    got = audited(audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert got == plain_audit(rows, labels)
    assert len(got) == 3 * 600


def test_audit_sums_invert(spark):
    rows = [("p", bool(m & 1), False, m, m * m % 7 + 1) for m in range(32)]
    sums = audit.parities(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n bigint"))
    r = audit.counts(sums).first()
    assert r["all"] == [n for *_, n in rows] and r.good == [n if g else 0 for _, g, _, _, n in rows] and r.toxic == [0] * 32


def test_audit_odd_rows(spark, docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = audited(audit.audit(docs, labels))
    assert got == plain_audit(rows, [(4, 1, 1), (4, 1, None)]) and (got or not rows)


# ------------------------------------------------------------------ variants
def plain_variants(rows):
    import re

    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {a: [b for b in n if near(a, b)] for a in n}
    form = {a: min(ls, key=lambda b: (-n[b], b)) for a, ls in links.items() if ls}
    form = {a: b for a, b in form.items() if n[b] >= 2 * n[a]}

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {(a, form.get(a), root(a), n[a], len(links[a]), n[form[a]] if a in form else None) for a in n}


def test_variants_equal_brute_force(spark):
    """Anagrams, runs of one letter, edits at either end and chains of forms."""
    rng = random.Random(5)
    base = ["thering", "therign", "aaaaaa", "aaaaaaa", "aaaaaaaa", "éèêëàç", "ththth", "hththt", "anonan", "ananon", "onanan", "wordabc", "über÷×ß"]
    pool = Counter()
    for w in base:
        pool[w] += rng.choice((40, 90))
        for _ in range(12):
            x = w
            for depth in range(rng.choice((1, 2, 3))):
                i, c = rng.randrange(len(x)), rng.choice("abtnéÿ")
                x = rng.choice((x[:i] + x[i + 1 :], x[:i] + c + x[i:], x[:i] + c + x[i + 1 :], x + c))
                pool[x] += 20 // 2 ** (2 * depth) + rng.randrange(3)
    words = [w for w, k in pool.items() for _ in range(k)]
    rng.shuffle(words)
    rows = [(i, " ".join(w.capitalize() if rng.random() < 0.3 else w for w in words[i::80]) + "12x_") for i in range(80)] + [(None, "thering thering"), (3, None), (4, "")]
    got = variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as word", "2 as n").repartition(4))
    want = plain_variants(rows)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want and got.count() == len(want)
    assert any(r not in (w, f) for w, f, r, *_ in want)  # a chain of two forms


def test_variants_odd_rows(docs):
    got = variants.variants(docs)
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


def test_variants_very_long_run(spark):
    n = 100_000
    words = {"ÿ" * n: 3, "ÿ" * (n + 1): 9, "ÿ" * 70_000 + "é" + "ÿ" * (n - 70_001): 5, "ÿ" * 70_000 + "éé" + "ÿ" * (n - 70_002): 4}
    rows = [(i, w) for w, k in words.items() for i in range(k)]
    got = {r.word: (r.form, r.n_near) for r in variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    a, b, c, d = words
    assert got == {a: (b, 2), b: (None, 1), c: (None, 2), d: (None, 1)}


# ------------------------------------------------------------------ mixing of long documents
def test_fit_of_long_documents():
    lengths = list(range(150_001, 150_011))
    take = mixing.fit(lengths, [1] * 10, 750_100)
    assert 750_015 <= sum(n * t for n, t in zip(lengths, take, strict=True)) <= 750_100
    rng = random.Random(8)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 900_000), 9))
        counts = [rng.randrange(1, 3) for _ in lengths]
        budget = rng.randrange(1, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fit(lengths, counts, budget)
        total = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and total <= budget
        # no document that was left out fits any more
        assert not any(t < c and n <= budget - total for n, t, c in zip(lengths, take, counts, strict=True))


def test_variants_broadcast_nothing(spark):
    """Files of words that are small on disk are large once letters and halves are exploded, so no join may go by their size."""
    words = ["abcdef" + x + y for x in "abcdef" for y in "ghij"]
    rows = [(i, " ".join(words)) for i in range(4)]
    execs = spark._jsparkSession.sharedState().statusStore()
    before = execs.executionsCount()
    got = variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.word for r in got.collect()} >= set(words)
    plans = [execs.executionsList().apply(i).physicalPlanDescription() for i in range(before, execs.executionsCount())]
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)
