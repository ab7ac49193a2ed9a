"""The queries op3, op4 and op9 against plain versions of what they compute, and the pipeline's stages on odd rows."""

import re
import zlib

import pytest

import corpus_pipeline
from orrery.llm import toxicity, wordpiece
from orrery.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_toxicity_scores_equal_the_machine(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    out = QUERIES["op3_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.score == pytest.approx(machine.score(texts[r.doc_id]), abs=1e-9) and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    """The contract's patterns by ``re``."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]


def test_personal_data_equals_patterns(spark, sf, texts):
    import hashlib

    found = 0
    for r in QUERIES["op4_pii"](spark, sf).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r.spans.split(","))
        found += len(want)
    assert found > 10


def test_token_counts_equal_greedy(spark, sf, texts):
    pieces = set(wordpiece.vocabulary_pieces(vocabulary("byte_bpe_50k.json")))
    longest, letters = max(map(len, pieces)), wordpiece.byte_alphabet()

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            if not size:
                return 1
            n, at = n + 1, at + size
        return n

    known = {}
    for r in QUERIES["op9_token_counts"](spark, sf).collect():
        total = 0
        for chunk in texts[r.doc_id].split():
            if chunk not in known:
                words = wordpiece._WORD.findall(chunk)
                known[chunk] = sum(greedy((wordpiece.PREFIX if i == 0 else "") + "".join(letters[b] for b in w.encode())) for i, w in enumerate(words))
            total += known[chunk]
        assert r.n_tokens == total


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_take_odd_rows(spark, sf, odd, table):
    docs = odd if table == "odd" else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, sf), name)
        assert docs.columns == odd.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and (table == "empty" or docs.count() >= 5)
