"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every operator."""

import hashlib

import pytest

from orrery.llm import chat, decontaminate, fingerprints, jaccard, lines, mixing, pii, tokenfile, toxicity, wordpiece
from orrery.llm.queries import vocabulary


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, odd):
    return odd if request.param == "odd" else odd.limit(0)


def rows(df):
    return sorted(df.collect(), key=str)


def test_chat(spark):
    t = [(1, 0, "user", None), (1, 1, "assistant", "<|end|> <\\|x ok"), (1, 1, "assistant", "<|end|> <\\|x ok"), (2, None, None, "x"), (None, 0, "assistant", "")]
    df = spark.createDataFrame(t, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as formatted", "'z' as loss_mask")
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(df, vocabulary("byte_bpe_50k.json"))).collect()}
    text = "<|end|> <\\|x ok"
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 * len(text) and out[1].loss_sha256 == hashlib.sha256((2 * text).encode()).hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert out[2].loss_chars == 0 and out[None].n_turns == 1
    assert chat.digests(chat.format_chats(df.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_jaccard(docs):
    out = rows(jaccard.jaccard_classes(docs))
    assert len(out) == docs.count()
    if out:
        four = sorted((r.class_id, r.n_links) for r in out if r.doc_id in (4, 5))
        assert four == [(4, 0), (4, 2), (4, 2), (4, 2)]
        assert all(r.class_id == r.doc_id and r.n_links == 0 for r in out if r.doc_id not in (4, 5))
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == (7 if out else 0)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0 and out.count() == docs.count()
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_pii(docs):
    out = pii.find_pii(docs)
    assert out.count() == docs.count() and out.where("spans is null or size(base_spans) > 0").count() == 0


def test_mixing(docs):
    out = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    assert len(out) == docs.count() and all(r.taken <= 3 * r.size for r in out)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in out)


def test_fingerprints(docs):
    out = rows(fingerprints.fingerprints(docs))
    assert len(out) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    if out:
        copies = max(by, key=lambda k: k[1] if k[0] == 4 else 0)
        assert len(by[copies]) == 1 and by[1, 0] == by[2, 0] == by[6, 4]


def test_tokens(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    out = sorted(tokenfile.token_output(docs, vocabulary("word_bpe_49k.json"), path=path).collect(), key=lambda r: r.start)
    assert len(out) == docs.count() and sum(r.n_tokens for r in out) == (out[-1].start + out[-1].n_tokens if out else 0)
    found = tokenfile.lookup(spark, path, [4, 1, 77]).collect()
    assert sorted(r.doc_id for r in found) == ([1, 4, 4, 4] if out else []) and all(r.ids[-1] == 2 for r in found)


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, "TWO three, four"), (2, None), (3, ""), (4, "id"), (1, "two three four")], "item_id bigint, text string")
    out = {(r.doc_id, r.n_words): r for r in decontaminate.find_contamination(docs, bench).collect()}
    joined = {(r.doc_id, r.n_words): r for r in decontaminate.find_contamination(docs, bench, broadcast_windows=0).collect()}
    assert {k: (v.n_hit, v["items"], v.contaminated) for k, v in out.items()} == {k: (v.n_hit, v["items"], v.contaminated) for k, v in joined.items()}
    if out:
        assert out[4, 14].n_hit == 3 and out[4, 14]["items"] == ["1"] and out[4, 14].contaminated and out[None, 4]["items"] == ["4"] and not out[1, 0].contaminated
    kept = decontaminate.drop_contaminated(docs, bench.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_token_counts(docs):
    out = wordpiece.token_counts(docs, vocabulary("byte_bpe_50k.json"))
    assert out.count() == docs.count() and out.where("text is null and n_tokens <> 0").count() == 0


def test_lines(docs):
    out = {(r.doc_id, r.text): r for r in lines.dedup_lines(docs).collect()}
    assert lines.dedup_lines(docs).count() == docs.count()
    if out:
        assert out[1, None].n_lines == 1 and out[6, " \n \t"].n_dropped == 0 and all(r.n_dropped == 0 for r in out.values() if r.doc_id == 4)


def test_names_in_another_case_and_odd_types(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text", (3,), 0.5)], "doc_id bigint, text string, s struct<`a b`:int>, Score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    out = toxicity.score(df, toxicity.train(df, labels))
    out.write.parquet(str(tmp_path / "t"))
    assert out.columns == ["doc_id", "text", "s", "score", "predicted"] and out.first().predicted == 0
    assert pii.find_pii(df).first().s[0] == 3 and wordpiece.token_counts(df, vocabulary("byte_bpe_50k.json")).first().s[0] == 3


def test_labels_of_one_kind_reject_nothing(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(odd, labels).count() == odd.count()


def test_session_settings_stay(spark, odd, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokenfile.token_output(odd, vocabulary("word_bpe_49k.json"), path=str(tmp_path / "t")).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
