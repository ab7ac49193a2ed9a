"""Ranges of fingerprints: neighbours across them, and ids of many rows, against plain versions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import fingerprints as fp


def docs(spark, ids, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 12)))) for i in ids]


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_neighbours_across_ranges(spark, parts):
    rows = docs(spark, random.Random(5).sample(range(-500, 500), 60))
    out = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), parts=parts).collect()}
    ring = sorted(rows, reverse=True)
    assert len(out) == len(rows)
    for (i, text), (j, after) in zip(ring, ring[1:] + ring[:1], strict=True):
        half = len(text) // 2
        assert out[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        a, b = (bytes.fromhex(out[k].fingerprint) for k in (i, j))
        assert out[i].near_next == pytest.approx(sum(a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)) / fp.SAMPLES)


def _placed(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    k, h = fp._keys(df)
    df = df.withColumns({"_k": k, "_h": h})
    bounds = fp._ranges(df, parts)
    return bounds, [(r._k, r._h, r.at) for r in df.select("_k", "_h", fp._range_of(bounds).alias("at")).collect()]


@pytest.mark.parametrize("hot", [None, 7, 2**60 + 1])
def test_a_hot_id_fills_several_ranges(spark, hot):
    rows = [(i, f"text {i}") for i in range(400)] + [(hot, f"another {i}") for i in range(200)]
    bounds, placed = _placed(spark, rows, 12)
    assert len(bounds) == 11
    for k, h, at in placed:
        assert at == sum(b <= (k, h) for b in bounds)
    assert max(Counter(at for *_, at in placed).values()) <= 100  # 50 on average


def test_hot_ids_keep_all_rows(spark):
    rows = [(None, f"text {i}") for i in range(40)] + [(5, "same")] * 30 + docs(spark, range(30))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fp.fingerprints(df, parts=9)
    assert out.groupBy("doc_id", "n_chars").count().exceptAll(df.groupBy("doc_id", F.length("text").cast("bigint").alias("n_chars")).count()).count() == 0 and out.count() == len(rows)
    # equal rows follow each other
    assert {r.near_next for r in out.where("doc_id = 5 and n_chars = 4").collect()} >= {1.0}
