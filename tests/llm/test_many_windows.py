"""Decontamination with more benchmark windows than are broadcast, against plain Python and the broadcast way."""

import re

from pyspark.sql import functions as F

from orrery.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def plain(docs, items):
    lower = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = lower(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = lower(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if of := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= of
        out.append((doc, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str), len(wins)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=str)


def test_above_the_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    # every third document is an item, a passage is in many of them and one item has two words
    passage = " and then the long passage that is in a great many items and documents goes on and on"
    items = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("item_id"), F.concat("text", F.lit(passage)).alias("text"))
    few = spark.createDataFrame([("two", "goes on"), ("none", "..."), (None, "of the, most")], "item_id string, text string")
    copies = docs.limit(1).select("doc_id", F.explode(F.array([F.lit(passage * 2)] * 300)).alias("text"))
    docs, items = docs.unionByName(copies), items.unionByName(few)
    want, n = plain([tuple(r) for r in docs.collect()], [(r.item_id or "", r.text) for r in items.collect()])
    assert n > decontaminate.BROADCAST_WINDOWS
    assert found(decontaminate.find_contamination(docs, items)) == want


def test_both_ways_agree(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{k}.parquet") for k in ("documents", "benchmark"))
    one, other = (found(decontaminate.find_contamination(docs, bench, broadcast_windows=k)) for k in (decontaminate.BROADCAST_WINDOWS, 0))
    assert one == other and any(r[2] for r in one)
