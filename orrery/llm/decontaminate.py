"""Benchmark decontamination: windows of 13 benchmark words, looked up while scanning documents.

Words are runs of ASCII letters and digits and of anything outside ASCII, with A-Z lowered.  A
window is 13 consecutive words of an item, or the whole item if it has fewer (but any).  The
windows form a hash set: a table of slots by the hash of a window's first three words (or fewer),
each holding the windows that start so.  It is broadcast as one value, whose size is checked
first; documents are then scanned inside their own row with built-in functions, so nothing is
shuffled, no row is made for a hit, and a hot passage costs no more than a rare one.  Above the
bound the windows stay a table and the documents' windows are joined with it by hash.  Very long texts
are read whole; what is held at once is one text's words and, in the join, its windows.

Nulls: a null text has no words, so neither hits nor contamination; a null item id counts as an
item named ``""``.  Empty tables give no rows, or no hits.  Repeated rows are each judged alone, and
repeated items are items of their own only if their ids differ.  Other columns pass unchanged; one named
like an output is replaced by it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shield, marked, settled

WIDTH = 13
#: Largest set of windows that is broadcast: about 10 MB.
BROADCAST_WINDOWS = 100_000
_ANCHOR = 3
#: Parts that a window or text is dealt to that may be everywhere.
SALTS = 16
_HITS = "array<struct<at:int,len:int,items:array<string>>>"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: w (words), items (sorted ids as strings)."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (width - 1)))
    one = item.select("item", F.explode(F.transform(at, lambda i: F.slice("ws", i, width))).alias("w"))
    return one.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _anchor(get, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[get(k) for k in range(n)])


def _covered(hits: Column) -> Column:
    """Words inside any of the hits, which are ordered by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        stop = h["at"] + h["len"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], h["at"]))).alias("n"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def _anchored(wins: DataFrame) -> DataFrame:
    """The windows with the number of their first words that find them and the hash of those."""
    n = F.least(F.size("w"), F.lit(_ANCHOR))
    hashed = F.coalesce(*[F.when(n == k, _anchor(lambda i: F.get("w", F.lit(i)), k)) for k in range(1, _ANCHOR + 1)])
    return wins.select("w", "items", n.alias("n"), hashed.alias("h"))


def _hits_broadcast(docs: DataFrame, wins: DataFrame, count: int) -> DataFrame:
    """``_hits``: array of (at, len, items) in order of at, by looking up inside the row."""
    slots = 1 << max(10, (2 * count - 1).bit_length())
    entries = [(list(r.w), list(r["items"]), r.n, r.h) for r in _anchored(wins).collect()]  # at most broadcast_windows
    by_len = sorted({n for _, _, n, _ in entries})
    if not by_len:
        return docs.withColumn("_hits", F.array().cast(_HITS))
    chains: list[list] = [[] for _ in range(slots)]
    for w, items, _, h in sorted(entries):
        chains[h % slots].append({"w": w, "items": items})
    # folded to plain values once, in the plan, which reaches executors as a broadcast
    tbl = F.from_json(F.lit(json.dumps(chains)), "array<array<struct<w:array<string>,items:array<string>>>>")
    used = F.from_json(F.lit(json.dumps([bool(c) for c in chains])), "array<boolean>")
    ws = F.col("_ws")

    def of_size(k: int) -> Column:
        """Hits of the windows that are found by their first ``k`` words."""

        def slot(i: Column) -> Column:
            return F.pmod(_anchor(lambda j: F.get(ws, i + j), k), F.lit(slots)).cast("int")

        def matches(i: Column) -> Column:
            def fits(e: Column) -> Column:
                return F.forall(F.sequence(F.lit(0), F.size(e["w"]) - 1), lambda j: F.coalesce(F.get(ws, i + j) == F.get(e["w"], j), F.lit(False)))

            return F.transform(F.filter(F.get(tbl, slot(i)), fits), lambda e: F.struct(i.alias("at"), F.size(e["w"]).alias("len"), e["items"].alias("items")))

        places = F.filter(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.get(used, slot(i)))
        return F.flatten(F.transform(F.when(F.size(ws) >= k, places).otherwise(F.array().cast("array<int>")), matches))

    found = [of_size(k) for k in by_len]
    hits = found[0] if len(found) == 1 else F.array_sort(F.concat(*found))
    return docs.withColumn("_hits", hits)


def _hits_joined(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """The same by a shuffle join on the hash of whole windows, for any number of them.

    Hits depend on the words alone, so they are found by the words' digest and copies of a text share them.
    A window is shuffled only if its hash may be a benchmark window's, and a document only if it may have hits;
    both sides of either join are dealt by ``SALTS`` besides, as one passage or text may be everywhere.
    """
    wins = settled(wins, "benchmark-windows")
    ws, salts = F.col("_ws"), F.array(*[F.lit(k) for k in range(SALTS)])
    sizes = [r.n for r in wins.select(F.size("w").alias("n")).distinct().orderBy("n").collect()]  # at most the width of a window
    if not sizes:
        return docs.withColumn("_hits", F.array().cast(_HITS))

    def of_size(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.struct(i.alias("at"), F.slice(ws, i + 1, n).alias("w")))
        return F.when(F.size(ws) >= n, every).otherwise(F.array().cast("array<struct<at:int,w:array<string>>>"))

    keyed = docs.withColumn("_digest", F.sha2(F.array_join(ws, " "), 256))
    spots = keyed.select("_digest", F.explode(F.concat(*map(of_size, sizes))).alias("_spot")).select("_digest", "_spot.*").withColumn("_h", F.xxhash64("w"))
    spots = marked(spots, F.col("_h"), wins.select(F.xxhash64("w").alias("h"))).where("marked").withColumn("_salt", F.pmod(F.xxhash64("_digest", "at"), F.lit(SALTS)).cast("int"))
    spread = wins.select(F.xxhash64("w").alias("_h"), F.col("w").alias("_w"), "items", F.explode(salts).alias("_salt"))
    hit = spots.join(spread, ["_h", "_salt"]).where(F.col("w") == F.col("_w"))
    per = settled(hit.groupBy("_digest").agg(F.array_sort(F.collect_set(F.struct("at", F.size("w").alias("len"), "items"))).alias("_hits")), "benchmark-hits")
    rows = marked(keyed, F.xxhash64("_digest"), per.select(F.xxhash64("_digest").alias("h")))
    # a copy's salt is that of its part of the input, which a repeated task reads again
    some = rows.where("marked").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = some.join(per.withColumn("_salt", F.explode(salts)), ["_digest", "_salt"], "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS)))
    none = rows.where("not marked").withColumn("_hits", F.array().cast(_HITS))
    return none.unionByName(some.drop("_salt")).drop("_digest", "marked")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), hit_spans (word positions) and contaminated.

    A document is contaminated if any word is hit and one word in ``share`` or more is.
    """
    wins = windows(benchmark, width)
    count = wins.limit(broadcast_windows + 1).count()
    shield = Shield(docs, "text")
    base = shield.inner.withColumn("_ws", words(F.col("text")))
    found = _hits_broadcast(base, wins, count) if count <= broadcast_windows else _hits_joined(base, wins)
    found = found.withColumns({"_n": F.size("_ws").cast("bigint"), "_hit": _covered(F.col("_hits")).cast("bigint")})
    return shield.restore(
        found, n_words=F.col("_n"), n_hit=F.col("_hit"), items=F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"])))),
        hit_spans=F.transform("_hits", lambda h: F.struct(h["at"].alias("start"), (h["at"] + h["len"]).alias("end"))),
        contaminated=(F.col("_hit") > 0) & (share * F.col("_hit") >= F.col("_n")),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that aren't contaminated."""
    shield = Shield(docs, "text")
    found = find_contamination(shield.inner, benchmark)
    # a filter would be pushed below the scan of windows and repeat it for every word; a generator isn't
    kept = F.when(F.col("contaminated"), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return shield.restore(found.withColumn("_kept", F.explode(kept)))
