"""Mixing sources to target weights by fitting the budget as a subset sum.

Each source's target is its weight's share of all words, but at most ``MAX_COPIES`` times what the
source has; what is cut off goes to the others by weight until none is above.  A source gives every
document ``floor(target / size)`` whole copies.  The rest of the budget is filled with one copy more
of some documents: they are counted by exact length, each length gives its even share, and bounded
knapsack dynamic programming over the counts that are left fits what then remains of the budget.
Which documents of a length are taken follows a seeded hash, so reruns agree.

Only (source, length) counts meet in one task.  Ranks are taken within (source, length, salt), the
salt being the leading bits of the hash, so a length that a third of all rows share is split.

Nulls: a null source is a source, the last; a null text has length 0 and takes nothing; a null
doc_id is ranked like any other.  Repeated rows are separate documents.  Ties in the hash go by doc_id.  Empty tables give no
rows.  A text of any length is one document, taken whole.  Other columns pass unchanged; ``mix`` replaces one of that name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shield, settled

WEIGHTS, MAX_COPIES, SEED, SALTS = (5, 2, 1), 3, 17, 64
#: Budgets up to this many words are fitted exactly; above it whole lengths are taken, largest first, until no more is left.
EXACT_WORDS = 1 << 17
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES) -> dict[str | None, float]:
    """The words each source is to give.  Sources by code point, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, left, out = float(sum(sizes.values())), list(order), dict.fromkeys(order, 0.0)
    while left:
        share = budget / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: share * weight[s] for s in left}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            budget -= out[s]
        left = [s for s in left if s not in set(over)]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take for a sum as near below ``budget`` as can be.

    Reachable sums are the bits of one integer; counts are split into powers of two.  The item that
    first reached a sum is noted, which is enough to walk back.
    """
    items = []
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        c, k = min(c, budget // n if n else 0), 1
        while c > 0:
            items.append((i, min(k, c)))
            c, k = c - k, 2 * k
    reach, mask = 1, (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, dtype=np.int64)
    for j, (i, k) in enumerate(items):
        new = (reach << (lengths[i] * k)) & mask & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = j
            reach |= new
            if reach >> budget & 1:
                break
    out, total = [0] * len(lengths), reach.bit_length() - 1
    while total:
        i, k = items[by[total]]
        out[i] += k
        total -= lengths[i] * k
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Documents of each length to take for ``budget`` words in all."""
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not whole:
        return [0] * len(lengths)
    take = [min(c, c * budget // whole) for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left <= EXACT_WORDS:
            break
        if lengths[i]:
            k = min(counts[i] - take[i], (left - EXACT_WORDS // 2) // lengths[i])
            take[i] += max(0, k)
            left -= max(0, k) * lengths[i]
    # texts so long that none left room for the exact fit: the longest that still fits, until the rest can be fitted or none does
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > EXACT_WORDS and lengths[i]:
            k = min(counts[i] - take[i], left // lengths[i])
            take[i] += k
            left -= k * lengths[i]
    # beyond EXACT_WORDS nothing that is left fits
    left = min(left, EXACT_WORDS)
    more = knapsack(lengths, [c - t if n else 0 for n, c, t in zip(lengths, counts, take, strict=True)], left)
    found = [t + m for t, m in zip(take, more, strict=True)]
    if budget <= EXACT_WORDS and sum(n * t for n, t in zip(lengths, found, strict=True)) < budget:
        found = knapsack(lengths, [c if n else 0 for n, c in zip(lengths, counts, strict=True)], budget)  # even shares were in the way
    return found


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``mix`` = struct(size, source_size, target, copies, taken).

    With ``keep_text`` false only doc_id and source are kept, which spares the shuffle of texts.
    """
    shield = Shield(docs if keep_text else docs.select("doc_id", "text", "source"), "doc_id", "text", "source")
    sized = shield.inner.withColumns({"_size": words(F.col("text")), "_h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), "_s": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    sized = sized.withColumn("_salt", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(SALTS)).cast("int"))
    if not keep_text:
        sized = settled(sized.drop("text"), "mix")
    spark = docs.sparkSession
    hist = settled(sized.groupBy("_s", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    # one row a source comes to the driver
    sizes = {None if r._s == "n" else r._s[1:]: int(r.w) for r in hist.groupBy("_s").agg(F.sum(F.col("_size") * F.col("_n")).alias("w")).collect()}
    goals = targets(sizes, weights, cap)
    plan = {}
    for s, target in goals.items():
        copies = min(cap, int(target // sizes[s])) if sizes[s] else 0
        plan["n" if s is None else "s" + s] = (float(target), int(sizes[s]), copies, round(target - copies * sizes[s]) if copies < cap else 0)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_size")
        return rows.assign(_take=fit(rows["_size"].tolist(), rows["_n"].tolist(), plan[key[0]][3]))[["_s", "_size", "_take"]]

    lengths = hist.groupBy("_s", "_size").agg(F.sum("_n").alias("_n"))
    takes = lengths.groupBy("_s").applyInPandas(fill, "_s string, _size bigint, _take bigint")
    before = Window.partitionBy("_s", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = hist.join(takes, ["_s", "_size"]).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    quota = quota.select("_s", "_size", "_salt", F.greatest(F.lit(0), F.least("_n", F.col("_take") - F.col("_before"))).alias("_quota"))
    facts = spark.createDataFrame([(s, *p[:3]) for s, p in plan.items()], "_s string, _target double, _source_size bigint, _base int")
    rank = F.row_number().over(Window.partitionBy("_s", "_size", "_salt").orderBy("_h", "doc_id"))
    # hints: one row a source is broadcast, the counts are joined where the ranks are
    found = sized.withColumn("_rank", rank).join(quota, ["_s", "_size", "_salt"], "left").join(F.broadcast(facts), "_s", "left")
    copies = F.when(F.col("_size") > 0, F.col("_base") + (F.col("_rank") <= F.col("_quota")).cast("int")).otherwise(0)
    mixed = F.struct(F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (F.col("_size") * copies).alias("taken"))
    return shield.restore(found, mix=mixed) if keep_text else found.select("doc_id", "source", mixed.alias("mix"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    shield = Shield(docs, "doc_id", "text", "source")
    taken = mix(shield.inner).where(F.col("mix.copies") > 0)
    return shield.restore(taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))))
