"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is its words (runs without white space, lower-cased) with their counts as weights.  For
each of ``SAMPLES`` samples every word draws, from a hash of itself, r and c from Gamma(2, 1) and b
from the uniform distribution; with t = floor(ln w / r + b) the word with the least
ln c - r (t - b + 1) is the sample, and two documents agree on (word, t) with a probability equal to
their generalised Jaccard similarity.  A fingerprint keeps 16 bits of each sample; the likeness of two
is the share of places in which they agree.

Plan: texts are shuffled once, by ranges of doc_id and, for an id of many rows, of a hash of the text; a
range is found by binary search among the bounds.  The neighbour in descending order is a ``lead``
within a range, and for a range's last row as much as it needs of the first row of the range below.  Words are exploded, counted
and reduced to minima inside the same partitioning, without another shuffle; the samples are wide
columns of plain arithmetic and table look-ups, and their minima are aggregated as integers whose
leading bits are the quantity to minimise and whose last bits name (word, t).

Nulls: a null text is empty; a null doc_id counts as the least long, so it comes last in descending order.
A text without words has one empty word, so all such texts agree.  Rows with the same doc_id are ordered
by a hash of the text, then by the text, and stay apart; a single row is its own neighbour; an empty table
gives no rows.  A text is held whole by the task that works on it, however long.  Rows equal in doc_id and
text share a range.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 60
_BITS = 8
_GROUP = 6


def _gamma_quantile(p: float) -> float:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x); by bisection."""
    low, high = 0.0, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if -math.expm1(-mid) - mid * math.exp(-mid) < p else (low, mid)
    return high


def _table(values: list[float]) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _keys(docs: DataFrame) -> list[Column]:
    """What rows are ordered by, rising: doc_id from the greatest to the least with null as the least long, then a hash of the text."""
    return [F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit((1 << 63) - 1)), F.shiftrightunsigned(F.xxhash64("text"), 1)]


def _ranges(rows: DataFrame, count: int) -> list[tuple[int, int]]:
    """Bounds of about equal ranges of ``_k`` and ``_h``: ``count`` - 1 pairs, whatever the table's size.

    A value that is several bounds at once fills ranges of its own; the hash of the text splits them.
    """
    at = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx("_k", at, max(10_000, 4 * count))).first()[0] if at else None
    times = Counter(found or [])
    hot = [v for v, n in times.items() if n > 1]
    # quantiles are doubles inside: of longs that are one double the most frequent is meant
    near = rows.where(F.col("_k").cast("double").isin([float(v) for v in hot])).groupBy(F.col("_k").cast("double").alias("d")).agg(F.mode("_k", True).alias("k")) if hot else None
    exact = {r.d: r.k for r in near.collect()} if hot else {}  # a row a bound at most
    return sorted((exact.get(float(v), v), j * (1 << 63) // n) for v, n in times.items() for j in range(n))


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds come before a row, or at it: a binary search."""
    if not bounds:
        return F.lit(0)
    first, second = _longs([k for k, _ in bounds]), _longs([h for _, h in bounds])

    def step(at: Column, by: Column) -> Column:
        k, h = F.get(first, at + by - 1), F.get(second, at + by - 1)  # null beyond the last
        return F.when((k < F.col("_k")) | (k == F.col("_k")) & (h <= F.col("_h")), at + by).otherwise(at)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), step)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, Column]:
    """_part, _nth, doc_id, text, n_chars and what replaces its end: the next text, or as much of it as is needed."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    k, h = _keys(docs)
    bounds = _ranges(docs.select(k.alias("_k")), parts)
    rows = docs.withColumns({"_k": k, "_h": h})
    # a range is a task: its name hashes to its own number, while hashes of the numbers would put several into one
    names = _names(docs.sparkSession, len(bounds) + 1)
    rows = rows.withColumn("_part", F.coalesce(F.get(names, _range_of(bounds)), F.lit(0))).repartition(len(bounds) + 1, "_part")
    # the order's columns are made again after the shuffle: every use of the rows then reads the same shuffled columns, so that there is one shuffle
    rows = rows.select("_part", "doc_id", "text").withColumns({"_k": k, "_h": h})
    order = Window.partitionBy("_part").orderBy("_k", "_h", "text")
    rows = rows.withColumns({"_nth": F.row_number().over(order), "_lead": F.lead("text").over(order)}).drop("_k", "_h")
    lasts = rows.where("_lead is null").select("_part", F.floor(F.length("text") / 2).cast("int").alias("_need"))
    heads = rows.where("_nth = 1").select("_part", F.col("text").alias("_head"))
    after = _following(lasts, heads, names).select("_part", F.substring("_head", F.lit(1), F.col("_need")).alias("_head"))
    return rows.join(after, "_part").withColumn("next", F.coalesce("_lead", "_head")).drop("_lead", "_head"), names


def _names(spark: SparkSession, count: int) -> Column:
    """For each of ``count`` partitions an integer that Spark's partitioning sends there."""
    named = spark.range(64 * count).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("nth")).agg(F.min("id").alias("id"))
    found = {r.nth: r.id for r in named.collect()}  # a row a partition
    return F.array(*[F.lit(found.get(k, 64 * count + k)) for k in range(count)])


def _following(ranges: DataFrame, heads: DataFrame, names: Column) -> DataFrame:
    """``ranges`` with the other columns of ``heads`` for the range after, and of the first for the last.

    Only the ranges' names, a number each, come into one task; what they hold is joined.
    """
    nth = Window.orderBy(F.array_position(names, F.col("_part")))
    whole = nth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = ranges.select("_part").withColumn("_after", F.coalesce(F.lead("_part").over(nth), F.first("_part").over(whole)))
    return ranges.join(ring, "_part").join(heads.withColumnRenamed("_part", "_after"), "_after").drop("_after")


def _samples(h: Column, weight: Column, samples: int) -> list[Column]:
    """Per sample an integer: what is minimised in the leading bits, a name of (word, t) in the last."""
    size = 1 << _BITS
    mids = [(i + 0.5) / size for i in range(size)]  # small tables: they are part of the plan, once a sample
    gamma = [_gamma_quantile(p) for p in mids]
    r_table, r_inverse = _table(gamma), _table([1 / g for g in gamma])
    c_table = _table(list(map(math.log, gamma)))
    tail = _table([math.log(_gamma_quantile(p / size)) for p in mids])  # finer where the minimum lies
    out = []
    for k in range(samples):
        u = F.xxhash64(h, F.lit(k))
        r_at = u.bitwiseAND(F.lit(size - 1)).cast("int")
        c_at = F.shiftrightunsigned(u, _BITS).bitwiseAND(F.lit(size - 1)).cast("int")
        more = F.xxhash64(h, F.lit(-1 - k)).bitwiseAND(F.lit(size - 1)).cast("int")
        c = F.when(c_at == 0, tail[more]).otherwise(c_table[c_at])
        b = F.shiftrightunsigned(u, 2 * _BITS).bitwiseAND(F.lit((1 << 24) - 1)).cast("double") * F.lit(2.0**-24)
        t = F.floor(weight * r_inverse[r_at] + b)
        a = c - r_table[r_at] * (t.cast("double") - b + F.lit(1.0))
        name = F.shiftrightunsigned(u, 48).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFF))
        out.append(F.shiftleft(F.floor((a + F.lit(128.0)) * F.lit(float(1 << 38))), 16).bitwiseOR(name).alias(f"s{k}"))
    return out


def _likeness(a: Column, b: Column, samples: int) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last ``floor(n_chars / 2)`` code points are replaced by as many
    from the beginning of the next document in descending order of doc_id.
    """
    spark = docs.sparkSession
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, names = _with_next(docs, parts)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    rows = rows.select("_part", "_nth", "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))

    both = rows.select("_part", "_nth", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    words = both.select("_part", "_nth", "x.which", F.explode_outer(_words(F.col("x.t"))).alias("word"))
    # a word that both texts hold equally often draws once for both
    counts = words.groupBy("_part", "_nth", F.xxhash64("word").alias("h")).agg(*[F.count(F.when(F.col("which") == k, 1)).alias(f"n{k}") for k in (0, 1)])
    kinds = [F.struct(F.lit(k).alias("which"), n.alias("n")) for k, n in ((2, F.col("n0")), (0, F.col("n0")), (1, F.col("n1")))]
    own = F.when(F.col("n1") == 0, F.array(kinds[1])).when(F.col("n0") == 0, F.array(kinds[2])).otherwise(F.array(*kinds[1:]))
    counted = counts.select("_part", "_nth", "h", F.explode(F.when(F.col("n0") == F.col("n1"), F.array(kinds[0])).otherwise(own)).alias("x")).select("_part", "_nth", "x.which", "h", "x.n")
    # a row draws _GROUP samples, not all: a longer method of generated code is never compiled
    groups = range(-(-samples // _GROUP))
    weighted = counted.select("_part", "_nth", "which", "h", F.coalesce(F.ln(F.col("n").cast("double")), F.lit(0.0)).alias("w"), F.explode(F.array(*map(F.lit, groups))).alias("g"))
    drawn = weighted.select("_part", "_nth", "which", "g", F.xxhash64("h", "g").alias("hg"), "w").select("_part", "_nth", "which", "g", *_samples(F.col("hg"), F.col("w"), _GROUP))
    least = drawn.groupBy("_part", "_nth", "which", "g").agg(*[F.min(f"s{k}").alias(f"s{k}") for k in range(_GROUP)])

    def marked(which: int) -> Column:
        own = [F.min(F.when(F.col("which") != 1 - which, F.col(f"s{k}"))) for k in range(_GROUP)]
        return F.array(*[s.bitwiseAND(F.lit(0xFFFF)).cast("int") for s in own]).alias(f"m{which}")

    short = least.groupBy("_part", "_nth", "g").agg(marked(0), marked(1))

    def whole(which: int) -> Column:
        return F.slice(F.concat(*[F.any_value(F.when(F.col("g") == g, F.col(f"m{which}")), True) for g in groups]), 1, samples)

    marks = short.groupBy("_part", "_nth").agg(whole(0).alias("f0"), whole(1).alias("f1"))

    order = Window.partitionBy("_part").orderBy("_nth")
    heads = marks.where("_nth = 1").select("_part", F.col("f0").alias("_head"))
    marks = marks.withColumn("_lead", F.lead("f0").over(order)).join(_following(rows.where("_nth = 1").select("_part"), heads, names), "_part")
    facts = rows.select("_part", "_nth", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))

    def text(f: str) -> Column:
        return F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")

    return facts.join(marks, ["_part", "_nth"]).select(
        "doc_id", "n_chars", "edited_sha256", text("f0").alias("fingerprint"), text("f1").alias("edited_fingerprint"),
        _likeness(F.col("f0"), F.col("f1"), samples).alias("near_edited"), _likeness(F.col("f0"), F.coalesce("_lead", "_head"), samples).alias("near_next"),
    )
