"""How filters of a corpus interact: what each removes in every order of applying them.

Five filters give every document a mask of five bits (1: it fails).  For each part of the corpus and
each of three kinds of documents (all, good, toxic) the audit sums 32 signed parities,
``W[k] = sum of (-1)^popcount(mask & k)``, in one aggregation whose result is as small as the number of
parts.  The Walsh-Hadamard transform is its own inverse up to the factor 32, so the sums give the exact
count of each mask, and from these 32 counts follow the figures of all 120 orders of the filters without
another pass, and Shapley values in closed form: of the 120 orders a document that fails f filters is
removed in 120 / f by each of them.

Filters: A under 100 words, B fewer than 80% of the words distinct, C more than 10% of the code points
in A-Z, D any of ``MARKS``, E the text of some smaller doc_id.  Words are maximal runs of anything but
ASCII white space, compared with case.

E compares SHA-256 digests: copies are first added up per digest, part and labels within each task, so a text that
a third of all rows share is a few rows when it is shuffled, and the least id of a digest is a minimum
over those.

Nulls: a null text is empty (fails A only, or E); a null part is the empty string; a row with a null
doc_id has no smaller or greater id, so it never fails E nor makes others fail, and has no labels.
Repeated rows count each time; equal ids with equal texts don't fail each other.  A document is good or
toxic if any row of ``labels`` says so.  An empty table gives no rows.  A text of any length counts
whole (its words are held in memory).  Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, text_or_empty

FILTERS, WORDS, DISTINCT, CAPITALS, MARKS = "ABCDE", 100, 80, 10, "#$%&*|"
KINDS = ("all", "good", "toxic")
_SPACE = "[ \\t-\\r]+"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")

    def bits(w: Column) -> Column:
        n, capitals = F.size(w), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        fails = (n < WORDS, 100 * F.size(F.array_distinct(w)) < DISTINCT * n, 100 * capitals.cast("bigint") > CAPITALS * F.length(text), text.rlike(f"[{MARKS}]"))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    # a lambda over an array of one element, so that the words are split once
    return F.get(F.transform(F.array(words), bits), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, good, toxic, mask and n (documents) for documents of equal texts, parts and labels."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), failures(text).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # the repeats of an id are one row, and null ids are spread by their texts
    ids = rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    spread = ids.withColumns({"_id": F.coalesce("doc_id", F.xxhash64("digest")), "_known": F.col("doc_id").isNotNull()})
    said = spread.join(marks.withColumnsRenamed({"doc_id": "_id"}).withColumn("_known", F.lit(True)), ["_id", "_known"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unknown = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    alike = said.groupBy("digest", "part", "good", "toxic", "bits").agg(F.sum("n").alias("n"), least.alias("least"), unknown.alias("unknown"))
    # a digest has as many rows here as parts and labels
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    both = alike.withColumn("first", first)
    original = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    cells = F.array(F.struct(F.col("bits").alias("mask"), original.alias("n")), F.struct((F.col("bits") + e).alias("mask"), (F.col("n") - original).alias("n")))
    return both.select("part", "good", "toxic", F.inline(cells)).where("n > 0")


def parities(cells: DataFrame) -> DataFrame:
    """part, kind and the 32 signed parity sums."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))
    sign = lambda k: 1 - 2 * F.bit_count(F.col("mask").bitwiseAND(F.lit(k))).bitwiseAND(F.lit(1))
    sums = [F.sum(F.col("n") * sign(k)).alias(f"w{k}") for k in range(1 << len(FILTERS))]
    return cells.select("part", "mask", "n", F.explode(kinds).alias("kind")).groupBy("part", "kind").agg(*sums)


def counts(sums: DataFrame) -> DataFrame:
    """The exact counts of the 32 masks, by inverting the sums: part and an array for each kind."""
    size = 1 << len(FILTERS)
    every = F.array(*[F.col(f"w{k}") for k in range(size)])
    even = lambda m, k: 1 - 2 * F.bit_count(m.bitwiseAND(k)).bitwiseAND(F.lit(1))
    cell = lambda m: F.aggregate(F.transform(F.col("w"), lambda x, k: x * even(m, k)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    inverse = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.shiftright(cell(m), len(FILTERS)))
    cells = sums.select("part", "kind", every.alias("w")).select("part", "kind", inverse.alias("cells"))
    none = F.array(*[F.lit(0).cast("bigint")] * size)
    return cells.groupBy("part").agg(*[F.coalesce(F.first(F.when(F.col("kind") == k, F.col("cells")), ignorenulls=True), none).alias(k) for k in KINDS])


def orders(counted: DataFrame) -> DataFrame:
    """For every part, order and step what the filter of that step removes."""
    every = ["".join(p) for p in permutations(FILTERS)]
    rows = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, every)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda name: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), name) - 1)
    at = lambda s: F.substring(F.col("filter_order"), s, F.lit(1))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, s: a + F.when(s < F.col("step"), bit(at(s))).otherwise(0))
    rows = rows.withColumns({"_own": bit(at(F.col("step"))), "_before": before})
    own, earlier = F.col("_own"), F.col("_before")

    def total(kind: str, counted_in) -> Column:
        """Sum over the masks m of counted_in(m) times the count of m."""
        return F.aggregate(F.transform(F.col(kind), lambda n, m: n * counted_in(m)), F.lit(0).cast("bigint"), lambda a, x: a + x)

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    one = lambda c: c.cast("int")
    here = lambda m: one(has(m, own) & ~has(m, earlier))
    share = lambda m: F.when(has(m, own), F.lit(120) / F.bit_count(m)).otherwise(0).cast("int")
    return rows.select(
        "part", "filter_order", "step", total("all", lambda m: one(~has(m, own.bitwiseOR(earlier)))).alias("kept"), total("all", here).alias("removed"),
        total("all", lambda m: one(has(m, own) & has(m, earlier))).alias("redundant"), total("all", lambda m: one(m == own)).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(counts(parities(masks(docs, labels, part))))
