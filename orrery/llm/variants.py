"""Spelling variants by anagram hashing.

A word's key is the sum of a power of its letters' code points, so it doesn't depend on their order and
one edit changes it by a known value: an added or removed letter by that letter's power, an exchanged one
by the difference of two.  Words whose keys differ by such a value are candidates, and their letter order
decides.  Two keys that differ by an exchange, k + v(b) = k' + v(a), are equal once each word's own letter
is taken off, so a word is joined by its *reduced* keys, one for each of its distinct letters, which stand
for the exchanges with any letter of any alphabet; against the whole keys of words with one letter less
they stand for additions and removals.

Words built of the same syllables are anagrams of each other by the thousand.  One edit leaves the first half
or the second half of the shorter word as it is, so the join's key also names a half and carries its
letters; each near pair meets in exactly one of the two.

Words are counted in one aggregation with partial sums, so a frequent word is one row a task before the
shuffle.  Each word has at most as many near words as there are edits of it.  Joins say that they merge: by the
compressed files, which is all that Spark knows, it would broadcast tables that are a hundred times as large once
letters and halves are exploded.

Nulls: a null text has no words; a null doc_id is written as nothing in the hash.  Repeated rows count
each time.  Ties between near words of equal count go to the smallest in code-point order.  An empty
table gives no rows.  Texts and runs of any length count whole (a text's words are held in memory).  Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_or_empty

RUN, LETTERS, LEAST_COUNT, TIMES, SLIP = "[A-Za-z\\x{00C0}-\\x{00FF}]+", 5, 3, 2, 97
#: The power of a letter's code point, and the modulus that keeps sums of any length in 62 bits.
POWER, MODULUS = 5, (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, after one letter is dropped from every ``SLIP``-th run (by a hash of id and run)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("d", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("w"))
    hashed = low.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def value(letter: Column) -> Column:
    """The power of a letter, as a long."""
    code = F.ascii(letter).cast("bigint")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def keyed(words: DataFrame) -> DataFrame:
    """``words`` with key, and letters (the distinct ones)."""
    chars = F.split("word", "")
    key = F.aggregate(F.transform(chars, value), F.lit(0).cast("bigint"), lambda a, v: F.pmod(a + v, F.lit(MODULUS)))
    return words.select("word", "n", F.length("word").alias("len"), key.alias("key"), F.array_distinct(chars).alias("letters"))


def _halves(length: Column) -> Column:
    """The halves of which one edit leaves at least one: of ``length`` letters (those of the shorter word)."""
    half = F.shiftright(length, 1)
    return F.array(F.struct(F.lit(0).alias("half"), F.substring(F.col("word"), F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("half"), F.substring(F.col("word"), F.col("len") - (length - half) + 1, length - half).alias("part")))


def one_edit(a: Column, b: Column, most: int = 100) -> Column:
    """Whether b is a with one letter added or exchanged.  The built-in distance takes time by the square of the
    length, so words of over ``most`` letters are compared letter by letter up to the first difference and after it."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False)).cast("int")
    after = F.substring(a, at + 1 - (F.length(b) - F.length(a)), F.length(a)) == F.substring(b, at + 1, F.length(b))
    return F.when(F.length(b) <= most, F.levenshtein(a, b, 1) == 1).otherwise((at > 0) & after)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, na, nb: words one edit apart, every pair in both directions once."""
    known = settled(keyed(words), "words")
    reduced = known.select("word", "n", "len", F.explode("letters").alias("letter"), "key").withColumn("key", F.pmod(F.col("key") - value(F.col("letter")), F.lit(MODULUS)))

    def side(rows: DataFrame, length: Column, name: str) -> DataFrame:
        """Rows by the half that a partner shares: key, size (of the shorter word), half and part."""
        return rows.select("key", length.alias("size"), F.inline(_halves(length)), F.col("word").alias(name), F.col("n").alias(f"n{name}"))

    on, a, b = ["key", "size", "half", "part"], F.col("a"), F.col("b")
    first = lambda w: F.substring(w, F.lit(1), F.shiftright(F.col("size"), 1))
    once = (F.col("half") == 0) | (first(a) != first(b))  # a pair that shares both halves meets in the first
    apart = once & one_edit(a, b)
    exchanged = side(reduced, F.col("len"), "a").join(side(reduced, F.col("len"), "b").hint("merge"), on).where((a != b) & apart)
    shorter = side(known, F.col("len"), "a").join(side(reduced, F.col("len") - 1, "b").hint("merge"), on).where(apart)
    pairs = shorter.select("a", "b", "na", "nb")
    return exchanged.select("a", "b", "na", "nb").unionAll(pairs).unionAll(pairs.select(b.alias("a"), a.alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n: the near word of largest count, where it counts ``TIMES`` as much."""
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b")))
    near = near_pairs(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near.withColumnRenamed("a", "word").hint("merge"), "word", "left")
    more = -F.col("best.less") >= TIMES * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(more, F.col("best.b")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``.

    Forms at least double the count, so chains end; following them doubles the steps each round.
    """
    rows = settled(forms(settled(word_counts(docs), "counts")), "forms")
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("beyond")).hint("merge"), "root", "left")
        steps = settled(ahead.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    roots = steps.select("word", "root")
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
