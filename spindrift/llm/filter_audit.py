"""What each of several filters removes alone, together, and in every order.

A relational word pipeline: the words of all texts are exploded and counted for each (document, word), and then for each
document, which gives its totals and its distinct words without a list of them. The other flags are outer-joined to
these (documents without words have none): capitals, odd signs, the smallest id with the same text, the labels. Then
five failures are one of 32 patterns, and conditional counts of these, a row for each part, say all: what is left after
any sequence of filters is a sum over patterns, so the 120 orders are never run over documents.

A document in the joins is (id, a hash of its text): rows that share an id are told apart, and rows that repeat both are
one with a number of copies. A document moves to the task that counts its words, copies of it being one before that, so
neither a frequent word nor a group of copies is a hot key. A text is the same as another if its length and SHA-256 are.

Filters, by letter, fail a document: A under ``MIN_WORDS`` words; B distinct words under half of the words; C capitals A-Z
over 3 in 100 code points; D any of ``#$%&*|``; E the text of a smaller id.

Defined cases: null text is empty; a null lang is the part of the empty string; a null id counts as the largest; rows
that repeat id and text fail E if a smaller id has the text, so not for each other; a label counts if any row of labels
with this id has it; an empty table has no parts and so no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import NO_ID, Scratch, hinted

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
ODD_SIGNS = "[#$%&*|]"
_SPACE = " \t\n\x0b\x0c\r"
_PATTERNS = 1 << len(FILTERS)


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text and part. doc_id and tag are the document; no row number is needed, so every scan agrees."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tag, words, distinct of documents that have words.

    Each document moves once, copies of a row not at all; its words are then counted where it is, without moving again.
    """
    once = docs.where(F.btrim("text", F.lit(_SPACE)) != "").groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
    words = once.select("doc_id", "tag", F.explode(F.split(F.btrim("text", F.lit(_SPACE)), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    of_word = words.groupBy("doc_id", "tag", "word").agg(F.count(F.lit(1)).alias("n"))
    return of_word.groupBy("doc_id", "tag").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, tag, part, copies, capitals, odd, digest: a row for each document and part, copies being its rows."""
    text = F.col("text")
    capital = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text)
    digest = F.concat(F.sha2(text.cast("binary"), 256), F.lit(":"), F.octet_length(text))
    rows = docs.select("doc_id", "tag", "part", capital.alias("capitals"), text.rlike(ODD_SIGNS).alias("odd"), digest.alias("digest"))
    return rows.groupBy("doc_id", "tag", "part", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("capitals").alias("capitals"), F.first("odd").alias("odd"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pattern, copies, good, toxic of each document: bit i of pattern is set if filter i fails it."""
    scratch = Scratch(docs.sparkSession)
    rows = _documents(docs)
    known = scratch.keep("flags", flags(rows))
    copied = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    counts = scratch.keep("words", word_counts(rows))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    both = known.join(counts, ["doc_id", "tag"], "left")
    both = both.join(hinted(scratch.keep("copied", copied), 96), "digest", "left").join(marks, "doc_id", "left")
    words = F.coalesce(F.col("words"), F.lit(0))
    fails = {
        "A": words < MIN_WORDS,
        "B": 100 * F.coalesce(F.col("distinct"), F.lit(0)) < DISTINCT_PERCENT * words,
        "C": F.col("capitals"),
        "D": F.col("odd"),
        "E": F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)),
    }
    pattern = sum((fails[f].cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return both.select("part", pattern.alias("pattern"), "copies", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def pattern_counts(failed: DataFrame) -> DataFrame:
    """For each part the 32 conditional counts c0..c31, and those of good and toxic documents g0.., t0.."""
    when = lambda p, more: F.sum(F.when((F.col("pattern") == p) & more, F.col("copies")).otherwise(0))
    kinds = {"c": F.lit(True), "g": F.col("good"), "t": F.col("toxic")}
    return failed.groupBy("part").agg(*(when(p, more).alias(f"{k}{p}") for k, more in kinds.items() for p in range(_PATTERNS)))


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the conditional counts: nothing of it depends on the number of documents.

    What a filter does depends on the set of those before it, not on their order: 80 pairs of a filter and a set, of
    which every order takes five.
    """
    n, session = len(FILTERS), counts.sparkSession
    states = [(f, before) for f in range(n) for before in range(_PATTERNS) if not before >> f & 1]
    # Among the filters that fail a document each comes first in the same share of the orders.
    roles = [(FILTERS[f], before, p, not p >> f & 1, bool(p & before), p == 1 << f, (p >> f & 1) * factorial(n) // max(1, p.bit_count())) for f, before in states for p in range(_PATTERNS)]
    roles = session.createDataFrame(roles, "letter string, before int, pattern int, passes boolean, gone boolean, only boolean, firsts int")
    places = [("".join(x), step, x[step - 1], sum(1 << FILTERS.index(y) for y in x[: step - 1])) for x in permutations(FILTERS) for step in range(1, n + 1)]
    steps = session.createDataFrame(places, "filter_order string, step int, letter string, before int")
    patterns = F.array(*(F.struct(F.lit(p).alias("pattern"), *(F.col(f"{k}{p}").alias(k) for k in "cgt")) for p in range(_PATTERNS)))
    each = counts.select("part", F.explode(patterns).alias("x")).select("part", "x.*").join(F.broadcast(roles), "pattern")  # 2560 rows
    total = lambda value, on: F.sum(F.when(on, F.col(value)).otherwise(0)).cast("long")
    removed = ~F.col("passes") & ~F.col("gone")
    sums = each.groupBy("part", "letter", "before").agg(
        total("c", F.col("passes") & ~F.col("gone")).alias("kept"),
        total("c", removed).alias("removed"),
        total("c", ~F.col("passes") & F.col("gone")).alias("redundant"),
        total("c", F.col("only")).alias("unique_fails"),
        total("g", removed).alias("good_lost"),
        total("t", removed).alias("toxic_lost"),
        F.sum(F.col("c") * F.col("firsts")).cast("long").alias("shapley"),
    )
    out = sums.join(F.broadcast(steps), ["letter", "before"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(Scratch(docs.sparkSession).keep("patterns", pattern_counts(failures(docs, labels))))
