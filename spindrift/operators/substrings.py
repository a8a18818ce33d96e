"""Which strings are held by others, as a join that is not all with all.

A string that holds another holds each of its grams, so the two meet at one of them: the one that the fewest strings have, by a
count over all of them. A reference with a gram that no string has is held by none. Strings that share the gram are verified on
their texts. References of ``LONG`` characters or more meet at longer grams, of which far fewer strings have any one. A gram that very many strings have, even as the rarest of a reference, is salted: its strings are dealt to
parts, each of which gets the references.

Compressed tables look small to the planner and have many grams, so these joins are shuffled and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, and of one of a longer reference, and strings of one gram that one key holds.
SIZE, LONG, PART = 3, 8, 20_000


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct runs of some characters, a shorter text being one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not broadcast."""
    return df.hint("shuffle_merge")


def meeting(refs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, gram, part) of references whose grams all occur, and (name, gram, part) of the names that they meet there.

    refs: ref, of ``SIZE`` characters at least. names: name. Both distinct.
    """
    both = lambda c: F.when(F.length(c) < LONG, grams(F.col(c))).otherwise(F.array_union(grams(F.col(c)), grams(F.col(c), LONG)))
    posted = names.select("name", F.explode(both("name")).alias("gram"))
    own = F.when(F.length("ref") < LONG, grams(F.col("ref"))).otherwise(grams(F.col("ref"), LONG))
    asked = refs.select("ref", F.explode(own).alias("gram"))
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(shuffled(counts), "gram", "left")
    best = asked.groupBy("ref").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("x")).where("x.n > 0")
    parts = F.ceil(F.col("n") / PART).cast("int")
    best = best.select("ref", "x.gram", "x.n").withColumn("parts", parts)
    wanted = best.select("ref", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = posted.join(shuffled(best.groupBy("gram").agg(F.max("parts").alias("parts"))), "gram")
    return wanted, met.select("name", "gram", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))


def unheld(refs: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct values of ref that no value of name holds. Null and refs under ``SIZE`` characters are not judged."""
    refs = refs.select("ref").where(F.length("ref") >= SIZE).distinct()
    wanted, met = meeting(refs, names.select("name").where("name IS NOT NULL").distinct())
    same = (wanted["gram"] == met["gram"]) & (wanted["part"] == met["part"]) & met["name"].contains(wanted["ref"])
    held = wanted.join(shuffled(met), same, "left_semi").select("ref").distinct()
    return refs.join(shuffled(held), "ref", "left_anti")
