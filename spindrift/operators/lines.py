"""Operators over numbered lines of files: runs, context windows, breakpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.text import line_importance


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, no (from 1), line of texts cut at newlines."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("no"), "line")


def low_runs(lines: DataFrame, key: str, most: int = 4, least: int = 3) -> DataFrame:
    """key, first, last, n of runs of at least three lines of equal importance, of at most `most`: gaps and islands."""
    scored = lines.withColumn("importance", line_importance(F.col("line"))).where(F.col("importance") <= most)
    island = F.col("no") - F.row_number().over(W.partitionBy(key, "importance").orderBy("no"))
    return scored.withColumn("_g", island).groupBy(key, "importance", "_g").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key, "importance", "first", "last", "n")


def around(lines: DataFrame, key: str, k: int = 2) -> DataFrame:
    """Lines with the text of up to k lines before and after."""
    window = W.partitionBy(key).orderBy("no").rowsBetween(-k, k)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(window), "\n"))


def breakpoint_score(line, after, is_edge):
    """3 for definitions, decorators and the file's edge, 2 for two blank lines, 1 for one."""
    blank = F.trim(line) == ""
    return F.when(is_edge | line.rlike(r"^\s*(def |class |async def |@)"), 3).when(blank & (F.trim(after) == ""), 2).when(blank, 1).otherwise(0)


def expand(lines: DataFrame, key: str, start: int, stop: int, reach: int = 30) -> DataFrame:
    """key, start, stop of a view moved outward to the best breakpoint within reach; of equal ones the nearest."""
    window = W.partitionBy(key).orderBy("no")
    size = F.max("no").over(W.partitionBy(key))
    scored = lines.withColumn("size", size).withColumn("score", breakpoint_score(F.col("line"), F.lead("line", 1, "x").over(window), (F.col("no") == 1) | (F.col("no") == size)))
    up = F.col("no").between(start - reach, start)
    down = F.col("no").between(stop, stop + reach)
    best = lambda side, sign: F.max_by(F.when(side, F.col("no")), F.when(side & (F.col("score") > 0), F.struct(F.col("score"), sign * F.col("no"))))
    out = scored.groupBy(key).agg(best(up, 1).alias("a"), best(down, -1).alias("b"), F.max("no").alias("size"))
    return out.select(key, F.coalesce("a", F.lit(start)).alias("start"), F.coalesce("b", F.least(F.lit(stop), F.col("size"))).alias("stop"))


def head_tail_split(lines: DataFrame, key: str, budget: int, head: float = 0.6, tail: float = 0.3) -> DataFrame:
    """Lines of the first half whose running tokens stay under a share of the budget, and of the second half from the
    end: key, no, part."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    cost = F.floor((F.length("line") + 1) / 4)
    marked = lines.withColumn("_first", F.col("no") <= F.floor(n / 2)).withColumn("_cost", cost)
    ahead = W.partitionBy(key, "_first").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(key, "_first").orderBy(F.desc("no")).rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("_a", F.sum("_cost").over(ahead)).withColumn("_b", F.sum("_cost").over(back))
    part = F.when(F.col("_first") & (F.col("_a") < head * budget), "head").when(~F.col("_first") & (F.col("_b") < tail * budget), "tail")
    return marked.select(key, "no", part.alias("part")).where(F.col("part").isNotNull())


def _collapsed(lines: DataFrame, key: str, max_tokens: int, most: int = 4, least: int = 3) -> DataFrame:
    """key, no, line, fits: lines with runs of equal low importance as markers, from importance 1 up to the first level at
    which the file is within the budget.

    Runs of different levels share no line, so the sizes at all levels come from one aggregate over the lines, and the
    level is chosen before a line is dropped.
    """
    scored = lines.withColumn("_importance", line_importance(F.col("line")))
    scored = scored.withColumn("_island", F.col("no") - F.row_number().over(W.partitionBy(key, "_importance").orderBy("no")))
    run = W.partitionBy(key, "_importance", "_island")
    scored = scored.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_first", F.col("no") == F.min("no").over(run))
    scored = scored.withColumn("_level", F.when((F.col("_importance") <= most) & (F.col("_n") >= least), F.col("_importance")).otherwise(most + 1))
    indent = F.regexp_extract("line", r"^\s*", 0)
    scored = scored.withColumn("_marker", F.concat(indent, F.lit("# ... ["), F.col("_n").cast("string"), F.lit(" lines omitted] ...")))

    def size(level: int):
        gone = F.col("_level") <= level
        return F.floor((F.sum(F.when(~gone, F.length("line") + 1).when(F.col("_first"), F.length("_marker") + 1).otherwise(0)) - 1) / 4)

    sizes = scored.groupBy(key).agg(*[size(x).alias(f"_size{x}") for x in range(most + 1)])
    fitting = F.coalesce(*[F.when(F.col(f"_size{x}") <= max_tokens, x) for x in range(most + 1)])
    chosen = sizes.select(F.col(key).alias("_key"), F.coalesce(fitting, F.lit(most)).alias("_chosen"), fitting.isNotNull().alias("fits"))
    out = scored.join(chosen, F.col(key).eqNullSafe(F.col("_key")))
    gone = F.col("_level") <= F.col("_chosen")
    return out.where(~gone | F.col("_first")).select(key, "no", F.when(gone, F.col("_marker")).otherwise(F.col("line")).alias("line"), "fits")


def truncated(docs: DataFrame, key: str, text: str, max_tokens: int, reserve: int = 100) -> DataFrame:
    """key, text of code within about max_tokens: runs of three or more lines of equal low importance become a marker, the
    least important first; of a file that is still too long the head and the tail stay. key tells the rows apart; null
    text stays null."""
    lines = _collapsed(numbered(docs.where(F.col(text).isNotNull()), key, text), key, max_tokens)
    short = lines.where("fits").select(key, "no", "line")
    order = W.partitionBy(key).orderBy("no")
    long = lines.where("NOT fits").select(key, F.row_number().over(order).alias("no"), "line")
    ends = head_tail_split(long, key, max_tokens - reserve).withColumnRenamed("no", "_no").withColumnRenamed(key, "_key")
    parted = long.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("no") == F.col("_no")), "left")
    counts = parted.groupBy(key).agg(F.count_if(F.col("part").isNull()).alias("_gone"), F.coalesce(F.max(F.when(F.col("part") == "head", F.col("no"))), F.lit(0)).alias("_last"))
    note = F.concat(F.lit("\n# ... ["), F.col("_gone").cast("string"), F.lit(" lines omitted for brevity] ...\n"))
    kept = parted.where(F.col("part").isNotNull()).select(key, F.col("no").cast("double").alias("no"), "line")
    kept = kept.unionByName(counts.select(key, (F.col("_last") + 0.5).alias("no"), note.alias("line")))
    every = short.select(key, F.col("no").cast("double").alias("no"), "line").unionByName(kept)
    out = every.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.unionByName(docs.where(F.col(text).isNull()).select(key, F.lit(None).cast("string").alias("text")))


def kept_ranges(docs: DataFrame, key: str, text: str, ranges: DataFrame, max_tokens: int, head: int = 10, imports: int = 50) -> DataFrame:
    """key, text: truncated, after files over the budget are reduced to their first lines, imports among the first ones
    and the line ranges (key, first, last) that must stay, with a marker in each gap. Files without a range are not
    reduced before."""
    big = docs.where(F.floor(F.length(text) / 4) > max_tokens)
    wanted = ranges.where("first >= 1 AND last >= first").select(F.col(key).alias("_key"), "first", "last")
    lines = numbered(big, key, text).join(wanted.select("_key").distinct(), F.col(key) == F.col("_key"), "left_semi")
    inside = lines.join(wanted, (F.col(key) == F.col("_key")) & F.col("no").between(F.col("first"), F.col("last")), "left_semi")
    front = lines.where((F.col("no") <= head) | ((F.col("no") <= imports) & F.col("line").rlike(r"^\s*(import|from|using|#include)")))
    kept = inside.unionByName(front).distinct()
    before = F.coalesce(F.lag("no").over(W.partitionBy(key).orderBy("no")), F.lit(0))
    marked = kept.withColumn("_gap", F.when(F.col("no") > before + 1, F.format_string("# ... [lines %d - %d omitted] ...\n", before + 1, F.col("no") - 1)).otherwise(""))
    reduced = marked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.concat("_gap", "line").alias("line")))), lambda x: x["line"]), "\n").alias("_reduced"))
    both = docs.select(F.col(key), F.col(text).alias("_text")).join(reduced.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    return truncated(both.select(key, F.coalesce("_reduced", "_text").alias("text")), key, "text", max_tokens)
