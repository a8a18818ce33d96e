"""Learning paths over a repository: entry points, reading order, key concepts, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.paths import basename
from spindrift.functions.patterns import any_part
from spindrift.operators.graph import degrees
from spindrift.operators.relational import complexity, difficulty, numbered, top_k, top_k_per_key

ENTRY_SYMBOLS, ENTRY_PATHS = ("main", "__main__", "cli", "run"), ("main", "app", "index", "cli", "run")


def _names(n: int) -> Column:
    """The first n names of a group in order of id."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct("id", "name"))), 1, n), lambda x: x["name"])


def entry_points(symbols: DataFrame, file_edges: DataFrame, k: int = 10) -> DataFrame:
    """file_path, score, symbols, rank: twice the incoming edges if over 3, 5 for under 3 outgoing ones, 20 for each
    entry symbol, 10 for an entry name in the path; only scores over 10."""
    edges = degrees(file_edges.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))).withColumnRenamed("node", "file_path")
    entries = F.count_if(F.lower("name").isin(*ENTRY_SYMBOLS))
    files = symbols.groupBy("file_path").agg(entries.alias("n_entry"), _names(5).alias("symbols")).join(edges, "file_path", "left").na.fill(0, ["n_in", "n_out"])
    score = F.when(F.col("n_in") > 3, 2 * F.col("n_in")).otherwise(0) + F.when(F.col("n_out") < 3, 5).otherwise(0) + 20 * F.col("n_entry") + F.when(any_part(F.lower("file_path"), ENTRY_PATHS), 10).otherwise(0)
    return top_k(files.select("file_path", score.alias("score"), "symbols").where("score > 10"), [F.desc("score"), F.col("file_path")], k)


def reading_order(symbols: DataFrame, file_edges: DataFrame, k: int = 30) -> DataFrame:
    """file_path, title, priority, complexity, difficulty, n_symbols, rank: three for each distinct file that depends on
    it, less one for each that it depends on and a fifth of its complexity."""
    used = file_edges.groupBy(F.col("dst_path").alias("file_path")).agg(F.count_distinct("src_path").alias("n_in"))
    uses = file_edges.groupBy(F.col("src_path").alias("file_path")).agg(F.count_distinct("dst_path").alias("n_out"))
    sizes = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))
    files = complexity(symbols).join(sizes, "file_path").join(used, "file_path", "left").join(uses, "file_path", "left").na.fill(0, ["n_in", "n_out"])
    priority = 3 * F.col("n_in") - F.col("n_out") - F.floor(F.col("complexity") / 5)
    files = files.select("file_path", basename(F.col("file_path")).alias("title"), priority.alias("priority"), "complexity", difficulty(F.col("complexity")).alias("difficulty"), "n_symbols")
    return top_k(files, [F.desc("priority"), F.col("file_path")], k)


def key_concepts(symbols: DataFrame, k: int = 20) -> DataFrame:
    """name, n, rank of public classes and functions by frequency."""
    public = symbols.where(F.col("kind").isin("class", "function") & (F.col("name") != "") & ~F.col("name").startswith("_"))
    return top_k(public.groupBy("name").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("name")], k)


def by_difficulty(symbols: DataFrame, k: int = 10) -> DataFrame:
    """difficulty, file_path, rank: the first k files of each level in order of path."""
    files = complexity(symbols).select("file_path", difficulty(F.col("complexity")).alias("difficulty"))
    return top_k_per_key(files, ["difficulty"], ["file_path"], k)


def learning_path(symbols: DataFrame, file_edges: DataFrame) -> dict[str, DataFrame]:
    return {"recommended_order": reading_order(symbols, file_edges), "entry_points": entry_points(symbols, file_edges), "key_concepts": key_concepts(symbols), "difficulty_levels": by_difficulty(symbols)}


def module_path(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, complexity, symbols, rank of a module's files (column file_path), simplest first."""
    own = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi")
    named = own.groupBy("file_path").agg(_names(5).alias("symbols"))
    return numbered(complexity(own).join(named, "file_path"), ["complexity", "file_path"], "rank")


def outline(symbols: DataFrame) -> DataFrame:
    """Symbols with parent_id: a method hangs on the last class that starts above it in its file."""
    window = W.partitionBy("file_path").orderBy("line_start", "id").rowsBetween(W.unboundedPreceding, 0)
    above = F.last(F.when(F.col("kind") == "class", F.col("id")), ignorenulls=True).over(window)
    return symbols.withColumn("parent_id", F.when(F.col("kind") == "method", above))
