"""Table maintenance as DataFrame rewrites: upserts, ignores, cascades, caches, checkpoints, incremental updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """old with the rows of new whose key it lacks; of equal new keys the first in order."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return old.unionByName(fresh.select(*old.columns))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """old with new rows in place of those with their key; of equal new keys the last in order."""
    last = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old merged with new by key, column by column: a new value wins unless it is null or its column is one to keep."""
    out = old.alias("o").join(new.alias("n"), keys, "full_outer")
    columns: list[Column | str] = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in new.columns:
            columns.append(F.col(f"o.{c}"))
        else:
            a, b = (f"o.{c}", f"n.{c}") if c in keep else (f"n.{c}", f"o.{c}")
            columns.append(F.coalesce(F.col(a), F.col(b)).alias(c))
    return out.select(*columns)


def cascade_delete(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with null columns of the given types where it has none of the name."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; order lists the columns that sort it first."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def valid_cache(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries younger than their time to live."""
    return cache.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there yet (stages without a checkpoint, modules without a document)."""
    return wanted.join(existing.select(*keys), keys, "left_anti")


def changed_paths(diff: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of a name-status diff (column line, separated by tabs) that still exist; of renames the new one."""
    parts = F.split("line", "\t")
    path = F.when(F.element_at(parts, 1).startswith("R"), F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(parts, F.lit(2)))
    return diff.select(path.alias("path")).where(F.col("path").isNotNull()).distinct().join(files.select("path"), "path", "left_semi")


def update_plan(impacted: DataFrame, diffs: DataFrame, max_modules: int = 12, max_chars: int = 12_000) -> DataFrame:
    """One row: n_modules, largest diff, and whether to update these modules or to build everything anew."""
    n = impacted.agg(F.count(F.lit(1)).alias("n_modules"))
    size = diffs.agg(F.coalesce(F.max(F.length("diff")), F.lit(0)).alias("largest_diff"))
    out = n.crossJoin(size)  # one row each
    return out.withColumn("mode", F.when(F.col("n_modules").between(1, max_modules) & (F.col("largest_diff") <= max_chars), "incremental").otherwise("full"))


def throttled(progress: DataFrame, key: str, ts: str, percent: str, order: list[str], seconds: int = 2) -> DataFrame:
    """Rows that report something: the first of a key, a changed percentage, or seconds since the row before."""
    window = W.partitionBy(key).orderBy(ts, *order)
    return progress.where(F.lit(True)).withColumn("_p", F.lag(percent).over(window)).withColumn("_t", F.lag(ts).over(window)).where(F.col("_t").isNull() | ~F.col(percent).eqNullSafe(F.col("_p")) | (F.col(ts) >= F.col("_t") + F.expr(f"INTERVAL {seconds} SECONDS"))).drop("_p", "_t")


def free_port(taken: DataFrame, first: int = 9100, last: int = 9199) -> DataFrame:
    """One row: the smallest port of a range that is not taken (null if all are)."""
    ports = taken.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("port"))
    return ports.join(taken.select("port"), "port", "left_anti").agg(F.min("port").alias("port"))
