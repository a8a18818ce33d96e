"""Running sums over sorted ranges, so that no task holds a whole table or a whole key.

A window over a key puts all of its rows into one task. Here rows are sorted into ranges by key and order and written
with the number of their range; the sums of each key within each range, a row for each pair of them, give what lies
before a range, and the rows of a range only add up among themselves. A key with most of the rows spans as many tasks as
it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.graph import Rounds

#: The column with the number of a row's range.
RANGE = "_range"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a written table with the number of each row's range; ranges ascend in the order of the columns."""
    return Rounds(df.sparkSession).keep(df.orderBy(*order).withColumn(RANGE, F.spark_partition_id()))


def before_ranges(placed: DataFrame, values: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """keys, range, and for each name of values ``_own_name``, the sum within the range, and ``_before_name``, that of the
    ranges before it. One row for each key and range, so a window over a key has no more rows than there are ranges."""
    keys = keys or []
    own = placed.groupBy(*keys, RANGE).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"_own_{n}") for n, v in values.items()))
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return own.select("*", *(F.coalesce(F.sum(f"_own_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values))


def running_sums(df: DataFrame, values: dict[str, Column], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with the sum of each of values (by name) over the rows of the same key up to and including each row.

    order is ascending, nulls first, and should be total within a key; rows that it does not tell apart stand in any
    order. Null keys are a key; null values count as 0.
    """
    keys = keys or []
    placed = ranged(df, [*keys, *order])
    before = before_ranges(placed, values, keys).select(F.col(RANGE).alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(f"_before_{n}" for n in values))
    same = F.col(RANGE) == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = W.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = placed.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_within_{n}") for n, v in values.items()))
    return sums.join(before, same).select(*df.columns, *((F.col(f"_before_{n}") + F.col(f"_within_{n}")).alias(n) for n in values))
