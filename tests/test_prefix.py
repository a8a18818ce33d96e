"""Running sums over ranges, against sums that a loop makes."""

import random

from pyspark.sql import functions as F

from spindrift.operators import prefix
from spindrift.operators.relational import budget_prefix


def _rows(n: int):
    rng = random.Random(5)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", i, rng.choice([None, 0, 1, 7, 100]), rng.random()) for i in range(n)]


def _expected(rows, at: int):
    sums, out = {}, {}
    for key, i, value, _ in sorted(rows, key=lambda r: r[at]):
        sums[key] = sums.get(key, 0) + (value or 0)
        out[i] = sums[key]
    return out


def test_sums_of_each_key_and_of_all(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, "key string, id long, value long, _at double").repartition(5)
    got = {r["id"]: r["total"] for r in prefix.running_sums(df, {"total": F.col("value")}, ["_at"], ["key"]).collect()}
    assert got == _expected(rows, 3)
    every = prefix.running_sums(df, {"total": F.col("value"), "n": F.lit(1)}, ["id"]).collect()
    assert {r["id"]: r["total"] for r in every} == _expected([(None, *r[1:]) for r in rows], 1)
    assert sorted((r["id"], r["n"]) for r in every) == [(i, i + 1) for i in range(3000)]


def test_a_hot_key_spans_ranges(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("key"), "id", F.lit(3).alias("value"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix.ranged(df, ["key", "id"])
        of_hot = [r["count"] for r in placed.where("key = 99").groupBy(prefix.RANGE).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(of_hot) >= 4 and max(of_hot) < 0.4 * 20_000
    before = prefix.before_ranges(placed, {"v": F.col("value")}, ["key"])
    assert before.groupBy("key").count().agg(F.max("count")).first()[0] <= placed.select(prefix.RANGE).distinct().count()


def test_keyed_budget(spark):
    rows = _rows(500)
    df = spark.createDataFrame(rows, "key string, id long, value long, _at double")
    got = {r["id"]: r["running_tokens"] for r in budget_prefix(df, F.coalesce("value", F.lit(0)), ["id"], 900, ["key"]).collect()}
    assert got == {i: s for i, s in _expected(rows, 1).items() if s <= 900}


def test_empty(spark):
    df = spark.createDataFrame([], "key string, id long, value long")
    assert prefix.running_sums(df, {"total": F.col("value")}, ["id"], ["key"]).collect() == []
    assert prefix.running_sums(df, {"total": F.col("value")}, ["id"]).columns == ["key", "id", "value", "total"]
