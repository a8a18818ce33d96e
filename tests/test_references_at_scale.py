"""References meet few names however many share their short grams, and no side of the join is broadcast."""

from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import substrings


def test_pairs_grow_with_the_input(spark):
    """Numbers in all names: any three digits stand in a hundredth of them."""
    most = []
    for n in (10_000, 100_000):
        names = spark.range(n).select(F.concat(F.lit("mod.part_"), F.col("id").cast("string")).alias("name"))
        refs = spark.range(0, 7 * n, 700).select(F.concat(F.lit("part_"), F.col("id").cast("string")).alias("ref"))
        wanted, met = substrings.meeting(refs, names)
        most.append(wanted.join(met, ["gram", "part"]).count() / refs.count())
        assert substrings.unheld(refs, names).count() == refs.count() - -(-n // 700)
    assert most[1] < 3 * most[0]


def test_no_side_is_broadcast(spark):
    docs = spark.createDataFrame([(1, "# T\n## A\n`mod.part_7` and `mod.part_9x`")], "doc_id long, md string")
    names = spark.createDataFrame([("pkg.mod.part_7_x",)], "name string")
    out = text.doc_issues(docs, "doc_id", "md", names)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["issue"] for r in out.collect()] == ["[WARNING] Referenced 'mod.part_9x' not found in codebase (may be external)"]
