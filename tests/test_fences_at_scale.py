"""Fences are found in a few texts at a time."""

from pyspark.sql import functions as F

from spindrift.functions import text


def test_batches_of_texts_are_bounded(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 100), F.lit("\n```mermaid\ngraph\n```\n")).alias("md"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        out = text.fenced_blocks(docs, "doc_id", "md")
        assert int(spark.conf.get(key)) <= 512
        assert out.where("start_line = 2 AND content = 'graph'").count() == 3000
    finally:
        spark.conf.set(key, before)
