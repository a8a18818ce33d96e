"""Job states and usage totals as bounded tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE, TERMINAL = ("queued", "running"), ("success", "failed", "canceled")


def latest_states(jobs: DataFrame) -> DataFrame:
    """job_id, status, progress, ts of each job's last row; progress is clamped to 0 and 100."""
    last = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq")).alias("x")
    state = jobs.groupBy("job_id").agg(last).select("job_id", "x.status", "x.progress", "x.ts")
    return state.withColumn("progress", F.least(F.greatest("progress", F.lit(0)), F.lit(100)))


def active(states: DataFrame) -> DataFrame:
    return states.where(F.col("status").isin(*ACTIVE))


def transitions(jobs: DataFrame) -> DataFrame:
    """job_id, seq, previous, status of each change of state."""
    window = W.partitionBy("job_id").orderBy("ts", "seq")
    out = jobs.withColumn("previous", F.lag("status").over(window))
    return out.where(~F.col("status").eqNullSafe(F.col("previous"))).select("job_id", "seq", "previous", "status")


def usage_stream(usage: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Usage totals for each kind and window of a stream (or a table) with created_at; late rows wait for delay."""
    marked = usage.withWatermark("created_at", delay) if usage.isStreaming else usage
    return marked.groupBy(F.window("created_at", window).alias("w"), "kind").agg(F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "total_tokens", "n")


def state_stream(jobs: DataFrame) -> DataFrame:
    """A stream of job rows as the latest state of each job, kept in the state store (update mode)."""
    return jobs.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), F.struct("ts", "seq")).alias("x"), F.max("ts").alias("ts")).select("job_id", "x.status", "x.progress", "ts")
