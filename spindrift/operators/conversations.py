"""Conversations as message rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.text import preview, tokens


def overview(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages, title (first user message, 50 characters), preview (last user message, 100 characters)."""
    user = F.when(F.col("role") == "user", F.col("text"))
    grouped = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min_by(user, F.when(F.col("role") == "user", F.col("turn"))).alias("first"),
        F.max_by(user, F.when(F.col("role") == "user", F.col("turn"))).alias("last"),
    )
    return grouped.select("conv_id", "n_messages", F.coalesce(preview(F.col("first"), 50), F.lit("New conversation")).alias("title"), F.coalesce(F.substring("last", 1, 100), F.lit("")).alias("preview"))


def context(messages: DataFrame, max_messages: int = 10, max_tokens: int = 4000) -> DataFrame:
    """conv_id, turn, role, text of the last messages of each conversation, from the end on while their tokens stay
    within the budget."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= max_messages)
    running = F.sum(tokens(F.col("text"))).over(back.rowsBetween(W.unboundedPreceding, 0))
    return recent.withColumn("_sum", running).where(F.col("_sum") <= max_tokens).select("conv_id", "turn", "role", "text")


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with new ones (conv_id, role, text, seq) behind the last turn of their conversation."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    order = W.partitionBy("conv_id").orderBy("seq")
    added = new.join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).cast("long").alias("turn"), "role", "text")
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def cleared(messages: DataFrame, conv_ids: list) -> DataFrame:
    """Messages without those of some conversations."""
    return messages.where(~F.col("conv_id").isin(*conv_ids))
