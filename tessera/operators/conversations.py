"""Token-bounded conversation windows. Messages: conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def accepted(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin("user", "assistant"))


def token_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(X.tokens(F.col("text"))).alias("tokens"))


def window(messages: DataFrame, budget: Column) -> DataFrame:
    """Newest messages up to the first that does not fit, oldest first: (conv_id, n, context)."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = accepted(messages).withColumn("used", F.sum(X.tokens(F.col("text"))).over(newest)).where(F.col("used") <= budget)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("xs"))
    return rows.select("conv_id", F.size("xs").cast("long").alias("n"), F.array_join(F.transform("xs", lambda x: x["l"]), "\n").alias("context"))


def topic_window(messages: DataFrame, topics: DataFrame, budget: int) -> DataFrame:
    """topics: conv_id, topic. The topic's line comes first and its tokens off the budget."""
    head = F.concat(F.lit("Topic: "), "topic")
    with_topic = messages.join(topics, "conv_id", "left")
    own = window(with_topic, F.lit(budget) - F.coalesce(X.tokens(head), F.lit(0)))
    return own.join(topics, "conv_id", "left").select("conv_id", "n", F.concat_ws("\n", head, "context").alias("context"))


def topic_states(replies: DataFrame) -> DataFrame:
    """replies: conv_id, turn, is_new_topic, summary. The topic after every turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("is_new_topic") & (F.coalesce("summary", F.lit("")) != ""), F.col("summary"))
    return replies.select("conv_id", "turn", F.last(new, ignorenulls=True).over(w).alias("topic"))
