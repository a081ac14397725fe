"""Conversations: windows of turns, summaries, last words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T


def window_summary(turns: DataFrame, most: int = 20, chars: int = 100) -> DataFrame:
    """(conv_id, n_turns, n_kept, summary): the newest turns stay, the first ``chars`` of each earlier one are joined."""
    n = F.count(F.lit(1)).over(W.partitionBy("conv_id"))
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    old = F.when(F.col("k") <= F.col("n") - most, F.struct("turn", F.substring("text", 1, chars).alias("s")))
    rows = turns.withColumn("n", n).withColumn("k", k)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.least(F.count(F.lit(1)), F.lit(most)).alias("n_kept"), F.array_join(F.transform(F.sort_array(F.collect_list(old)), lambda x: x["s"]), " | ").alias("summary"))


def recent(turns: DataFrame, most: int = 4) -> DataFrame:
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("k", k).where(F.col("k") <= most).drop("k")


def last_words(turns: DataFrame, chars: int = 100) -> DataFrame:
    """(conv_id, n_turns, last_query, last_response, last_time): of the last user and assistant turns, and the last time that any turn names."""
    last = lambda role: F.substring(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), 1, chars)
    t = T.query_seconds(F.col("text"))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), last("user").alias("last_query"), last("assistant").alias("last_response"), F.max_by(t, F.when(t.isNotNull(), F.col("turn"))).alias("last_time"))
