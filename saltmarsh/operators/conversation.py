"""Conversation context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def recent_context(turns: DataFrame, last: int = 6, assistant: str = "Assistant") -> DataFrame:
    """The last messages of every conversation as speaker lines, oldest first.

    Ranks are cut on the map side, so at most ``last`` rows per conversation and
    task are shuffled and the collected list never exceeds ``last`` rows.
    """
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last)
    speaker = F.when(F.col("role") == "user", "User").otherwise(assistant)
    line = F.concat(speaker, F.lit(": "), F.col("text"))
    grouped = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", F.array_join(F.col("lines.line"), "\n").alias("context"))
