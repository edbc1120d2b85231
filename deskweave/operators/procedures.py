"""Procedure library as a table and its coverage of the messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.defaults import Sop
from ..functions.sops import match_sop


def sop_table(spark: SparkSession, sops: Sequence[Sop]) -> DataFrame:
    """(intent, sop_rank, sop_id, name, triggers, steps)."""
    ranks: dict[str, int] = {}
    rows = []
    for s in sops:
        rank = ranks.get(s.intent, 0)
        ranks[s.intent] = rank + 1
        rows.append((s.intent, rank, s.sop_id, s.name, list(s.triggers), list(s.steps)))
    return spark.createDataFrame(
        rows, "intent string, sop_rank int, sop_id string, name string, triggers array<string>, steps array<string>")


def sop_match(df: DataFrame, intent: str, text: str, sops: Sequence[Sop], name: str = "sop") -> DataFrame:
    """Add the matching procedure as struct ``name``; the text is lower-cased once per row."""
    lowered = df.withColumn("_lowered", F.lower(text))
    return lowered.withColumn(name, match_sop(F.col(intent), F.col("_lowered"), sops)).drop("_lowered")


def sop_inventory(messages: DataFrame, intent: str, sops: Sequence[Sop]) -> DataFrame:
    """Procedures and messages per intent, with a 'total' row."""
    available = F.coalesce(*[
        F.when(F.col(intent) == name, F.lit(sum(s.intent == name for s in sops)))
        for name in dict.fromkeys(s.intent for s in sops)], F.lit(0))
    per = messages.groupBy(intent).agg(F.count(F.lit(1)).alias("messages")).withColumn("n_sops", available)
    rolled = per.rollup(intent).agg(
        F.sum("messages").alias("messages"), F.sum("n_sops").alias("n_sops"), F.grouping(intent).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(intent)).alias("intent"), "messages", "n_sops")
