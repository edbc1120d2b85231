"""A small seeded sample of golden messages with their best past case, for reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_handles
from ..operators.neighbours import knn
from ..operators.sampling import seeded_head


def spot_check(golden: DataFrame, corpus: DataFrame, taxonomy: Sequence[str], n: int = 20, seed: object = 42) -> DataFrame:
    """``n`` in-taxonomy messages, each with the best case of its gold intent.

    The sample is drawn first, so only ``n`` messages are searched for.
    ``golden``: id, gold_intent, difficulty_tier, customer_text, embedding;
    ``corpus``: vec_id, embedding, silver_intent, clean_text, brand_reply_text.
    """
    picked = seeded_head(golden.filter(F.col("gold_intent").isin(*taxonomy)), "id", n, seed)
    hits = knn(picked, corpus, 1, scopes=F.array("gold_intent"), corpus_scope=F.col("silver_intent"), taxonomy=taxonomy)
    cases = corpus.select("vec_id", F.col("clean_text").alias("retrieved_query"), F.col("brand_reply_text").alias("retrieved_reply"))
    found = hits.join(cases, "vec_id").select("id", F.col("vec_id").alias("hit_id"), "retrieved_query", "retrieved_reply", "similarity")
    return picked.select("id", "gold_intent", "difficulty_tier", strip_handles(F.col("customer_text")).alias("query")).join(
        found, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
