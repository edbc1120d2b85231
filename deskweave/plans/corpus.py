"""From the message dump to the corpus of visible resolutions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions.replies import visible_resolution
from ..functions.rules import Rule, weak_label
from ..functions.text import is_inbound, language_guess, long_enough, sanitize_newlines, strip_handles
from ..operators.links import attach_first_reply, inbound_union, minus_by_id
from ..sources.tables import sink_table


@dataclass(frozen=True)
class CorpusRules:
    brand: str
    intents: Sequence[Rule] = d.INTENT_RULES
    exclude: Rule | None = d.FEATURE_REQUEST
    redirect: Rule = d.DM_REDIRECT
    min_text: int = d.MIN_TEXT_LEN
    min_reply: int = d.MIN_REPLY_LEN
    min_ascii: float = d.MIN_ASCII_RATIO


def messages_from_dump(dump: DataFrame) -> DataFrame:
    """The all-text dump as typed messages; ids stay text."""
    return dump.select(
        F.col("tweet_id").alias("msg_id"), F.col("author_id").alias("author"),
        is_inbound(F.col("inbound")).alias("inbound"), "text", F.col("in_response_to_tweet_id").alias("parent_id"))


def build_pool(msgs: DataFrame, golden_ids: DataFrame, rules: CorpusRules, reply_order: Column | None = None,
               golden_id: str = "msg_id") -> DataFrame:
    """Usable customer messages outside the golden set with their first reply and weak label.

    The text filters are plain expressions on the message rows, so they run in
    the scan stage, before any of the id joins.
    """
    usable = (
        inbound_union(msgs, rules.brand)
        .filter(language_guess(F.col("text"), rules.min_ascii) == "en_likely")
        .withColumn("clean_text", strip_handles(F.col("text")))
        .filter(long_enough(F.col("clean_text"), rules.min_text))
        .select("msg_id", "clean_text")
    )
    pool = minus_by_id(usable, golden_ids, "msg_id", golden_id)
    answered = attach_first_reply(pool, msgs, rules.brand, reply_order)
    return answered.select(
        "msg_id", "clean_text", "brand_reply",
        weak_label(F.col("clean_text"), rules.intents, rules.exclude).alias("silver_intent"),
        visible_resolution(F.col("brand_reply"), rules.redirect, rules.min_reply).alias("visible"))


def _members() -> Column:
    """One test over both sides of the reply join: the label patterns run only on messages whose reply qualifies,
    instead of being pushed down to the scan of all messages."""
    return F.when((F.length("brand_reply") > 0) & F.col("visible"), F.col("silver_intent").isNotNull())


def _corpus_rows(pool: DataFrame) -> DataFrame:
    return pool.select(
        F.col("msg_id").alias("tweet_id"),
        sanitize_newlines(F.col("clean_text")).alias("clean_text"),
        sanitize_newlines(F.col("brand_reply")).alias("brand_reply_text"),
        "silver_intent")


def build_corpus(msgs: DataFrame, golden_ids: DataFrame, rules: CorpusRules, reply_order: Column | None = None,
                 golden_id: str = "msg_id") -> DataFrame:
    """(tweet_id, clean_text, brand_reply_text, silver_intent) on one line per text."""
    return _corpus_rows(build_pool(msgs, golden_ids, rules, reply_order, golden_id).filter(_members()))


def store_corpus(spark: SparkSession, path: str, msgs: DataFrame, golden_ids: DataFrame, rules: CorpusRules, reply_order: Column | None = None,
                 golden_id: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """(the corpus stored at ``path`` by intent, its measures), from one pass over the messages.

    Measures: pool_rows, corpus_rows and coverage, and why the others were left out: unanswered, not_resolving
    (the reply is no visible resolution), unlabelled.  They are observed on the rows as these are written.
    A lost executor may make some rows pass twice; the count of the stored rows shows that, and the
    measures are then counted anew.
    """
    def observed(pool: DataFrame, seen: Observation | None) -> DataFrame:
        reply, fine = F.length("brand_reply") > 0, F.coalesce("visible", F.lit(False))
        why = (F.when(F.coalesce(~reply, F.lit(True)), "unanswered").when(~fine, "not_resolving")
               .when(F.col("silver_intent").isNull(), "unlabelled").otherwise("kept"))
        marked = pool.withColumn("why", why)
        counts = [F.count(F.lit(1)).alias("pool_rows"), F.count_if(F.col("why") == "kept").alias("corpus_rows"),
                  *[F.count_if(F.col("why") == x).alias(x) for x in ("unanswered", "not_resolving", "unlabelled")]]
        return marked.observe(seen, *counts) if seen else marked.agg(*counts)

    pool, seen = build_pool(msgs, golden_ids, rules, reply_order, golden_id), Observation("corpus")
    sink_table(_corpus_rows(observed(pool, seen).filter("why = 'kept'")), path, partition_by=["silver_intent"])
    corpus = spark.read.schema("tweet_id " + dict(pool.dtypes)["msg_id"] + ", clean_text string, brand_reply_text string, silver_intent string").parquet(path)
    held = seen.get
    if corpus.count() != held["corpus_rows"]:
        held = observed(pool, None).first().asDict()
    share = held["corpus_rows"] / held["pool_rows"] if held["pool_rows"] else 0.0
    names = ["pool_rows", "corpus_rows", "unanswered", "not_resolving", "unlabelled"]
    measures = spark.createDataFrame([(*[held[n] for n in names], share)], ", ".join(f"{n} bigint" for n in names) + ", share double")
    return corpus, measures.select("pool_rows", "corpus_rows", F.round("share", 6).alias("coverage"), *names[2:])
