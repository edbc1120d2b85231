"""Linking customer messages to agent replies.

Messages carry ``msg_id``, ``author``, ``inbound`` (boolean), ``text`` and a
nullable ``parent_id`` (the message replied to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brand_messages(msgs: DataFrame, brand: str, author: str = "author") -> DataFrame:
    return msgs.filter(F.col(author) == brand)


def replies_to_brand(msgs: DataFrame, brand: str) -> DataFrame:
    """Inbound messages that answer (or, never in practice, are written by) the brand."""
    inbound = msgs.filter("inbound")
    brand_ids = brand_messages(msgs, brand).select(F.col("msg_id").alias("_brand_id"))
    answering = inbound.filter(F.coalesce(F.col("author") != brand, F.lit(True))).join(
        brand_ids, F.col("parent_id") == F.col("_brand_id"), "left_semi")
    return answering.unionByName(brand_messages(inbound, brand))


def recoverable_roots(msgs: DataFrame, brand: str) -> DataFrame:
    """Inbound messages present in the dump that some brand message answers."""
    targets = (
        brand_messages(msgs, brand).filter(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("_target")).distinct()
    )
    return msgs.filter("inbound").join(targets, F.col("msg_id") == F.col("_target"), "left_semi")


def minus_by_id(rows: DataFrame, known: DataFrame, id_col: str = "msg_id", known_id: str | None = None) -> DataFrame:
    """Rows whose id is not in ``known``; a null id is kept.

    Ids of different types are compared as text.  Equal types are compared as
    they are, so a join that already spread the rows by id is reused.
    """
    known_id = known_id or id_col
    same = rows.schema[id_col].dataType == known.schema[known_id].dataType
    left, right = (F.col(id_col), F.col(known_id)) if same else (F.col(id_col).cast("string"), F.col(known_id).cast("string"))
    ids = known.select(right.alias("_known")).distinct()
    return rows.join(ids, left == F.col("_known"), "left_anti")


def inbound_union(msgs: DataFrame, brand: str) -> DataFrame:
    """Replies to the brand plus the root messages not already among them.

    Which messages belong is decided on the id columns alone; the texts are spread once, by message id, for
    the final semi-join, in which a message that qualifies twice counts once.  Only messages with a parent are
    looked up by it, so thread starters, which have none, never meet under one key.
    """
    brand_rows = brand_messages(msgs, brand)
    written = brand_rows.select(F.col("msg_id").alias("_written")).distinct()
    answered = brand_rows.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_answered")).distinct()
    inbound = msgs.filter("inbound")
    answering = inbound.filter(F.col("parent_id").isNotNull()).select("msg_id", "parent_id").join(
        written, F.col("parent_id") == F.col("_written"), "left_semi").select(F.col("msg_id").alias("_kept"))
    own = brand_messages(inbound, brand).select(F.col("msg_id").alias("_kept"))
    kept = answering.union(answered.select(F.col("_answered").alias("_kept"))).union(own)
    return inbound.join(kept, F.col("msg_id") == F.col("_kept"), "left_semi")


def first_replies(msgs: DataFrame, brand: str, order: Column | None = None) -> DataFrame:
    """(parent_id, brand_reply): the earliest brand reply per answered message.

    ``min_by`` merges map-side, so a message with very many replies stays cheap.
    """
    key = order if order is not None else F.col("msg_id")
    return (
        brand_messages(msgs, brand).filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id").agg(F.min_by("text", key).alias("brand_reply"))
    )


def attach_first_reply(pool: DataFrame, msgs: DataFrame, brand: str, order: Column | None = None) -> DataFrame:
    """Left-join the first brand reply; unanswered messages keep a null."""
    replies = first_replies(msgs, brand, order).withColumnRenamed("parent_id", "_parent")
    return pool.join(replies, F.col("msg_id") == F.col("_parent"), "left").drop("_parent")


def brand_profile(msgs: DataFrame, brand_col: str, thread_col: str, redirect: Column, visible: Column) -> DataFrame:
    """Volume and reply quality per brand.

    Messages are first counted per (brand, thread); the thread rows then
    aggregate per brand, so no distinct count is needed.
    """
    outbound = ~F.col("inbound")
    threads = msgs.groupBy(brand_col, thread_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("inbound")).alias("inbound"),
        F.count_if(outbound).alias("outbound"),
        F.count_if(outbound & redirect).alias("redirects"),
        F.count_if(outbound & visible).alias("visible"),
    )
    return threads.groupBy(brand_col).agg(
        F.count(F.lit(1)).alias("threads"),
        F.sum("inbound").alias("inbound"),
        F.sum("outbound").alias("outbound"),
        F.round(F.avg("n"), 6).alias("avg_thread_length"),
        F.round(F.coalesce(F.try_divide(F.sum("redirects").cast("double"), F.sum("outbound")), F.lit(0.0)), 6).alias("redirect_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("visible").cast("double"), F.sum("outbound")), F.lit(0.0)), 6).alias("visible_rate"),
    )
