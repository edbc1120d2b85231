"""Reply-graph joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as r
from ..operators import links as k
from ..operators import metrics as m
from ..operators import sketches as sk
from . import views as v
from .registry import query
from .sources import scratch
from .text import FIRST_REPLY
from .views import hit, with_

IS_REPLY = "inbound AND (author = 'assistant' OR parent_id IN (SELECT msg_id FROM msgs WHERE author = 'assistant'))"
IS_ROOT = "inbound AND msg_id IN (SELECT parent_id FROM msgs WHERE author = 'assistant' AND parent_id IS NOT NULL)"


@query("replies_to_brand", with_(v.MSGS) + f"SELECT msg_id, parent_id FROM msgs WHERE {IS_REPLY}")
def _(t):
    return k.replies_to_brand(v.msgs(t), v.BRAND).select("msg_id", "parent_id")


@query("recoverable_roots", with_(v.MSGS) + f"SELECT msg_id, text FROM msgs WHERE {IS_ROOT}")
def _(t):
    return k.recoverable_roots(v.msgs(t), v.BRAND).select("msg_id", "text")


@query("root_minus_orig", with_(v.MSGS) + f"SELECT msg_id FROM msgs WHERE {IS_ROOT} AND msg_id NOT IN (SELECT msg_id FROM msgs WHERE {IS_REPLY})")
def _(t):
    messages = v.msgs(t)
    return k.minus_by_id(k.recoverable_roots(messages, v.BRAND), k.replies_to_brand(messages, v.BRAND)).select("msg_id")


@query("inbound_union", with_(v.MSGS) + f"SELECT msg_id, text FROM msgs WHERE ({IS_REPLY}) OR ({IS_ROOT})")
def _(t):
    return k.inbound_union(v.msgs(t), v.BRAND).select("msg_id", "text")


@query("leakage_guard", with_(v.EVALF) + "SELECT vec_id, label::BIGINT AS label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM evalf f WHERE f.id = e.vec_id)")
def _(t):
    return k.minus_by_id(t.embeddings.select("vec_id", "label"), v.golden_ids(t), "vec_id", "id")


@query("first_reply", with_(v.MSGS, FIRST_REPLY) + "SELECT m.msg_id, f.reply AS brand_reply FROM msgs m LEFT JOIN first_reply f ON f.parent_id = m.msg_id WHERE m.inbound")
def _(t):
    messages = v.msgs(t)
    return k.attach_first_reply(messages.filter("inbound").select("msg_id"), messages, v.BRAND)


@query("brand_profile", with_(v.MSGS) + f"""SELECT brand, count(*) AS threads, sum(inbound)::BIGINT AS inbound, sum(outbound)::BIGINT AS outbound,
  round(avg(n), 6) AS avg_thread_length, {v.rate('sum(redirects)', 'sum(outbound)')} AS redirect_rate, {v.rate('sum(visible)', 'sum(outbound)')} AS visible_rate
FROM (SELECT conv_id % 3 AS brand, conv_id, count(*) AS n, count(*) FILTER (WHERE inbound) AS inbound, count(*) FILTER (WHERE NOT inbound) AS outbound,
        count(*) FILTER (WHERE NOT inbound AND {hit(v.REDIRECT_WORDS, 'text')}) AS redirects,
        count(*) FILTER (WHERE NOT inbound AND length(text) >= 80 AND NOT {hit(v.REDIRECT_WORDS, 'text')}) AS visible
      FROM msgs GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    rows = v.msgs(t).withColumn("brand", F.col("conv_id") % 3)
    return k.brand_profile(rows, "brand", "conv_id", v.REDIRECT_WORDS.hits(F.col("text")), r.visible_resolution(F.col("text"), v.REDIRECT_WORDS))


@query("corpus_coverage", with_(v.MSGS, FIRST_REPLY) + f"""SELECT count(*) AS pool_rows, count(*) FILTER (WHERE length(f.reply) >= 80 AND NOT {hit(v.REDIRECT_WORDS, 'f.reply')}) AS corpus_rows,
  {v.rate(f"count(*) FILTER (WHERE length(f.reply) >= 80 AND NOT {hit(v.REDIRECT_WORDS, 'f.reply')})", 'count(*)')} AS coverage
FROM msgs m LEFT JOIN first_reply f ON f.parent_id = m.msg_id WHERE m.inbound""")
def _(t):
    messages = v.msgs(t)
    pool = k.attach_first_reply(messages.filter("inbound").select("msg_id"), messages, v.BRAND)
    return m.coverage(pool, r.visible_resolution(F.col("brand_reply"), v.REDIRECT_WORDS))


# --- sketches over the event stream -----------------------------------------


@query("daily_sketches", """SELECT event_type AS brand, count(DISTINCT ts::DATE) AS days, count(*) AS n, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1""")
def _(t):
    """Two batches of days are stored one after the other; the merged estimate stays within four standard errors of the exact count."""
    rows, path = t.events.withColumnRenamed("event_type", "brand"), scratch(t)
    middle = rows.agg(F.percentile_approx(F.to_date("ts").cast("timestamp").cast("long"), 0.5)).first()[0] or 0
    early = F.to_date("ts").cast("timestamp").cast("long") <= middle
    for part in (early, ~early):
        days = sk.store_days(t.spark, path, rows.filter(part), ["brand"], F.to_date("ts"), F.col("user_id"))
    exact = rows.groupBy("brand").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), 4 * sk.STANDARD_ERROR * F.col("users"))
    return sk.merged(days, ["brand"]).join(exact, "brand").select("brand", "days", "n", "users", near.alias("within"))
