"""Windows, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.labelling import label_progress, running_other_rate
from ..operators.sampling import balanced_sample, quota_sample
from ..plans.spot_check import spot_check
from . import views as v
from .registry import query
from .views import with_

N_BALANCED = 50
QUOTA = {("en", "easy"): 24, ("en", "hard"): 10, ("fr", "easy"): 21, ("fr", "hard"): 9, ("de", "easy"): 21, ("de", "hard"): 9,
         ("es", "easy"): 18, ("es", "hard"): 8}


@query("balanced_sample", f"""SELECT doc_id, lang, rn FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|{v.SEED}'), doc_id) AS rn FROM documents) WHERE rn <= {N_BALANCED}""")
def _(t):
    return balanced_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", N_BALANCED, v.SEED)


@query("quota_sample", f"""SELECT doc_id, lang, tier, quota, rn FROM (
  SELECT *, CASE {' '.join(f"WHEN lang = '{a}' AND tier = '{b}' THEN {n}" for (a, b), n in QUOTA.items())} ELSE 0 END::BIGINT AS quota,
    row_number() OVER (PARTITION BY lang, tier ORDER BY md5(doc_id || '|{v.SEED}'), doc_id) AS rn
  FROM (SELECT doc_id, lang, CASE WHEN n_chars < 1500 THEN 'easy' ELSE 'hard' END AS tier FROM documents)) WHERE rn <= quota""")
def _(t):
    rows = t.documents.select("doc_id", "lang", F.when(F.col("n_chars") < 1500, "easy").otherwise("hard").alias("tier"))
    return quota_sample(rows, ["lang", "tier"], QUOTA, "doc_id", v.SEED).select("doc_id", "lang", "tier", "quota", "rn")


@query("stratified_split", with_(v.EVALF, "slim AS (SELECT id, gold_intent, difficulty_tier FROM evalf)", v.split_sql("slim")) + "SELECT id, stratum, split FROM split_rows")
def _(t):
    rows = v.evalf(t).select("id", "gold_intent", "difficulty_tier")
    return v.with_split(rows).select("id", "stratum", "split")


@query("stratified_subsample", with_(v.EVALF, "slim AS (SELECT id, gold_intent, difficulty_tier FROM evalf)", v.split_sql("slim", size="least(38, total)"))
       + "SELECT id, stratum FROM split_rows WHERE split = 'held_out'")
def _(t):
    rows = v.evalf(t).select("id", "gold_intent", "difficulty_tier")
    return v.with_split(rows, 38).filter(F.col("split") == "held_out").select("id", "stratum")


@query("spot_check_sample", with_(v.EVALF, v.CORPUS, f"""picked AS (
  SELECT id, gold_intent, difficulty_tier, embedding, customer_text FROM evalf WHERE gold_intent IN {v.IN_TAXONOMY} ORDER BY md5(id || '|{v.SEED}'), id LIMIT 20)""",
  """best AS (SELECT id, hit_id, similarity FROM (
  SELECT p.id, c.vec_id AS hit_id, round(list_dot_product(p.embedding, c.embedding), 6) AS similarity,
    row_number() OVER (PARTITION BY p.id ORDER BY round(list_dot_product(p.embedding, c.embedding), 6) DESC, c.vec_id DESC) AS rn
  FROM picked p JOIN corpus c ON c.silver_intent = p.gold_intent) WHERE rn = 1)""") + f"""
SELECT p.id, p.gold_intent, p.difficulty_tier, {v.strip('p.customer_text')} AS query, b.hit_id, d.text AS retrieved_query, d.lang AS retrieved_reply, b.similarity
FROM picked p LEFT JOIN best b ON b.id = p.id LEFT JOIN documents d ON d.doc_id = b.hit_id""")
def _(t):
    cases = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("clean_text"), F.col("lang").alias("brand_reply_text"))
    return spot_check(v.evalf(t), v.corpus(t).join(cases, "vec_id", "left"), v.TAXONOMY, 20, v.SEED)


@query("running_other_rate", """WITH run AS (
  SELECT event_id, user_id, event_type = 'error' AS is_other,
    count(*) OVER w AS labelled, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS others
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, labelled, others::BIGINT AS others, round(others::DOUBLE / labelled, 6) AS other_rate,
  labelled > 10 AND others::DOUBLE / labelled > 0.15
    AND coalesce((others - CASE WHEN is_other THEN 1 ELSE 0 END)::DOUBLE / nullif(labelled - 1, 0), 0) <= 0.15 AS alert FROM run""")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    return running_other_rate(rows, ["user_id"], ["event_id"], F.col("event_type") == "error").drop("event_type")


@query("label_progress", """WITH e AS (SELECT event_id, 'u' || (user_id % 7) AS stratum, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_type = 'error' THEN 'other' ELSE event_type END AS label FROM events),
g AS (SELECT stratum, grouping(stratum) AS g, count(*) AS total, count(*) FILTER (WHERE label <> '') AS labelled, count(*) FILTER (WHERE label = 'other') AS other_n,
  min(event_id) FILTER (WHERE label = '') AS resume_id FROM e GROUP BY GROUPING SETS ((), (stratum)))
SELECT CASE WHEN g = 1 THEN 'overall' ELSE stratum END AS stratum, total, labelled, other_n,
  round((other_n + 5 * g)::DOUBLE / nullif(labelled + 6 * g, 0), 6) AS other_rate, resume_id FROM g""")
def _(t):
    label = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_type") == "error", "other").otherwise(F.col("event_type"))
    rows = t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id") % 7).alias("stratum"), label.alias("label"))
    return label_progress(rows, "event_id", "label", "stratum")
