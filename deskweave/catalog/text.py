"""Projections, filters and string operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import replies as r
from ..functions import text as x
from ..functions.rules import hit_names, weak_label
from ..functions.text import HANDLE, NOT_SPACE, URL, WORD
from ..operators.labelling import difficulty_hint, ensure_columns, normalise_code
from ..operators.links import attach_first_reply, brand_messages
from ..operators.procedures import sop_inventory, sop_match
from ..operators.rule_table import rules_that_hit
from ..operators.triage import degenerate_record
from ..session import cut_lineage
from . import views as v
from .registry import query
from .views import hit, lit, with_

NBSP = "\u00a0"


def handled(t):
    """Messages with handles put before, after or instead of the text."""
    text, kind = F.col("text"), F.col("turn") % 4
    mixed = (
        F.when(kind == 0, F.concat(F.lit("@u"), F.col("conv_id"), F.lit(" @Agent_é\t"), text))
        .when(kind == 1, F.concat(F.lit(NBSP + " "), text, F.lit(" \n")))
        .when(F.col("conv_id") % 2 == 0, F.concat(text, F.lit(" @mid_x "), text))
        .when(F.col("conv_id") % 3 == 0, F.lit("@only @two" + NBSP)))
    return v.msgs(t).select("msg_id", mixed.alias("text"))


HANDLED = f"""handled AS (
  SELECT conv_id*1000000 + turn AS msg_id,
    CASE WHEN turn % 4 = 0 THEN '@u' || conv_id || ' @Agent_é' || chr(9) || text
         WHEN turn % 4 = 1 THEN '{NBSP} ' || text || ' ' || chr(10)
         WHEN conv_id % 2 = 0 THEN text || ' @mid_x ' || text
         WHEN conv_id % 3 = 0 THEN '@only @two{NBSP}' END AS text
  FROM conversations)"""


@query("strip_handles", with_(HANDLED) + f"SELECT msg_id, {v.strip('text')} AS clean_text FROM handled")
def _(t):
    return handled(t).select("msg_id", x.strip_handles(F.col("text")).alias("clean_text"))


@query("drop_all_handles", with_(HANDLED) + f"""SELECT msg_id,
  {v.trim(f"regexp_replace(coalesce(text, ''), {lit(HANDLE)}, '', 'g')")} AS clean_text FROM handled""")
def _(t):
    return handled(t).select("msg_id", x.drop_all_handles(F.col("text")).alias("clean_text"))


@query("lang_ascii", f"""WITH r AS (
  SELECT doc_id, length({v.trim('text')}) AS n, length(regexp_replace({v.trim('text')}, '[^\\x00-\\x7F]', '', 'g')) AS n_ascii FROM documents)
SELECT doc_id, round(n_ascii::DOUBLE / nullif(n, 0), 6) AS ascii_share,
  CASE WHEN coalesce(n, 0) = 0 THEN 'und' WHEN n_ascii::DOUBLE / n >= 0.97 THEN 'en_likely' ELSE 'non_en' END AS guess FROM r""")
def _(t):
    text = F.col("text")
    return t.texts().select("doc_id", F.round(x.ascii_ratio(text), 6).alias("ascii_share"), x.language_guess(text, 0.97).alias("guess"))


@query("min_length", with_(HANDLED) + f"""SELECT msg_id, length({v.strip('text')}) AS n_chars FROM handled
WHERE length({v.strip('text')}) >= 30""")
def _(t):
    cleaned = handled(t).select("msg_id", x.strip_handles(F.col("text")).alias("clean_text"))
    return cleaned.filter(x.long_enough(F.col("clean_text"))).select("msg_id", F.length("clean_text").alias("n_chars"))


@query("inbound_flag", """SELECT conv_id, turn, role = 'user' AS inbound FROM conversations""")
def _(t):
    raw = F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, " True ").otherwise("TRUE\n")).when(F.col("turn") > 0, "False")
    return t.conversations.select("conv_id", "turn", x.is_inbound(raw).alias("inbound"))


@query("brand_filter", with_(v.MSGS) + "SELECT msg_id, text FROM msgs WHERE author = 'assistant'")
def _(t):
    return brand_messages(v.msgs(t), v.BRAND).select("msg_id", "text")


@query("dm_redirect", with_(v.REPLIES) + f"SELECT msg_id, {hit(v.REDIRECT_WORDS, 'text')} AS redirect FROM replies")
def _(t):
    return v.replies(t).select("msg_id", v.REDIRECT_WORDS.hits(F.col("text")).alias("redirect"))


FIRST_REPLY = "first_reply AS (SELECT parent_id, arg_min(text, msg_id) AS reply FROM msgs WHERE author = 'assistant' AND parent_id IS NOT NULL GROUP BY 1)"


@query("visible_resolution", with_(v.MSGS, FIRST_REPLY) + f"""
SELECT m.msg_id, f.reply IS NOT NULL AS answered, coalesce(length(f.reply) >= 80 AND NOT {hit(v.REDIRECT_WORDS, 'f.reply')}, false) AS visible
FROM msgs m LEFT JOIN first_reply f ON f.parent_id = m.msg_id WHERE m.inbound""")
def _(t):
    answered = attach_first_reply(v.msgs(t).filter("inbound").select("msg_id"), v.msgs(t), v.BRAND)
    reply = F.col("brand_reply")
    return answered.select("msg_id", reply.isNotNull().alias("answered"), r.visible_resolution(reply, v.REDIRECT_WORDS).alias("visible"))


SILVER = f"""silver AS (
  SELECT msg_id, hits, CASE WHEN NOT {hit(v.EXCLUDE_WORDS, 'text')} AND len(hits) = 1 THEN hits[1] END AS silver_intent, text
  FROM (SELECT msg_id, text, {v.hits_list(v.INTENT_WORDS, 'text')} AS hits FROM users))"""


def silver(t):
    rows = v.user_turns(t).withColumn("hits", hit_names(F.col("text"), v.INTENT_WORDS))
    return rows.withColumn("silver_intent", weak_label(F.col("text"), v.INTENT_WORDS, v.EXCLUDE_WORDS))


def labelled_turns(t):
    """(id, text, silver_intent), written down once for both sides of a search; the patterns run on every core, however few parts the files have."""
    turns = v.user_turns(t).repartition("msg_id")
    label = weak_label(F.col("text"), v.INTENT_WORDS, v.EXCLUDE_WORDS)
    return cut_lineage(turns.select(F.col("msg_id").alias("id"), "text", label.alias("silver_intent")))


@query("silver_label", with_(v.USERS, SILVER) + "SELECT msg_id, silver_intent FROM silver")
def _(t):
    return silver(t).select("msg_id", "silver_intent")


@query("multi_intent_matches", with_(v.USERS, SILVER) + "SELECT msg_id, len(hits) AS n_hits, array_to_string(hits, '|') AS hit_names, len(hits) >= 2 AS ambiguous FROM silver")
def _(t):
    hits = F.col("hits")
    return silver(t).select("msg_id", F.size(hits).alias("n_hits"), F.array_join(hits, "|").alias("hit_names"), (F.size(hits) >= 2).alias("ambiguous"))


@query("in_taxonomy", with_(v.EVALF) + f"SELECT id, gold_intent FROM evalf WHERE gold_intent IN {v.IN_TAXONOMY}")
def _(t):
    return v.evalf(t).filter(F.col("gold_intent").isin(*v.TAXONOMY)).select("id", "gold_intent")


@query("degenerate_input", f"""WITH mixed AS (
  SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '@u' || doc_id WHEN 3 THEN ' ' || chr(9) || '{NBSP}'
    WHEN 4 THEN '@a ok' WHEN 5 THEN '@a yes' ELSE text END AS text FROM documents),
flagged AS (SELECT doc_id, length({v.trim(f"regexp_replace(coalesce(text, ''), {lit(HANDLE)}, '', 'g')")}) < 3 AS degenerate FROM mixed)
SELECT doc_id, degenerate, CASE WHEN degenerate THEN 'playback_issue' END AS predicted_intent, CASE WHEN degenerate THEN 'escalate' END AS decision,
  CASE WHEN degenerate THEN 'degenerate_input' END AS gate_triggered, CASE WHEN degenerate THEN 0.0::DOUBLE END AS calibrated_confidence,
  CASE WHEN degenerate THEN {lit(d.DEGENERATE_EVIDENCE)} END AS evidence, CASE WHEN degenerate THEN 'none' END AS grounding_source FROM flagged""")
def _(t):
    doc, kind = F.col("doc_id"), F.col("doc_id") % 10
    mixed = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.concat(F.lit("@u"), doc))
        .when(kind == 3, " \t" + NBSP).when(kind == 4, "@a ok").when(kind == 5, "@a yes").otherwise(F.col("text")))
    rows = t.texts().select("doc_id", mixed.alias("text")).withColumn("degenerate", r.is_degenerate(F.col("text")))
    rec = rows.withColumn("rec", F.when(F.col("degenerate"), degenerate_record(doc.cast("string"))))
    return rec.select("doc_id", "degenerate", "rec.predicted_intent", "rec.decision", "rec.gate_triggered",
                      "rec.calibrated_confidence", F.array_join("rec.evidence_used", "|").alias("evidence"), "rec.grounding_source")


ASKED = "asked AS (SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN text || ' ?' || chr(10) ELSE text END AS text FROM replies)"


def asked(t):
    """Replies, a third of them turned into questions."""
    return v.replies(t).withColumn("text", F.when(F.col("msg_id") % 3 == 0, F.concat("text", F.lit(" ?\n"))).otherwise(F.col("text")))


def ends_q(col: str) -> str:
    return f"coalesce(ends_with({v.trim(col)}, '?'), false)"


def concrete_sql(col: str) -> str:
    return (f"(NOT {hit(v.ANY_DM_WORDS, col)} AND {hit(v.ACTION_WORDS, col)} "
            f"AND NOT ({ends_q(col)} AND NOT {hit(v.QUESTION_WORDS, col)}))")


@query("concrete_resolution", with_(v.REPLIES, ASKED) + f"SELECT msg_id, {concrete_sql('text')} AS concrete FROM asked")
def _(t):
    return asked(t).select("msg_id", r.concrete_resolution(F.col("text"), v.ANY_DM_WORDS, v.ACTION_WORDS, v.QUESTION_WORDS).alias("concrete"))


@query("reply_category", with_(v.REPLIES, ASKED) + f"""
SELECT CASE WHEN {hit(v.ANY_DM_WORDS, 'text')} THEN 'DM-redirect' WHEN {concrete_sql('text')} THEN 'concrete-resolution'
            WHEN {ends_q('text')} THEN 'diagnostic-only' ELSE 'generic-status' END AS category, count(*) AS n
FROM asked GROUP BY 1""")
def _(t):
    kind = r.reply_category(F.col("text"), v.ANY_DM_WORDS, v.ACTION_WORDS, v.QUESTION_WORDS)
    return asked(t).groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


LINKED = f"""linked AS (
  SELECT page_id, 'See ' || url || '). or T.CO/p' || page_id || ' ' || html AS reply,
    CASE page_id % 4 WHEN 0 THEN 'from ' || url || '?ref=1 t.co/p' || page_id WHEN 1 THEN 'other http://example.org/x'
                     WHEN 2 THEN 'T.CO/p' || page_id || '/tail, ' || url END AS evidence FROM pages)"""


def linked(t):
    """Pages as replies that quote their URL, with evidence that does or does not."""
    url, page = F.col("url"), F.col("page_id")
    return t.pages.select(
        "page_id", F.concat(F.lit("See "), url, F.lit("). or T.CO/p"), page, F.lit(" "), F.col("html")).alias("reply"),
        F.when(page % 4 == 0, F.concat(F.lit("from "), url, F.lit("?ref=1 t.co/p"), page))
        .when(page % 4 == 1, "other http://example.org/x")
        .when(page % 4 == 2, F.concat(F.lit("T.CO/p"), page, F.lit("/tail, "), url)).alias("evidence"))


URLS = f"(?i)https?://{NOT_SPACE}+|t\\.co/{NOT_SPACE}+"


@query("strip_urls", with_(LINKED) + f"SELECT page_id, {v.trim(f'regexp_replace(reply, {lit(URL)}, {lit(str())}, {lit(chr(103))})')} AS reply FROM linked")
def _(t):
    return linked(t).select("page_id", x.strip_urls(F.col("reply")).alias("reply"))


@query("extract_urls", with_(LINKED) + f"""SELECT page_id, len(u) AS n_urls, array_to_string(u, ' ') AS urls
FROM (SELECT page_id, regexp_extract_all(reply, {lit(URLS)}) AS u FROM linked)""")
def _(t):
    rows = linked(t).withColumn("u", x.extract_urls(F.col("reply")))
    return rows.select("page_id", F.size("u").alias("n_urls"), F.array_join("u", " ").alias("urls"))


def clean_urls_sql(col: str) -> str:
    tail = lit("[.,?!:;)\"']+$")
    return f"list_transform(regexp_extract_all(coalesce({col}, ''), {lit(URLS)}), lambda u: regexp_replace(u, {tail}, ''))"


SYNTHETIC = f"""synthetic AS (
  SELECT page_id, len(list_filter(ru, lambda x: len(list_filter(eu, lambda y: contains(y, x) OR contains(x, y))) = 0)) > 0 AS synthetic_url
  FROM (SELECT page_id, {clean_urls_sql('reply')} AS ru, {clean_urls_sql('evidence')} AS eu FROM linked))"""


@query("synthetic_url", with_(LINKED, SYNTHETIC) + "SELECT * FROM synthetic")
def _(t):
    return linked(t).select("page_id", r.synthetic_url(F.col("reply"), F.col("evidence")).alias("synthetic_url"))


@query("reply_length_flags", with_(v.REPLIES) + "SELECT msg_id, length(text) AS char_count, length(text) > 280 AS too_long FROM replies")
def _(t):
    return v.replies(t).select("msg_id", F.length("text").alias("char_count"), (F.length("text") > d.MAX_REPLY_CHARS).alias("too_long"))


HIT_TEXT = "hit_text AS (SELECT doc_id, text AS hit_reply FROM documents)"


def sop_name_sql(col: str = "c.predicted_intent", text: str = "c.customer_text", what=lambda s: lit(s.name)) -> str:
    return v.sop_sql(v.LABEL_SOPS, col, text, what)


def grounded(t):
    """Decided rows with their case's text and matching procedure."""
    rows = v.preds(t)
    texts = t.documents.select(F.col("doc_id").alias("hit_id"), F.col("text").alias("hit_reply"))
    asked_text = v.evalf(t).select("id", "customer_text")
    joined = rows.join(asked_text, "id").join(texts, "hit_id", "left")
    concrete = F.col("hit_reply").isNotNull() & r.concrete_resolution(F.col("hit_reply"), v.ANY_DM_WORDS, v.ACTION_WORDS, v.QUESTION_WORDS)
    return sop_match(joined, "predicted_intent", "customer_text", v.LABEL_SOPS).withColumn("concrete", concrete)


GROUNDED = f"""grounded AS (
  SELECT p.*, h.hit_reply, h.hit_reply IS NOT NULL AND {concrete_sql('h.hit_reply')} AS concrete,
    {sop_name_sql()} AS sop_name, {sop_name_sql(what=lambda s: lit(s.sop_id))} AS sop_id,
    {sop_name_sql(what=lambda s: lit(' '.join(s.steps)))} AS sop_steps,
    {sop_name_sql(what=lambda s: lit(chr(10).join(s.steps)))} AS sop_lines
  FROM preds p JOIN classified c ON c.id = p.id LEFT JOIN hit_text h ON h.doc_id = p.hit_id)"""
GROUNDED_WITH = with_(*v.PREDS_CTES, HIT_TEXT, GROUNDED)


@query("evidence_text", GROUNDED_WITH + f"""SELECT id, CASE WHEN decision = 'escalate' THEN 'Escalation Routing: ' || decision_layer
  WHEN concrete THEN 'Retrieved historical tweet ' || hit_id || ': ' || substring(hit_reply, 1, 80) || '...'
  WHEN sop_id IS NOT NULL THEN 'Curated SOP [' || sop_id || ']: ' || sop_name ELSE {lit(d.GENERAL_SOP_EVIDENCE)} END AS evidence FROM grounded""")
def _(t):
    items = r.evidence_items(F.col("decision"), F.col("decision_layer"), F.col("concrete"), F.col("hit_id"), F.col("hit_reply"), F.col("sop"))
    return grounded(t).select("id", F.array_join(items, "|").alias("evidence"))


@query("candidate_procedure", GROUNDED_WITH + f"""SELECT id, CASE WHEN concrete THEN hit_reply WHEN sop_name IS NOT NULL THEN sop_name || ': ' || sop_steps
  ELSE {lit(d.GENERAL_PROCEDURE)} END AS procedure FROM grounded""")
def _(t):
    return grounded(t).select("id", r.candidate_procedure(F.col("concrete"), F.col("hit_reply"), F.col("sop")).alias("procedure"))


@query("policy_context", f"""SELECT doc_id, coalesce('Grounding Policy Reference: [' || sop_name || ']' || chr(10) || 'Applicable Procedure:' || chr(10) || sop_lines,
  'General Product Support Guidance: Recommend checking account status and restarting device.') AS context
FROM (SELECT doc_id, {v.sop_sql(v.LANG_SOPS, 'lang', 'text', lambda s: lit(s.name))} AS sop_name,
  {v.sop_sql(v.LANG_SOPS, 'lang', 'text', lambda s: lit(chr(10).join(s.steps)))} AS sop_lines FROM documents)""")
def _(t):
    rows = sop_match(t.texts().select("doc_id", "lang", "text"), "lang", "text", v.LANG_SOPS)
    return rows.select("doc_id", r.policy_context(F.col("sop")).alias("context"))


@query("draft_cleanup", with_(v.MSGS) + f"""SELECT msg_id, coalesce(CASE WHEN turn % 4 = 1 THEN {v.trim(f"regexp_replace(q, {lit(URL)}, '', 'g')")} ELSE q END, {lit(d.FALLBACK_REPLY)}) AS draft
FROM (SELECT msg_id, turn, replace({v.trim("CASE WHEN conv_id % 5 <> 0 THEN ' \"' || text || '\" https://x.example/' || msg_id || chr(10) END")}, '"', '') AS q
      FROM msgs WHERE author = 'assistant')""")
def _(t):
    draft = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit(' "'), "text", F.lit('" https://x.example/'), "msg_id", F.lit("\n")))
    decision = F.when(F.col("turn") % 4 == 1, d.AUTO_HANDLE).otherwise(d.ESCALATE)
    return brand_messages(v.msgs(t), v.BRAND).select("msg_id", r.clean_draft(draft, decision).alias("draft"))


@query("column_prune", "SELECT doc_id, text, lang, source FROM documents")
def _(t):
    return t.documents.select("doc_id", "text", "lang", "source")


@query("difficulty_hint", with_(v.USERS, SILVER) + f"""SELECT msg_id,
  CASE WHEN length(text) <= 50 OR len(hits) >= 2 OR {hit(v.EXCLUDE_WORDS, 'text')} THEN 'hard' ELSE 'easy' END AS hint FROM silver""")
def _(t):
    return silver(t).select("msg_id", difficulty_hint(F.col("text"), F.col("hits"), v.EXCLUDE_WORDS.hits(F.col("text"))).alias("hint"))


@query("malfunction_filter", f"""SELECT lang, count(*) AS before, count(*) FILTER (WHERE {hit(v.ACTION_WORDS, 'text')} AND NOT {hit(v.EXCLUDE_WORDS, 'text')}) AS after
FROM documents GROUP BY 1""")
def _(t):
    keep = v.ACTION_WORDS.hits(F.col("text")) & ~v.EXCLUDE_WORDS.hits(F.col("text"))
    return t.texts().groupBy("lang").agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after"))


EVENT_CODES = {"e": "error", "error": "error", "c": "click", "click": "click", "v": "view", "p": "purchase", "purchase": "purchase"}


@query("normalize_labels", f"""WITH coded AS (
  SELECT event_id, lower(trim(CASE WHEN event_id % 2 = 0 THEN ' ' || upper(substring(event_type, 1, 1)) || ' ' ELSE event_type END)) AS code FROM events)
SELECT event_id, label, label IS NULL AS invalid FROM (
  SELECT event_id, CASE code {' '.join(f"WHEN '{k}' THEN '{n}'" for k, n in EVENT_CODES.items())} END AS label FROM coded)""")
def _(t):
    code = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper(F.substring("event_type", 1, 1)), F.lit(" "))).otherwise(F.col("event_type"))
    rows = t.events.select("event_id", normalise_code(code, EVENT_CODES).alias("label"))
    return rows.select("event_id", "label", F.col("label").isNull().alias("invalid"))


@query("ensure_columns", with_(v.EVALF) + """SELECT id::VARCHAR AS id, CASE WHEN id % 4 <> 0 THEN gold_intent ELSE '' END AS gold_intent, gold_decision, difficulty_tier,
  '' AS has_visible_resolution, '' AS gold_decision_reason FROM evalf""")
def _(t):
    rows = v.evalf(t).select("id", F.when(F.col("id") % 4 != 0, F.col("gold_intent")).alias("gold_intent"), "gold_decision", "difficulty_tier")
    return ensure_columns(rows)


@query("sop_inventory", f"""WITH per AS (
  SELECT lang, count(*) AS messages, CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 0 END AS n_sops FROM documents GROUP BY 1)
SELECT coalesce(lang, 'total') AS intent, sum(messages)::BIGINT AS messages, sum(n_sops)::BIGINT AS n_sops FROM per GROUP BY GROUPING SETS ((), (lang))""")
def _(t):
    return sop_inventory(t.documents, "lang", v.LANG_SOPS)


@query("sop_match", f"""SELECT doc_id, {v.sop_sql(v.LANG_SOPS, 'lang', 'text', lambda s: lit(s.sop_id))} AS sop_id FROM documents""")
def _(t):
    return sop_match(t.texts(), "lang", "text", v.LANG_SOPS).select("doc_id", "sop.sop_id")


# --- rules as a table ---------------------------------------------------------

RULE_TABLE = f"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM documents),
rules AS (SELECT strpos('0123456789abcdef', substr(md5(w), 2, 1)) - 1 AS rank, w AS name FROM words WHERE substr(md5(w), 1, 1) IN ('0', '1')),
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {lit(WORD + '+')})) AS token FROM documents),
hits AS (SELECT DISTINCT doc_id, rank, name FROM tokens JOIN (SELECT rank, name, unnest([name, substr(name, 1, length(name) - 1) || 'q']) AS form FROM rules) ON form = token)"""


def word_rules(t):
    """An eighth of the documents' longer words, each as a pattern with two last letters."""
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    pattern = F.expr("concat(substr(w, 1, length(w) - 1), '[q', right(w, 1), ']')")
    return words.filter(F.substring(F.md5("w"), 1, 1).isin("0", "1")).select(
        F.conv(F.substring(F.md5("w"), 2, 1), 16, 10).cast("bigint").alias("rank"), F.col("w").alias("name"),
        pattern.alias("pattern"), F.lit("word").alias("reason"), F.lit(True).alias("whole_word"))


@query("rule_table", with_(RULE_TABLE) + "SELECT doc_id, min(rank) AS first_rank, count(*) AS n_hits, min(name) AS first_name FROM hits GROUP BY 1")
def _(t):
    hits = rules_that_hit(t.documents, word_rules(t), "doc_id")
    return hits.groupBy("doc_id").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n_hits"), F.min("name").alias("first_name"))
