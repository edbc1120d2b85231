"""Gates, decisions, caches and answers of external scorers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import replies as r
from ..functions import responses as p
from ..functions.rules import first_gate, gate_array
from ..functions.text import URL
from ..operators import triage as g
from ..operators.scoring import lookup, score_batch, stored_verdicts
from ..sources.answers import AnswerLog
from . import views as v
from .registry import query
from .sources import scratch
from .text import GROUNDED_WITH, LINKED, SYNTHETIC, grounded, linked
from .views import PREDS, PREDS_CTES, hit, lit, with_


@query("gate_join", " UNION ALL ".join(
    f"SELECT doc_id, {i}::BIGINT AS rank, {lit(x.name)} AS gate FROM documents WHERE {hit(x, 'text')}" for i, x in enumerate(v.GATES)))
def _(t):
    fired = t.texts().select("doc_id", F.explode(gate_array(F.col("text"), v.GATES)).alias("g"))
    return fired.select("doc_id", "g.rank", "g.gate")


@query("first_gate", f"""SELECT doc_id, {v.first_gate_sql(v.GATES, 'text', "CASE WHEN lang = 'es' THEN 'c9' END")} AS gate,
  {v.first_gate_sql(v.GATES, 'text', "CASE WHEN lang = 'es' THEN 'c9' END", 'reason')} AS reason FROM documents""")
def _(t):
    intent = F.when(F.col("lang") == "es", v.OTHER)
    rows = t.texts().withColumn("g", first_gate(F.col("text"), v.GATES, intent, v.OTHER, v.CATCH_ALL))
    return rows.select("doc_id", "g.gate", "g.reason")


DECIDED = ["id", "decision", "decision_layer", "gate_triggered", "threshold_used", "calibrated_confidence"]


@query("decide", PREDS + f"SELECT {', '.join(DECIDED)} FROM preds")
def _(t):
    return v.preds(t).select(*DECIDED)


@query("decide_single_threshold", with_(*PREDS_CTES[:-1], v.decided_sql(0.27, 0.27, use_verdict=False)) + f"SELECT {', '.join(DECIDED)} FROM preds")
def _(t):
    rows = v.gated_rows(t)
    r_ = g.decide(F.col("gate"), F.col("similarity"), F.lit(None).cast("boolean"), None, 0.27, 0.27)
    return rows.withColumn("r", r_).select("id", *[f"r.{c}" for c in DECIDED[1:]])


@query("baseline_gate", PREDS + f"""SELECT p.id, CASE WHEN {' OR '.join(hit(x, 'c.customer_text') for x in v.GATES[:3])} THEN 'escalate'
  WHEN p.similarity >= 0.25 THEN 'auto_handle' ELSE 'escalate' END AS decision FROM preds p JOIN classified c ON c.id = p.id""")
def _(t):
    rows = v.classified(t).select("id", first_gate(F.col("customer_text"), v.GATES[:3]).alias("gate")).join(v.top1(t), "id", "left")
    decided = g.decide(F.col("gate"), F.col("similarity"), F.lit(None).cast("boolean"), None, 0.25, 0.25)
    return rows.select("id", decided["decision"].alias("decision"))


@query("verifier_needed", PREDS + f"SELECT id, similarity FROM preds WHERE NOT gated AND similarity >= {v.TAU_LOW}")
def _(t):
    return v.gated_rows(t).filter(g.verifier_needed(F.col("gate"), F.col("similarity"), v.TAU_LOW)).select("id", "similarity")


@query("grounding_choice", GROUNDED_WITH + """SELECT id, decision, CASE WHEN decision = 'escalate' THEN 'none' WHEN concrete THEN 'retrieved_case' ELSE 'curated_sop' END AS source FROM grounded""")
def _(t):
    return grounded(t).select("id", "decision", r.grounding_source(F.col("decision"), F.col("concrete")).alias("source"))


@query("cached_prediction_lookup", with_(v.EVALF, v.CLASSIFIED) + """SELECT e.id, s.predicted_intent AS known_intent, CASE WHEN s.id IS NOT NULL THEN coalesce(s.confidence, 1.0) END AS known_confidence,
  s.predicted_intent IS NULL AS needs_classifier
FROM evalf e LEFT JOIN (SELECT id, predicted_intent, CASE WHEN difficulty_tier = 'easy' THEN confidence END AS confidence FROM classified WHERE lang <> 'fr') s ON s.id = e.id""")
def _(t):
    rows = v.classified(t)
    stored = rows.filter("lang <> 'fr'").select("id", "predicted_intent", F.when(F.col("difficulty_tier") == "easy", F.col("confidence")).alias("confidence"))
    return g.with_cached_intent(rows.select("id"), stored).withColumn("needs_classifier", F.col("known_intent").isNull())


def stored_drafts(t):
    return v.evalf(t).select(
        "id", F.col("gold_decision").alias("cached_decision"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("draft "), "id")).alias("cached_reply"),
        F.when(F.col("id") % 3 != 0, "retrieved_case").alias("cached_source"))


DRAFTS = """drafts AS (SELECT id, gold_decision AS cached_decision, CASE WHEN id % 5 <> 0 THEN 'draft ' || id END AS cached_reply,
  CASE WHEN id % 3 <> 0 THEN 'retrieved_case' END AS cached_source FROM evalf)"""


@query("draft_reuse", with_(*PREDS_CTES, DRAFTS) + """SELECT p.id, p.decision, coalesce(cached_decision = decision AND cached_reply IS NOT NULL, false) AS reused,
  CASE WHEN cached_decision = decision THEN cached_reply END AS drafted_reply,
  CASE WHEN cached_decision = decision AND cached_reply IS NOT NULL THEN coalesce(cached_source, 'curated_sop') END AS reply_source
FROM preds p LEFT JOIN drafts d ON d.id = p.id""")
def _(t):
    return g.reuse_drafts(v.preds(t).select("id", "decision"), stored_drafts(t))


def verdict_requests(t):
    """Every document with a procedure; some of either are empty."""
    return t.documents.select(
        "doc_id", "lang", F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit(" "), "text", F.lit("\n"))).alias("body"),
        F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("steps for "), "lang")).otherwise("").alias("procedure"))


@query("verdict_cache_join", f"""WITH req AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 10 <> 0 THEN ' ' || text || chr(10) END AS body, CASE WHEN doc_id % 11 <> 0 THEN 'steps for ' || lang ELSE '' END AS procedure FROM documents),
keyed AS (SELECT *, sha256({v.trim("coalesce(body, '')")} || '|||' || {v.trim('procedure')}) AS verdict_key, coalesce(body, '') = '' OR procedure = '' AS blank FROM req),
cache AS (SELECT verdict_key, max(length({v.trim('body')})) % 2 = 0 AS ok FROM keyed WHERE NOT blank AND lang <> 'de' GROUP BY 1)
SELECT doc_id, k.verdict_key, CASE WHEN blank THEN false ELSE ok END AS resolves_problem, CASE WHEN blank THEN 1.0 WHEN ok IS NOT NULL THEN 0.75 END::DOUBLE AS verdict_confidence,
  CASE WHEN blank THEN {lit(d.EMPTY_VERDICT_REASON)} WHEN ok IS NOT NULL THEN 'stored' END AS verdict_reason, blank OR ok IS NOT NULL AS verdict_known
FROM keyed k LEFT JOIN cache c ON c.verdict_key = k.verdict_key""")
def _(t):
    requests = verdict_requests(t)
    answered = requests.filter("body <> '' AND procedure <> '' AND lang <> 'de'")
    cache = answered.select(
        r.verdict_key(F.col("body"), F.col("procedure")).alias("verdict_key"), F.length(r.trim_all(F.col("body"))).alias("n")
    ).groupBy("verdict_key").agg((F.max("n") % 2 == 0).alias("resolves_problem")).select(
        "verdict_key", "resolves_problem", F.lit(0.75).alias("confidence"), F.lit("stored").alias("reason"))
    return stored_verdicts(requests, cache, "body", "procedure").drop("lang", "body", "procedure")


def even_length_verifier():
    """Deterministic stand-in for a hosted verifier."""

    def score(batch: pd.DataFrame) -> pd.Series:
        return batch["text"].map(lambda x: "Sure: " + json.dumps({"resolves_problem": len(x) % 2 == 0, "confidence": 0.9, "reason": "even"}))

    return score


def named_verifier(name):
    """The same answers, signed with the name of the run that asked."""

    def factory():
        def score(batch: pd.DataFrame) -> pd.Series:
            return batch["text"].map(lambda x: "Sure: " + json.dumps({"resolves_problem": len(x) % 2 == 0, "confidence": 0.9, "reason": name}))

        return score

    return factory


@query("score_batch", """SELECT sha256(text) AS verdict_key, length(text) % 2 = 0 AS resolves_problem, 0.9::DOUBLE AS confidence, count(*) AS copies FROM documents GROUP BY 1, 2""")
def _(t):
    """Copies of a text are scored once and the answer is joined back to all of them."""
    requests = t.documents.select(F.sha2("text", 256).alias("verdict_key"), "text")
    scored = score_batch(requests, "verdict_key", even_length_verifier)
    answers = scored.select("verdict_key", p.parse_verdict(F.col("raw")).alias("v")).select("verdict_key", "v.resolves_problem", "v.confidence")
    copies = requests.groupBy("verdict_key").agg(F.count(F.lit(1)).alias("copies"))
    return lookup(copies, answers, "verdict_key").select("verdict_key", "resolves_problem", "confidence", "copies")


@query("answer_log", """SELECT sha256(text) AS verdict_key, length(text) % 2 = 0 AS resolves_problem, CASE WHEN bool_or(lang = 'en') THEN 'first' ELSE 'second' END AS asked_by, count(*) AS copies
FROM documents GROUP BY 1, 2""")
def _(t):
    """A first run asks about the English texts only; a second one over all texts asks for what the log does not hold."""
    requests = t.documents.select(F.sha2("text", 256).alias("verdict_key"), "text", "lang")
    counts = requests.groupBy("verdict_key").agg(F.count(F.lit(1)).alias("copies"))
    log = AnswerLog.open(scratch(t), counts.count())
    score_batch(requests.filter("lang = 'en'"), "verdict_key", named_verifier("first"), log=log).write.format("noop").mode("overwrite").save()
    scored = score_batch(requests.drop("lang"), "verdict_key", named_verifier("second"), log=log)
    answers = scored.select("verdict_key", p.parse_verdict(F.col("raw")).alias("v")).select("verdict_key", "v.resolves_problem", F.col("v.reason").alias("asked_by"))
    return lookup(counts, answers, "verdict_key").select("verdict_key", "resolves_problem", "asked_by", "copies")


PROMPT = "Classify the message into exactly one intent and answer with a JSON object."
EXAMPLES = (("it skips", '{"intent": "en_the"}'), ("it crashes", '{"intent": "en_of"}'), ("no login", '{"intent": "de"}'),
            ("no pairing", '{"intent": "fr"}'), ("charged twice", '{"intent": "es"}'), ("no widget", '{"intent": "fr"}'))


@query("fewshot_messages", with_(v.USERS) + f"""SELECT msg_id, 14::BIGINT AS n_messages, 'user' AS last_role, 'Customer tweet: "' || text || '"' AS last_content,
  length(text) + {len(PROMPT) + sum(len(q) + len(x) for q, x in EXAMPLES) + 7 * len('Customer tweet: ""')} AS total_chars FROM users""")
def _(t):
    rows = v.user_turns(t).withColumn("m", p.fewshot_messages(F.col("text"), PROMPT, EXAMPLES))
    last = F.element_at("m", -1)
    return rows.select("msg_id", F.size("m").alias("n_messages"), last["role"].alias("last_role"), last["content"].alias("last_content"),
                       F.length(F.array_join(F.col("m.content"), "")).alias("total_chars"))


def answers(t, kinds):
    """Scorer answers made from the documents, one shape per residue."""
    shape = F.lit(None).cast("string")
    for i, build in enumerate(kinds):
        shape = F.when(F.col("doc_id") % len(kinds) == i, build).otherwise(shape)
    return t.documents.select("doc_id", shape.alias("raw"))


def answers_sql(kinds) -> str:
    return "raw AS (SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(kinds)} = {i} THEN {x}" for i, x in enumerate(kinds)) + " END AS raw FROM documents)"


LANGS = ("en", "de", "fr", "es")
INTENT_KINDS = (
    """'{"intent": " ' || upper(lang) || ' ", "confidence": 0.9, "reason": "n' || n_chars || '"}'""", """'the answer is ' || lang""",
    """'{"intent": "maybe ' || lang || '!"}'""", """'{"intent": "en", "confidence": 0.8'""", "NULL", """'{"intent": "zz", "confidence": 0.25}'""", """'{"intent": "fr", "confidence": " 0.75 "}'""", """'{"intent": "de", "confidence": "high"}'""", """'{"intent": "es", "confidence": true}'""")


@query("parse_intent_response", with_(answers_sql(INTENT_KINDS)) + """, j AS (SELECT doc_id, CASE WHEN raw LIKE '{%' AND json_valid(raw) THEN raw::JSON END AS j FROM raw),
f AS (SELECT doc_id, j, j->>'intent' AS raw_intent, lower(trim(j->>'intent')) AS named, try_cast(trim(j->>'confidence') AS DOUBLE) AS confidence, j->>'reason' AS reason FROM j)
SELECT doc_id, CASE WHEN j IS NULL THEN 'es' WHEN named IN ('en', 'de', 'fr', 'es') THEN named WHEN contains(named, 'en') THEN 'en' WHEN contains(named, 'de') THEN 'de'
    WHEN contains(named, 'fr') THEN 'fr' WHEN contains(named, 'es') THEN 'es' ELSE raw_intent END AS intent,
  CASE WHEN j IS NULL THEN 0.2 ELSE coalesce(confidence, 0.0) END::DOUBLE AS confidence,
  CASE WHEN j IS NULL THEN 'Classification error: unreadable response' ELSE coalesce(reason, '') END AS reason FROM f""")
def _(t):
    lang = F.col("lang")
    kinds = (
        F.concat(F.lit('{"intent": " '), F.upper(lang), F.lit(' ", "confidence": 0.9, "reason": "n'), "n_chars", F.lit('"}')),
        F.concat(F.lit("the answer is "), lang), F.concat(F.lit('{"intent": "maybe '), lang, F.lit('!"}')),
        F.lit('{"intent": "en", "confidence": 0.8'), F.lit(None).cast("string"), F.lit('{"intent": "zz", "confidence": 0.25}'),
        F.lit('{"intent": "fr", "confidence": " 0.75 "}'), F.lit('{"intent": "de", "confidence": "high"}'), F.lit('{"intent": "es", "confidence": true}'))
    return answers(t, kinds).withColumn("i", p.parse_intent(F.col("raw"), LANGS, "es")).select("doc_id", "i.*")


VERDICT_KINDS = ("""'Fine. {"resolves_problem": true, "confidence": 0.7, "reason": " n' || n_chars || ' "} done'""", "'no block at all'",
                 """'{"resolves_problem": false}'""", """'{"resolves_problem": tr}'""", "NULL", """'```' || chr(10) || '{' || chr(10) || '"confidence": 1}' || '```'""",
                 """'{"resolves_problem": "True", "confidence": "0.7"}'""", """'{"resolves_problem": "no", "confidence": "sure"}'""", """'{"resolves_problem": 1, "confidence": true}'""")


@query("parse_verdict_response", with_(answers_sql(VERDICT_KINDS)) + f""", b AS (SELECT doc_id, raw, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}') AS block FROM raw),
j AS (SELECT doc_id, raw, block, CASE WHEN block <> '' AND json_valid(block) THEN block::JSON END AS j FROM b)
SELECT doc_id, coalesce(lower(trim(j->>'resolves_problem')) IN ('true', 'yes') OR try_cast(trim(j->>'resolves_problem') AS DOUBLE) <> 0, false) AS resolves_problem,
  CASE WHEN j IS NOT NULL THEN coalesce(try_cast(trim(j->>'confidence') AS DOUBLE), 0.8) WHEN raw IS NOT NULL AND block = '' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN j IS NOT NULL THEN coalesce(trim(j->>'reason'), '') WHEN raw IS NOT NULL AND block = '' THEN {lit(d.UNPARSED_VERDICT_REASON)} ELSE 'Resolution checker API error: unreadable response' END AS reason,
  j IS NOT NULL OR (raw IS NOT NULL AND block = '') AS cacheable FROM j""")
def _(t):
    kinds = (
        F.concat(F.lit('Fine. {"resolves_problem": true, "confidence": 0.7, "reason": " n'), "n_chars", F.lit(' "} done')), F.lit("no block at all"),
        F.lit('{"resolves_problem": false}'), F.lit('{"resolves_problem": tr}'), F.lit(None).cast("string"), F.lit('```\n{\n"confidence": 1}```'),
        F.lit('{"resolves_problem": "True", "confidence": "0.7"}'), F.lit('{"resolves_problem": "no", "confidence": "sure"}'), F.lit('{"resolves_problem": 1, "confidence": true}'))
    return answers(t, kinds).withColumn("x", p.parse_verdict(F.col("raw"))).select("doc_id", "x.*")


JUDGE_KINDS = ("""'{"groundedness_score": ' || (1 + n_chars % 5) || ', "tone_score": "4", "judge_decision": " PASS ", "judge_notes": "' || lang || '"}'""", "'nothing here'",
               """'Answer: {"tone_score": 2}'""", """'{"groundedness_score": "many", "judge_decision": "pass"}'""", "NULL")


def judge_json_sql(block: str) -> str:
    """Columns of a parsed judge answer from the JSON text ``block``."""
    ok = (f"(try_cast({block} AS JSON) IS NOT NULL AND (try_cast({block} AS JSON)->>'groundedness_score' IS NULL OR try_cast(try_cast({block} AS JSON)->>'groundedness_score' AS DOUBLE) IS NOT NULL))")
    return f"""CASE WHEN {ok} THEN coalesce(try_cast(try_cast({block} AS JSON)->>'groundedness_score' AS BIGINT), 3) ELSE 3 END AS groundedness_score,
  CASE WHEN {ok} THEN coalesce(try_cast(try_cast({block} AS JSON)->>'tone_score' AS BIGINT), 3) ELSE 3 END AS tone_score,
  CASE WHEN {ok} THEN lower(trim(coalesce(try_cast({block} AS JSON)->>'judge_decision', 'fail'))) ELSE 'fail' END AS judge_decision,
  CASE WHEN {ok} THEN coalesce(try_cast({block} AS JSON)->>'judge_notes', '') ELSE 'Judge parsing exception: unreadable response' END AS judge_notes"""


@query("parse_judge_response", with_(answers_sql(JUDGE_KINDS)) + f""", b AS (SELECT doc_id, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}') AS block FROM raw)
SELECT doc_id, {judge_json_sql('block')} FROM b""")
def _(t):
    kinds = (
        F.concat(F.lit('{"groundedness_score": '), 1 + F.col("n_chars") % 5, F.lit(', "tone_score": "4", "judge_decision": " PASS ", "judge_notes": "'), "lang", F.lit('"}')),
        F.lit("nothing here"), F.lit('Answer: {"tone_score": 2}'), F.lit('{"groundedness_score": "many", "judge_decision": "pass"}'), F.lit(None).cast("string"))
    return answers(t, kinds).withColumn("x", p.parse_judge(F.col("raw"))).select("doc_id", "x.*")


@query("judge_guardrails", with_(LINKED, SYNTHETIC) + """SELECT l.page_id, n AS char_count, synthetic_url,
  CASE WHEN synthetic_url THEN 1 ELSE 2 + l.page_id % 4 END AS groundedness_score, 4::BIGINT AS tone_score,
  CASE WHEN synthetic_url OR n > 2000 THEN 'fail' ELSE CASE WHEN l.page_id % 3 = 0 THEN 'fail' ELSE 'pass' END END AS judge_decision
FROM (SELECT page_id, length(reply) AS n FROM linked) l JOIN synthetic s ON s.page_id = l.page_id""")
def _(t):
    raw = F.concat(F.lit('{"groundedness_score": '), 2 + F.col("page_id") % 4, F.lit(', "tone_score": 4, "judge_decision": "'),
                   F.when(F.col("page_id") % 3 == 0, "fail").otherwise("pass"), F.lit('"}'))
    rows = linked(t).select("page_id", F.length("reply").alias("char_count"), r.synthetic_url(F.col("reply"), F.col("evidence")).alias("synthetic_url"),
                            p.parse_judge(raw).alias("judged"))
    final = rows.withColumn("f", p.judge_guardrails(F.col("judged"), F.col("synthetic_url"), F.col("char_count"), 2000))
    return final.select("page_id", "char_count", "synthetic_url", "f.groundedness_score", "f.tone_score", "f.judge_decision")


def draft_sql(fallback: str = lit(d.FALLBACK_REPLY)) -> str:
    url = lit(URL)
    grounded_text = f"CASE WHEN concrete THEN hit_reply WHEN sop_steps IS NOT NULL THEN 'Please try this: ' || sop_steps ELSE {lit(d.GENERAL_PROCEDURE)} END"
    stripped = v.trim(f"regexp_replace({grounded_text}, {url}, '', 'g')")
    return f"""CASE WHEN decision = 'escalate' THEN {fallback} ELSE replace({stripped}, '"', '') END"""


@query("draft_fallback_template", GROUNDED_WITH + f"SELECT id, decision, {draft_sql()} AS draft FROM grounded")
def _(t):
    return grounded(t).select("id", "decision", r.template_draft(F.col("decision"), F.col("sop"), F.col("concrete"), F.col("hit_reply")).alias("draft"))
