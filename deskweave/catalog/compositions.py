"""End-to-end compositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import replies as r
from ..functions.rules import first_gate
from ..operators.procedures import sop_match
from ..operators.triage import decide
from ..plans.baselines import retrieval_policy_report
from ..plans.corpus import CorpusRules, build_corpus, store_corpus
from ..plans.reports import evaluation_report, judge_validation_report
from ..plans.runs import Scorers, judged_audit, triage_run
from ..plans.triage import TriageSettings, triage_batch
from . import views as v
from .links import IS_REPLY, IS_ROOT
from .metrics import AGREEMENT, CLASS_COUNTS, KAPPA, MEANS, RATED, ROUTED, SCORES, SPLIT_CTES, rho_sql
from .registry import query
from .retrieval import TFIDF_CTES
from .scoring import DRAFTS, draft_sql, stored_drafts
from .sources import scratch
from .text import FIRST_REPLY, HIT_TEXT, LINKED, SILVER, SYNTHETIC, concrete_sql, labelled_turns, linked, sop_name_sql
from .views import hit, lit, rate, with_

RULES = CorpusRules(brand=v.BRAND, intents=v.INTENT_WORDS, exclude=v.EXCLUDE_WORDS, redirect=v.REDIRECT_WORDS)


POOL = f"""inbound_rows AS (SELECT * FROM msgs WHERE ({IS_REPLY}) OR ({IS_ROOT})),
pool AS (SELECT i.msg_id, {v.strip('i.text')} AS clean, f.reply FROM inbound_rows i LEFT JOIN first_reply f ON f.parent_id = i.msg_id
  WHERE length({v.trim('i.text')}) > 0 AND length(regexp_replace({v.trim('i.text')}, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / length({v.trim('i.text')}) >= 0.85
    AND length({v.strip('i.text')}) >= 30
    AND NOT EXISTS (SELECT 1 FROM evalf g WHERE g.gold_decision = 'escalate' AND g.id * 1000000 = i.msg_id)),
hits AS (SELECT *, {v.hits_list(v.INTENT_WORDS, 'clean')} AS h FROM pool)"""
LABELLED, ANSWERED = f"len(h) = 1 AND NOT {hit(v.EXCLUDE_WORDS, 'clean')}", f"length(reply) >= 80 AND NOT {hit(v.REDIRECT_WORDS, 'reply')}"


@query("build_corpus", with_(v.MSGS, FIRST_REPLY, v.EVALF, POOL) + f"""
SELECT msg_id AS tweet_id, replace(replace(clean, chr(13), ' '), chr(10), ' ') AS clean_text, replace(replace(reply, chr(13), ' '), chr(10), ' ') AS brand_reply_text, h[1] AS silver_intent
FROM hits WHERE {LABELLED} AND {ANSWERED}""")
def _(t):
    golden = v.evalf(t).filter(F.col("gold_decision") == d.ESCALATE).select((F.col("id") * 1000000).alias("golden_id"))
    return build_corpus(v.msgs(t), golden, RULES, golden_id="golden_id")


@query("corpus_measures", with_(v.MSGS, FIRST_REPLY, v.EVALF, POOL) + f"""
SELECT count(*) AS pool_rows, count(*) FILTER (WHERE {LABELLED} AND {ANSWERED}) AS corpus_rows, {rate(f"count(*) FILTER (WHERE {LABELLED} AND {ANSWERED})", 'count(*)')} AS coverage,
  count(*) FILTER (WHERE coalesce(reply, '') = '') AS unanswered, count(*) FILTER (WHERE coalesce(reply, '') <> '' AND NOT ({ANSWERED})) AS not_resolving,
  count(*) FILTER (WHERE {ANSWERED} AND NOT coalesce({LABELLED}, false)) AS unlabelled FROM hits""")
def _(t):
    """What the pass that writes the corpus saw on its way."""
    golden = v.evalf(t).filter(F.col("gold_decision") == d.ESCALATE).select((F.col("id") * 1000000).alias("golden_id"))
    _, measures = store_corpus(t.spark, scratch(t), v.msgs(t), golden, RULES, golden_id="golden_id")
    return measures


SETTINGS = TriageSettings(
    sops=v.LABEL_SOPS, taxonomy=v.TAXONOMY, gates=v.GATES, catch_all=v.CATCH_ALL, other=v.OTHER, tau_low=v.TAU_LOW, tau_high=v.TAU_HIGH,
    any_dm=v.ANY_DM_WORDS, action=v.ACTION_WORDS, question_action=v.QUESTION_WORDS)

def triage_inputs(t):
    """(messages, past cases, stored verdicts); a few messages are a handle only, French ones have no verdict."""
    text = F.when(F.col("id") % 50 == 0, F.concat(F.lit("@u"), "id")).otherwise(F.col("customer_text"))
    messages = v.classified(t).withColumn("customer_text", text).select(
        "id", "customer_text", "predicted_intent", "embedding", "difficulty_tier", "gold_intent", "gold_decision", "lang")
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("brand_reply_text"))
    past = v.corpus(t).join(texts, "vec_id", "left").select("vec_id", "embedding", "silver_intent", "brand_reply_text")
    matched = sop_match(messages.select("id", "customer_text", "predicted_intent", "lang"), "predicted_intent", "customer_text", v.LABEL_SOPS)
    keyed = matched.select("id", "lang", "customer_text", r.candidate_procedure(F.lit(False), F.lit(None).cast("string"), F.col("sop")).alias("procedure"))
    verdicts = keyed.filter("lang <> 'fr'").groupBy(r.verdict_key(F.col("customer_text"), F.col("procedure")).alias("verdict_key")).agg(
        (F.min("id") % 3 != 0).alias("resolves_problem"), F.lit("stored").alias("reason"))
    return messages, past, verdicts


# Same chain in SQL: past case, gate, procedure, stored verdict, decision, grounding, draft.
MIXED = "mixed AS (SELECT * EXCLUDE (customer_text), CASE WHEN id % 50 = 0 THEN '@u' || id ELSE customer_text END AS customer_text FROM classified)"
TRIAGE_CTES = (
    v.EVALF, v.CORPUS, v.CLASSIFIED, v.SCOPES, v.top1_sql(), HIT_TEXT, DRAFTS, MIXED,
    f"""proc AS (SELECT c.*, {sop_name_sql()} AS sop_name, {sop_name_sql(what=lambda s: lit(s.sop_id))} AS sop_id, {sop_name_sql(what=lambda s: lit(' '.join(s.steps)))} AS sop_steps,
  {v.first_gate_sql(v.GATES, 'c.customer_text', 'c.predicted_intent')} AS gate, length({v.trim(f"regexp_replace(c.customer_text, {lit(v.HANDLE)}, '', 'g')")}) < 3 AS degenerate FROM mixed c)""",
    f"""store AS (SELECT sha256({v.trim('customer_text')} || '|||' || {v.trim(f"coalesce(sop_name || ': ' || sop_steps, {lit(d.GENERAL_PROCEDURE)})")}) AS k, min(id) % 3 <> 0 AS ok
  FROM proc WHERE lang <> 'fr' GROUP BY 1)""",
    f"""cases AS (SELECT p.*, t.hit_id, t.similarity, h.hit_reply, h.hit_reply IS NOT NULL AND {concrete_sql('h.hit_reply')} AS concrete
  FROM proc p LEFT JOIN top1 t ON t.id = p.id AND NOT p.degenerate LEFT JOIN hit_text h ON h.doc_id = t.hit_id)""",
    f"""keyed AS (SELECT *, sha256({v.trim('customer_text')} || '|||' || {v.trim(f"CASE WHEN concrete THEN hit_reply ELSE coalesce(sop_name || ': ' || sop_steps, {lit(d.GENERAL_PROCEDURE)}) END")}) AS k FROM cases)""",
    f"""ruled AS (SELECT c.*, CASE WHEN degenerate THEN 0 WHEN gate IS NOT NULL THEN 1 WHEN coalesce(similarity, 0.0) < {v.TAU_LOW} THEN 2 WHEN s.ok = false THEN 3 WHEN similarity >= {v.TAU_HIGH} THEN 4 WHEN s.ok THEN 5 ELSE 6 END AS rule
  FROM keyed c LEFT JOIN store s ON s.k = c.k)""",
    f"""routed AS (SELECT *, CASE WHEN rule IN (4, 5) THEN 'auto_handle' ELSE 'escalate' END AS decision,
    CASE rule WHEN 0 THEN 'layer_0_input' WHEN 1 THEN 'layer_1_hard_gate' WHEN 3 THEN 'layer_2_resolution_check_veto' WHEN 5 THEN 'layer_2_resolution_check_verified' ELSE 'layer_2_calibrated_confidence' END AS decision_layer,
    CASE rule WHEN 0 THEN 'degenerate_input' WHEN 1 THEN gate WHEN 3 THEN 'resolution_check_veto' END AS gate_triggered FROM ruled)""",
    f"""records AS (SELECT r.id, CASE WHEN rule = 0 THEN 'playback_issue' ELSE predicted_intent END AS predicted_intent, decision, decision_layer, gate_triggered, hit_id,
    CASE WHEN rule = 0 THEN 0.0 ELSE coalesce(similarity, 0.0) END::DOUBLE AS calibrated_confidence,
    coalesce(d.cached_decision = decision AND d.cached_reply IS NOT NULL, false) AS reused,
    CASE WHEN d.cached_decision = decision AND d.cached_reply IS NOT NULL THEN d.cached_reply ELSE {draft_sql()} END AS drafted_reply,
    CASE WHEN d.cached_decision = decision AND d.cached_reply IS NOT NULL THEN coalesce(d.cached_source, 'curated_sop')
         WHEN decision = 'escalate' THEN 'none' WHEN concrete THEN 'retrieved_case' ELSE 'curated_sop' END AS grounding_source,
    CASE WHEN decision = 'escalate' THEN NULL WHEN concrete THEN 'Retrieved historical tweet ' || hit_id || ': ' || substring(hit_reply, 1, 80) || '...'
         WHEN sop_id IS NOT NULL THEN 'Curated SOP [' || sop_id || ']: ' || sop_name ELSE {lit(d.GENERAL_SOP_EVIDENCE)} END AS evidence,
    difficulty_tier, gold_decision, gold_intent FROM routed r LEFT JOIN drafts d ON d.id = r.id)""",
)


@query("triage_batch", with_(*TRIAGE_CTES) + "SELECT * FROM records")
def triage_query(t):
    messages, past, verdicts = triage_inputs(t)
    records, _ = triage_batch(messages, past, SETTINGS, verdicts, drafts=stored_drafts(t))
    # Reason texts carry printed numbers whose rounding differs between engines.
    evidence = F.when(F.col("decision") == d.AUTO_HANDLE, F.array_join("evidence_used", "|"))
    return records.select("id", "predicted_intent", "decision", "decision_layer", "gate_triggered", "hit_id", "calibrated_confidence", "reused",
                          "drafted_reply", "grounding_source", evidence.alias("evidence"), "difficulty_tier", "gold_decision", "gold_intent")


def unpivot(section: str, names, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, '{n}' AS metric, {n}::DOUBLE AS value FROM {source}" for n in names)


# One label of the list has no row.
REPORTED = (*v.TAXONOMY, "never")
TAX = f"gold_intent IN {v.IN_TAXONOMY}"
REPORT_CTES = (
    *SPLIT_CTES, "tax AS (SELECT * FROM preds WHERE " + TAX + ")", CLASS_COUNTS.replace("FROM preds", "FROM tax"),
    f"""cls AS (SELECT CASE WHEN difficulty_tier IS NULL THEN 'classification' ELSE 'classification/' || difficulty_tier END AS section, total, correct, {rate('correct', 'total')} AS accuracy
  FROM (SELECT difficulty_tier, count(*) AS total, count(*) FILTER (WHERE gold_intent = predicted_intent) AS correct FROM tax GROUP BY GROUPING SETS ((), (difficulty_tier))))""",
    "avgs AS (SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * gold_n) / sum(gold_n), 6) AS weighted_f1 FROM scores)",
    f"""per_label AS (SELECT 'intent/' || l.label AS section, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, coalesce(gold_n, 0) AS support
  FROM (SELECT unnest([{', '.join(lit(x) for x in REPORTED)}]) AS label) l LEFT JOIN scores s ON s.label = l.label)""",
    f"""routing AS (SELECT 'routing/' || coalesce(split, 'full_set') || '/' || coalesce(difficulty_tier, 'all') AS section, {RATED}
  FROM (SELECT split, difficulty_tier, {ROUTED} FROM split_rows GROUP BY CUBE (split, difficulty_tier)))""",
    f"conf AS (SELECT {MEANS} FROM preds)",
)


@query("evaluation_report", with_(*REPORT_CTES) + " UNION ALL ".join([
    unpivot("section", ("total", "correct", "accuracy"), "cls"), unpivot("'classification'", ("macro_f1", "weighted_f1"), "avgs"),
    unpivot("section", ("precision", "recall", "f1", "support"), "per_label"),
    unpivot("section", ("total", "correct", "fah_count", "fah_total", "fe_count", "fe_total", "accuracy", "fah_rate", "fe_rate", "cost"), "routing"),
    "SELECT 'grounding_source', grounding_source, count(*)::DOUBLE FROM preds GROUP BY 2",
    "SELECT 'gate_triggered', gate_triggered, count(*)::DOUBLE FROM preds WHERE gate_triggered IS NOT NULL GROUP BY 2",
    unpivot("'confidence'", ("mean_auto_handle", "mean_escalate"), "conf")]))
def _(t):
    return evaluation_report(v.split_preds(t), REPORTED)


@query("judge_validation_report", with_(v.RATINGS, AGREEMENT, KAPPA) + " UNION ALL ".join([
    unpivot("difficulty_tier", ("n", "agreed", "agreement_rate", "discordant", "groundedness_mae", "tone_mae"), "agreement"),
    unpivot("difficulty_tier", ("kappa", "standard_error", "ci_low", "ci_high"), "kappa"),
    *[f"SELECT 'overall', metric || '_spearman', spearman FROM ({rho_sql(*s)})" for s in SCORES]]))
def _(t):
    human, judge = v.ratings(t)
    return judge_validation_report(human, judge, SCORES)


# Retrieval baseline: unlabelled turns ask, with a decision and an intent derived from the row.
B3_TAUS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
B3_GATES = (v.REDIRECT_WORDS,)


@query("baseline3_report", with_(*TFIDF_CTES, f"""golden AS (
  SELECT msg_id AS id, text, CASE WHEN contains(lower(text), 'der') THEN 'de' ELSE 'en_the' END AS gold_intent, CASE WHEN msg_id % 3 = 0 THEN 'escalate' ELSE 'auto_handle' END AS gold_decision,
    CASE WHEN length(text) < 200 THEN 'easy' ELSE 'hard' END AS difficulty_tier FROM silver WHERE silver_intent IS NULL),
b3 AS (SELECT g.*, {hit(v.REDIRECT_WORDS, 'g.text')} AS gated, coalesce(n.similarity, 0.0) AS similarity, s.silver_intent AS hit_intent
  FROM golden g LEFT JOIN nn n ON n.id = g.id LEFT JOIN silver s ON s.msg_id = n.hit_id)""") + f"""
SELECT tau, {RATED}, accuracy_easy, accuracy_hard, (SELECT {rate('count(*) FILTER (WHERE gold_intent = hit_intent)', 'count(*)')} FROM b3 WHERE gold_intent IN ('de', 'en_the')) AS intent_match
FROM (SELECT tau, {ROUTED}, {rate("count(*) FILTER (WHERE difficulty_tier = 'easy' AND gold_decision = decision)", "count(*) FILTER (WHERE difficulty_tier = 'easy')")} AS accuracy_easy,
  {rate("count(*) FILTER (WHERE difficulty_tier = 'hard' AND gold_decision = decision)", "count(*) FILTER (WHERE difficulty_tier = 'hard')")} AS accuracy_hard
  FROM (SELECT b.*, x.tau, CASE WHEN NOT gated AND similarity >= x.tau THEN 'auto_handle' ELSE 'escalate' END AS decision FROM b3 b, (SELECT unnest({list(B3_TAUS)}::DOUBLE[]) AS tau) x) GROUP BY 1)""")
def _(t):
    rows = labelled_turns(t)
    golden = rows.filter(F.col("silver_intent").isNull()).select(
        "id", "text", F.when(F.lower("text").contains("der"), "de").otherwise("en_the").alias("gold_intent"),
        F.when(F.col("id") % 3 == 0, d.ESCALATE).otherwise(d.AUTO_HANDLE).alias("gold_decision"),
        F.when(F.length("text") < 200, "easy").otherwise("hard").alias("difficulty_tier"))
    return retrieval_policy_report(golden, rows.filter(F.col("silver_intent").isNotNull()), B3_GATES, ("de", "en_the"), B3_TAUS)


@query("adversarial_invariant", f"""SELECT gate, count(*) AS fired, 0::BIGINT AS violations FROM (
  SELECT {v.first_gate_sql(v.GATES, 'text', "CASE WHEN lang = 'es' THEN 'c9' END")} AS gate FROM documents) WHERE gate IS NOT NULL GROUP BY 1""")
def _(t):
    """Gated messages escalate even at similarity 0.99 with an approving verdict."""
    intent = F.when(F.col("lang") == "es", v.OTHER)
    rows = t.texts().select(first_gate(F.col("text"), v.GATES, intent, v.OTHER, v.CATCH_ALL).alias("gate")).filter("gate IS NOT NULL")
    routed = rows.withColumn("r", decide(F.col("gate"), F.lit(0.99), F.lit(True)))
    bad = (F.col("r.decision") != d.ESCALATE) | (F.col("r.gate_triggered") != F.col("gate.gate"))
    return routed.groupBy("gate.gate").agg(F.count(F.lit(1)).alias("fired"), F.count_if(bad).alias("violations"))


def length_judge():
    """Stands in for a hosted judge: rates by the length of the reply, and says nothing readable of some."""

    def score(batch: pd.DataFrame) -> pd.Series:
        n = batch["text"].str.len()
        answer = '{"groundedness_score": "' + (1 + n % 5).astype(str) + '", "tone_score": 4, "judge_decision": "' + (n % 3 == 0).map({True: "fail", False: "pass"}) + '"}'
        return answer.where(n % 11 != 0, "no idea")

    return score


@query("judge_run", with_(LINKED, SYNTHETIC, """judged AS (SELECT l.page_id AS id, length(reply) AS n, synthetic_url FROM linked l JOIN synthetic s ON s.page_id = l.page_id)""",
                          """f AS (SELECT id, n, synthetic_url, CASE WHEN n % 11 = 0 OR n % 3 = 0 THEN 'fail' ELSE 'pass' END AS said, CASE WHEN n % 11 = 0 THEN 3 ELSE 1 + n % 5 END AS g,
  CASE WHEN n % 11 = 0 THEN 3 ELSE 4 END AS tone FROM judged)""") + """
SELECT id, CASE WHEN id % 2 = 0 THEN 'pass' ELSE 'fail' END AS human_decision, CASE WHEN synthetic_url OR n > 2000 THEN 'fail' ELSE said END AS judge_decision,
  (CASE WHEN synthetic_url THEN 1 ELSE g END)::BIGINT AS groundedness_score, tone::BIGINT AS tone_score, n AS char_count, synthetic_url AS has_synthetic_url, 'judge-a' AS judge_model FROM f""")
def _(t):
    """An old result for another model does not count, so the whole audit is judged."""
    audit = linked(t).select(F.col("page_id").alias("id"), F.lit("").alias("customer_text"), F.col("reply").alias("drafted_reply"), F.col("evidence").alias("evidence_used"))
    human = audit.select("id", F.when(F.col("id") % 2 == 0, "pass").otherwise("fail").alias("human_decision"))
    stale = audit.select("id").withColumn("judge_model", F.lit("judge-b"))
    return judged_audit(audit, human, length_judge, "judge-a", stale, 2000).drop("judge_notes")


def length_classifier():
    """Stands in for a hosted classifier."""
    return lambda batch: '{"intent": "c' + (batch["text"].str.len() % 9).astype(str) + '", "confidence": "0.5"}'


def length_verifier():
    return lambda batch: '{"resolves_problem": "' + (batch["customer_text"].str.strip().str.len() % 2 == 0).map({True: "true", False: "false"}) + '"}'


def length_drafter():
    """Has no reply to some messages."""
    def score(batch: pd.DataFrame) -> pd.Series:
        n = batch["customer_text"].str.len()
        return (' "Thanks" ' + n.astype(str) + " ").where(n % 7 != 0, None)

    return score


# The same chain with French messages unknown to every store.
FRESH = f"coalesce(s.ok, length({v.trim('c.customer_text')}) % 2 = 0)"
RUN_CTES = tuple(
    {v.CLASSIFIED: v.CLASSIFIED.replace("classified AS (", "stored_classes AS (", 1) + """,
classified AS (SELECT * REPLACE (CASE WHEN lang = 'fr' THEN 'c' || (length(customer_text) % 9) ELSE predicted_intent END AS predicted_intent) FROM stored_classes)"""}.get(cte, cte) for cte in TRIAGE_CTES)
RUN_CTES = tuple(
    cte.replace("WHEN s.ok = false THEN 3", f"WHEN {FRESH} = false THEN 3").replace("WHEN s.ok THEN 5", f"WHEN {FRESH} THEN 5")
    .replace(f"ELSE {draft_sql()} END AS drafted_reply", f"WHEN rule = 0 THEN {lit(d.FALLBACK_REPLY)} WHEN length(customer_text) % 7 = 0 THEN {draft_sql()} ELSE 'Thanks ' || length(customer_text) END AS drafted_reply")
    for cte in RUN_CTES)


@query("triage_run", with_(*RUN_CTES) + "SELECT * EXCLUDE (evidence) FROM records WHERE id % 9 <> 0")
def _(t):
    """French messages are classified and verified, every message gets a draft, and a ninth was done before."""
    messages, past, verdicts = triage_inputs(t)
    stored = v.classified(t).filter("lang <> 'fr'").select("id", "predicted_intent", F.lit(0.9).alias("confidence"))
    asked = messages.drop("predicted_intent")
    scorers = Scorers(length_classifier, length_verifier, length_drafter)
    run = triage_run(asked, past, SETTINGS, scorers, stored, verdicts, stored_drafts(t), messages.filter("id % 9 = 0").select("id"))
    return run.records.select("id", "predicted_intent", "decision", "decision_layer", "gate_triggered", "hit_id", "calibrated_confidence", "reused",
                              "drafted_reply", "grounding_source", "difficulty_tier", "gold_decision", "gold_intent")
