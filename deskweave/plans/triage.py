"""Batch triage: gate, retrieve, verify, decide, ground, draft."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import replies as r
from ..functions.defaults import Sop
from ..functions.responses import parse_verdict
from ..functions.rules import Rule, first_gate
from ..functions.text import trim_all
from ..operators.neighbours import knn
from ..operators.procedures import sop_match
from ..operators.scoring import Scorer, lookup, misses, score_batch
from ..operators.triage import decide, reuse_drafts, usable_similarity, verifier_needed
from ..session import cut_lineage


@dataclass(frozen=True)
class TriageSettings:
    sops: Sequence[Sop]
    taxonomy: Sequence[str] = d.INTENTS
    gates: Sequence[Rule] = d.GATES
    catch_all: Rule = d.OUT_OF_TAXONOMY
    other: str = d.OTHER
    tau_low: float = d.TAU_LOW
    tau_high: float = d.TAU_HIGH
    scoped: bool = True
    verify: bool = True
    any_dm: Rule = d.ANY_DM
    action: Rule = d.ACTION_VERB
    question_action: Rule = d.ACTION_QUESTION


def prepare(messages: DataFrame, corpus: DataFrame, s: TriageSettings) -> DataFrame:
    """Everything known before the verifier speaks.

    ``messages``: id, customer_text, predicted_intent, embedding (plus any
    columns to carry along).  ``corpus``: vec_id, embedding, silver_intent,
    brand_reply_text.  Only ids and scores go through the neighbour search;
    texts are attached afterwards.
    """
    carried = [c for c in messages.columns if c != "embedding"]
    text, intent = F.col("customer_text"), F.col("predicted_intent")
    searchable = messages.filter(~r.is_degenerate(text))
    scopes = F.array(intent) if s.scoped else F.array().cast("array<string>")
    hits = knn(searchable.select("id", "embedding", "predicted_intent"), corpus, 1, scopes=scopes,
               corpus_scope=F.col("silver_intent"), taxonomy=s.taxonomy if s.scoped else ())
    replies = corpus.select("vec_id", F.col("brand_reply_text").alias("hit_reply"), F.col("silver_intent").alias("hit_intent"))
    top = hits.join(replies, "vec_id").select(
        "id", F.col("vec_id").alias("hit_id"), "similarity", "hit_reply", "hit_intent")
    gated = messages.select(
        *carried, r.is_degenerate(text).alias("degenerate"),
        first_gate(text, s.gates, intent, s.other, s.catch_all).alias("gate"))
    joined = gated.join(top, "id", "left").withColumn(
        "concrete", F.col("hit_reply").isNotNull() & r.concrete_resolution(F.col("hit_reply"), s.any_dm, s.action, s.question_action))
    grounded = sop_match(joined, "predicted_intent", "customer_text", s.sops)
    if s.scoped:
        procedure_sop = F.col("sop")
    else:
        # A global search verifies against the procedures of the case it found.
        grounded = grounded.withColumn("_case_intent", F.coalesce("hit_intent", "predicted_intent"))
        grounded = sop_match(grounded, "_case_intent", "customer_text", s.sops, "_case_sop").drop("_case_intent")
        procedure_sop = F.col("_case_sop")
    wants = F.lit(s.verify) & ~F.col("degenerate") & verifier_needed(F.col("gate"), F.col("similarity"), _low(s))
    asked = grounded.withColumn(
        "procedure", r.candidate_procedure(F.col("concrete"), F.col("hit_reply"), procedure_sop)
    ).withColumn("needs_verdict", wants)
    return asked.withColumn("verdict_key", _request_key(text, F.col("procedure"))).drop("_case_sop")


def _low(s: TriageSettings) -> float:
    return s.tau_low if s.verify else s.tau_high


def _request_key(text: Column, procedure: Column) -> Column:
    """Content hash; rows that need no verdict get a key of their own that matches nothing.

    (One shared null key would send all of them to the same task.)
    """
    return F.when(F.col("needs_verdict"), r.verdict_key(text, procedure)).otherwise(
        F.concat(F.lit("unasked:"), F.col("id").cast("string")))


def verdict_requests(prepared: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (verdict_key, customer_text, procedure) without a stored verdict."""
    asked = prepared.filter("needs_verdict").select("verdict_key", "customer_text", "procedure")
    return misses(asked.filter((trim_all(F.col("customer_text")) != "") & (trim_all(F.col("procedure")) != "")),
                  cache, "verdict_key")


def verdicts_from_scores(scored: DataFrame) -> DataFrame:
    """Parsed answers: (verdict_key, resolves_problem, confidence, reason, cacheable)."""
    return scored.withColumn("v", parse_verdict(F.col("raw"))).select("verdict_key", "v.*")


def finish(prepared: DataFrame, verdicts: DataFrame, s: TriageSettings, drafts: DataFrame | None = None,
           template: bool = True) -> DataFrame:
    """Decide, pick the grounding, reuse or draft the reply."""
    stored = verdicts.select("verdict_key", F.col("resolves_problem").alias("resolves"),
                             F.col("reason").alias("verdict_reason"))
    known = lookup(prepared, stored, "verdict_key")
    blank = F.col("needs_verdict") & ((trim_all(F.col("customer_text")) == "") | (trim_all(F.col("procedure")) == ""))
    known = known.withColumn("resolves", F.when(blank, F.lit(False)).otherwise(F.col("resolves"))).withColumn(
        "verdict_reason", F.when(blank, F.lit(d.EMPTY_VERDICT_REASON)).otherwise(F.col("verdict_reason")))
    routed = known.withColumn("r", decide(F.col("gate"), F.col("similarity"), F.col("resolves"),
                                          F.col("verdict_reason"), _low(s), s.tau_high))
    empty = F.col("degenerate")
    decided = routed.withColumns({
        "predicted_intent": F.when(empty, F.lit(d.FALLBACK_INTENT)).otherwise(F.col("predicted_intent")),
        "decision": F.when(empty, F.lit(d.ESCALATE)).otherwise(F.col("r.decision")),
        "decision_reason": F.when(empty, F.lit(d.DEGENERATE_REASON)).otherwise(F.col("r.decision_reason")),
        "gate_triggered": F.when(empty, F.lit("degenerate_input")).otherwise(F.col("r.gate_triggered")),
        "decision_layer": F.when(empty, F.lit("layer_0_input")).otherwise(F.col("r.decision_layer")),
        "threshold_used": F.col("r.threshold_used"),
        "calibrated_confidence": F.when(empty, F.lit(0.0)).otherwise(usable_similarity(F.col("similarity"))),
    }).withColumn("grounding_source", F.when(empty, F.lit("none")).otherwise(r.grounding_source(F.col("decision"), F.col("concrete"))))
    evidence = r.evidence_items(F.col("decision"), F.col("decision_reason"), F.col("concrete"), F.col("hit_id"),
                                F.col("hit_reply"), F.col("sop"))
    decided = decided.withColumn(
        "evidence_used", F.when(empty, F.array(F.lit(d.DEGENERATE_EVIDENCE))).otherwise(evidence))
    if template:
        fresh = r.template_draft(F.col("decision"), F.col("sop"), F.col("concrete"), F.col("hit_reply"))
        decided = decided.withColumn("_fresh", F.when(empty, F.lit(d.FALLBACK_REPLY)).otherwise(fresh))
    else:
        decided = decided.withColumn("_fresh", F.lit(None).cast("string"))
    if drafts is None:
        out = decided.withColumns({"reused": F.lit(False), "drafted_reply": F.col("_fresh")})
    else:
        out = reuse_drafts(decided, drafts).withColumns({
            "drafted_reply": F.coalesce(F.col("drafted_reply"), F.col("_fresh")),
            "grounding_source": F.coalesce(F.col("reply_source"), F.col("grounding_source")),
        }).drop("reply_source")
    return out.drop("r", "_fresh", "gate", "sop", "procedure", "verdict_key", "verdict_reason", "degenerate", "confidence")


def triage_batch(messages: DataFrame, corpus: DataFrame, s: TriageSettings, verdict_cache: DataFrame,
                 scorer_factory: Callable[[], Scorer] | None = None, drafts: DataFrame | None = None,
                 default_checkpoint_dir: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Full run; returns the records and the verdicts worth storing.

    With a scorer the prepared rows and the answers feed two consumers each, and
    an external call must not be repeated by a recomputation, so both are
    checkpointed in the cluster's shared folder.
    """
    prepared = prepare(messages, corpus, s)
    if scorer_factory is None:
        return finish(prepared, verdict_cache, s, drafts), None
    prepared = cut_lineage(prepared, default_checkpoint_dir)
    requests = verdict_requests(prepared, verdict_cache)
    scored = cut_lineage(score_batch(requests, "verdict_key", scorer_factory), default_checkpoint_dir)
    answers = verdicts_from_scores(scored)
    columns = ["verdict_key", "resolves_problem", "reason"]
    verdicts = verdict_cache.select(*columns).unionByName(answers.select(*columns))
    return finish(prepared, verdicts, s, drafts), answers.filter("cacheable").drop("cacheable")
