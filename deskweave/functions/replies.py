"""Columns over agent replies, drafts and their grounding evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import defaults as d
from .rules import Rule
from .text import bind, drop_all_handles, extract_urls, strip_urls, trim_all


def visible_resolution(reply: Column, redirect: Rule = d.DM_REDIRECT, min_chars: int = d.MIN_REPLY_LEN) -> Column:
    """The reply exists, is long enough and does not move the case to private messages."""
    return F.coalesce((F.length(reply) >= min_chars) & ~redirect.hits(reply), F.lit(False))


def ends_with_question(reply: Column) -> Column:
    return F.coalesce(trim_all(reply).endswith("?"), F.lit(False))


def concrete_resolution(reply: Column, any_dm: Rule = d.ANY_DM, action: Rule = d.ACTION_VERB,
                        question_action: Rule = d.ACTION_QUESTION) -> Column:
    """The reply names an action and is neither a redirect nor a bare question."""
    bare_question = ends_with_question(reply) & ~question_action.hits(reply)
    return ~any_dm.hits(reply) & action.hits(reply) & ~bare_question


def reply_category(reply: Column, any_dm: Rule = d.ANY_DM, action: Rule = d.ACTION_VERB,
                   question_action: Rule = d.ACTION_QUESTION) -> Column:
    """Four exclusive kinds of reply."""
    return (
        F.when(any_dm.hits(reply), "DM-redirect")
        .when(concrete_resolution(reply, any_dm, action, question_action), "concrete-resolution")
        .when(ends_with_question(reply), "diagnostic-only")
        .otherwise("generic-status")
    )


def is_degenerate(text: Column) -> Column:
    """Nothing (or fewer than three characters) left once the handles are gone."""
    return F.length(drop_all_handles(text)) < 3


def synthetic_url(reply: Column, evidence: Column) -> Column:
    """Some URL of the reply neither contains nor is contained in an evidence URL."""

    def cleaned(text: Column) -> Column:
        return F.transform(extract_urls(text), lambda u: F.regexp_replace(u, r"""[.,?!:;)"']+$""", ""))

    return bind(cleaned(evidence), lambda known: F.exists(
        cleaned(reply), lambda r: ~F.exists(known, lambda e: F.contains(e, r) | F.contains(r, e))))


def evidence_items(decision: Column, reason: Column, concrete: Column, hit_id: Column, hit_reply: Column,
                   sop: Column, prefix: str = "Retrieved historical tweet",
                   general: str = d.GENERAL_SOP_EVIDENCE) -> Column:
    """One-element evidence list: routing reason, past case or procedure."""
    return F.array(
        F.when(decision == d.ESCALATE, F.concat(F.lit("Escalation Routing: "), reason))
        .when(concrete, F.concat(F.lit(prefix + " "), hit_id.cast("string"), F.lit(": "),
                                 F.substring(hit_reply, 1, d.EVIDENCE_CHARS), F.lit("...")))
        .when(sop.isNotNull(), F.concat(F.lit("Curated SOP ["), sop["sop_id"], F.lit("]: "), sop["name"]))
        .otherwise(F.lit(general))
    )


def grounding_source(decision: Column, concrete: Column) -> Column:
    return (
        F.when(decision == d.ESCALATE, "none")
        .when(F.coalesce(concrete, F.lit(False)), "retrieved_case")
        .otherwise("curated_sop")
    )


def candidate_procedure(concrete: Column, hit_reply: Column, sop: Column,
                        general: str = d.GENERAL_PROCEDURE) -> Column:
    """Text put before the verifier: the past reply, else the procedure, else a general one."""
    return F.coalesce(
        F.when(concrete, hit_reply),
        F.concat(sop["name"], F.lit(": "), F.array_join(sop["steps"], " ")),
        F.lit(general),
    )


def policy_context(sop: Column, product: str = "Product") -> Column:
    """Procedure laid out for a prompt."""
    return F.coalesce(
        F.concat(F.lit("Grounding Policy Reference: ["), sop["name"], F.lit("]\nApplicable Procedure:\n"),
                 F.array_join(sop["steps"], "\n")),
        F.lit(f"General {product} Support Guidance: Recommend checking account status and restarting device."),
    )


def clean_draft(draft: Column, decision: Column, fallback: str = d.FALLBACK_REPLY) -> Column:
    """Trim, drop double quotes; auto-handled drafts also lose their URLs."""
    unquoted = F.translate(trim_all(draft), '"', "")
    return F.coalesce(F.when(decision == d.AUTO_HANDLE, strip_urls(unquoted)).otherwise(unquoted), F.lit(fallback))


def template_draft(decision: Column, sop: Column, concrete: Column, hit_reply: Column, fallback: str = d.FALLBACK_REPLY) -> Column:
    """Deterministic reply that stands in for a generated one; whole, whatever its length, which guardrails judge later."""
    grounded = F.coalesce(
        F.when(concrete, hit_reply),
        F.concat(F.lit("Please try this: "), F.array_join(sop["steps"], " ")),
        F.lit(d.GENERAL_PROCEDURE),
    )
    return F.when(decision == d.ESCALATE, F.lit(fallback)).otherwise(F.translate(strip_urls(grounded), '"', ""))


def verdict_key(text: Column, procedure: Column) -> Column:
    """Content hash under which a verdict is stored."""
    return F.sha2(F.concat(trim_all(text), F.lit("|||"), trim_all(procedure)), 256)
