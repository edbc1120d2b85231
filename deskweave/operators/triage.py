"""Routing decision: ordered gates, two similarity thresholds, a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defaults as d


def usable_similarity(similarity: Column) -> Column:
    """No hit counts as 0.  NaN also does: Spark sorts it above every threshold."""
    return F.when(similarity.isNull() | F.isnan(similarity), F.lit(0.0)).otherwise(similarity)


def decide(gate: Column, similarity: Column, resolves: Column, verdict_reason: Column | None = None,
           tau_low: float | Column = d.TAU_LOW, tau_high: float | Column = d.TAU_HIGH) -> Column:
    """Decision struct; the first row of the decision table that applies wins.

    ``gate`` is the struct of the first hard gate (or null) and ``resolves`` the
    nullable verdict of the verifier.
    """
    low = tau_low if isinstance(tau_low, Column) else F.lit(float(tau_low))
    high = tau_high if isinstance(tau_high, Column) else F.lit(float(tau_high))
    s = usable_similarity(similarity)
    broken = F.coalesce(F.isnan(similarity), F.lit(False))
    why = F.coalesce(verdict_reason, F.lit("")) if verdict_reason is not None else F.lit("")

    def outcome(decision: str, layer: str, gate_name: Column, threshold: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(decision).alias("decision"), reason.alias("decision_reason"),
            gate_name.cast("string").alias("gate_triggered"), s.alias("calibrated_confidence"),
            threshold.alias("threshold_used"), F.lit(layer).alias("decision_layer"))

    none = F.lit(None)
    calibrated = "layer_2_calibrated_confidence"
    return (
        F.when(gate.isNotNull(),
               outcome(d.ESCALATE, "layer_1_hard_gate", gate["gate"], low, gate["reason"]))
        .when(broken | (s < low),
              outcome(d.ESCALATE, calibrated, none, low,
                      F.format_string(d.REASON_LOW, s, low)))
        .when(~F.coalesce(resolves, F.lit(True)),
              outcome(d.ESCALATE, "layer_2_resolution_check_veto", F.lit("resolution_check_veto"), low,
                      F.concat(F.lit(d.REASON_VETO), why)))
        .when(s >= high,
              outcome(d.AUTO_HANDLE, calibrated, none, high,
                      F.format_string(d.REASON_HIGH, s, high)))
        .when(F.coalesce(resolves, F.lit(False)),
              outcome(d.AUTO_HANDLE, "layer_2_resolution_check_verified", none, low,
                      F.concat(F.format_string(d.REASON_VERIFIED, s, low), why)))
        .otherwise(
            outcome(d.ESCALATE, calibrated, none, high,
                    F.format_string(d.REASON_UNVERIFIED, s, high)))
    )


def verifier_needed(gate: Column, similarity: Column, tau_low: float = d.TAU_LOW) -> Column:
    """Only ungated messages at or above the lower threshold are worth a verifier call."""
    return gate.isNull() & (usable_similarity(similarity) >= tau_low)


def degenerate_record(message_id: Column) -> Column:
    """Fixed record for messages with no usable text."""
    return F.struct(
        message_id.alias("id"), F.lit(d.FALLBACK_INTENT).alias("predicted_intent"),
        F.lit(d.FALLBACK_REPLY).alias("drafted_reply"), F.lit(d.ESCALATE).alias("decision"),
        F.lit(d.DEGENERATE_REASON).alias("decision_reason"), F.lit("none").alias("grounding_source"),
        F.array(F.lit(d.DEGENERATE_EVIDENCE)).alias("evidence_used"),
        F.lit("degenerate_input").alias("gate_triggered"), F.lit(0.0).alias("calibrated_confidence"))


def with_cached_intent(messages: DataFrame, predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Left-join stored intents; a stored row without confidence counts as certain.

    Rows whose ``known_intent`` stays null still have to be classified.
    """
    stored = predictions.select(
        F.col(id_col), F.col("predicted_intent").alias("known_intent"),
        F.coalesce(F.col("confidence"), F.lit(1.0)).alias("known_confidence"))
    return messages.join(stored, id_col, "left")


def reuse_drafts(decided: DataFrame, drafts: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep a stored draft if its decision is unchanged and it has text.

    ``drafts`` has (id, cached_decision, cached_reply, cached_source); adds
    ``reused``, ``drafted_reply`` and ``reply_source``.
    """
    joined = decided.join(drafts, id_col, "left")
    same = (F.coalesce(F.col("cached_decision") == F.col("decision"), F.lit(False))
            & F.col("cached_reply").isNotNull())
    return joined.select(
        *decided.columns, same.alias("reused"), F.when(same, F.col("cached_reply")).alias("drafted_reply"),
        F.when(same, F.coalesce(F.col("cached_source"), F.lit("curated_sop"))).alias("reply_source"))
