"""Requests to and answers from external scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import defaults as d
from .text import trim_all

_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def fewshot_messages(text: Column, system_prompt: str, examples: Sequence[tuple[str, str]]) -> Column:
    """Chat messages: system prompt, (question, answer) examples, then the query."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def question(body: Column) -> Column:
        return F.concat(F.lit('Customer tweet: "'), body, F.lit('"'))

    turns = [message("system", F.lit(system_prompt))]
    for asked, answered in examples:
        turns += [message("user", question(F.lit(asked))), message("assistant", F.lit(answered))]
    turns.append(message("user", question(F.coalesce(text, F.lit("")))))
    return F.array(*turns)


def _chat(instructions: str, *parts: Column) -> Column:
    """Chat messages: instructions, then one user turn made of ``parts``, a line each."""
    body = F.concat_ws("\n", *parts)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(instructions).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))


def verifier_request(text: Column, procedure: Column, instructions: str = d.VERIFY_INSTRUCTIONS) -> Column:
    """Does the procedure solve what the message asks?"""
    return _chat(instructions, _line("Message", text), _line("Procedure", procedure))


def draft_request(text: Column, decision: Column, evidence: Column, instructions: str = d.DRAFT_INSTRUCTIONS) -> Column:
    """A reply to the message in line with the decision and the evidence."""
    return _chat(instructions, _line("Message", text), _line("Decision", decision), _line("Evidence", evidence))


def judge_request(text: Column, reply: Column, evidence: Column, instructions: str = d.JUDGE_INSTRUCTIONS) -> Column:
    """A rating of the reply against its evidence."""
    return _chat(instructions, _line("Message", text), _line("Reply", reply), _line("Evidence", evidence))


def _parse(raw: Column, schema: str) -> Column:
    return F.from_json(raw, schema + ", _bad string", _STRICT)


def _json_block(raw: Column) -> Column:
    """Text from the first opening to the last closing brace; '' when there is none."""
    return F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)


def _number(text: Column) -> Column:
    """The number a text holds, else null; NaN and infinities are no numbers here."""
    value = trim_all(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def _is_object(raw: Column, parsed: Column) -> Column:
    return F.coalesce(parsed["_bad"].isNull() & trim_all(raw).startswith("{"), F.lit(False))


def parse_intent(raw: Column, intents: Sequence[str] = d.INTENTS, fallback: str = d.FALLBACK_INTENT) -> Column:
    """Intent answer -> (intent, confidence, reason).

    A known name is normalised in case and blanks; otherwise the first known
    name inside the answer counts; an unreadable answer gives the fallback.
    A confidence may be quoted; one that is no number counts as 0 and leaves the intent as it is.
    """
    parsed = _parse(raw, "intent string, confidence string, reason string")
    named = F.lower(trim_all(parsed["intent"]))
    inside = F.coalesce(*[F.when(named.contains(name), F.lit(name)) for name in intents])
    known = F.when(named.isin(*intents), named)
    return F.when(
        _is_object(raw, parsed),
        F.struct(
            F.coalesce(known, inside, parsed["intent"], F.lit("")).alias("intent"),
            F.coalesce(_number(parsed["confidence"]), F.lit(0.0)).alias("confidence"),
            F.coalesce(parsed["reason"], F.lit("")).alias("reason"),
        ),
    ).otherwise(
        F.struct(
            F.lit(fallback).alias("intent"),
            F.lit(0.20).alias("confidence"),
            F.lit("Classification error: unreadable response").alias("reason"),
        )
    )


def parse_verdict(raw: Column) -> Column:
    """Verifier answer -> (resolves_problem, confidence, reason, cacheable).

    An answer without any JSON block is a stored 'no'; a broken block or a
    missing answer counts as a failed call and must not be cached.  Numbers and truth values may be quoted;
    ``true``, ``yes`` and non-zero numbers say yes, anything else no, and a confidence that is no number is 0.8.
    """
    block = _json_block(raw)
    parsed = _parse(block, "resolves_problem string, confidence string, reason string")
    said = F.lower(trim_all(parsed["resolves_problem"]))
    yes = F.coalesce(said.isin("true", "yes") | (_number(said) != 0), F.lit(False))

    def verdict(resolves: Column, confidence: Column, reason: Column, cacheable: bool) -> Column:
        return F.struct(resolves.alias("resolves_problem"), confidence.alias("confidence"),
                        reason.alias("reason"), F.lit(cacheable).alias("cacheable"))

    failed = verdict(F.lit(False), F.lit(0.0), F.lit("Resolution checker API error: unreadable response"), False)
    return (
        F.when(raw.isNull(), failed)
        .when(block == "", verdict(F.lit(False), F.lit(0.5), F.lit(d.UNPARSED_VERDICT_REASON), True))
        .when(
            _is_object(block, parsed),
            verdict(yes, F.coalesce(_number(parsed["confidence"]), F.lit(0.8)),
                    trim_all(F.coalesce(parsed["reason"], F.lit(""))), True),
        )
        .otherwise(failed)
    )


def parse_judge(raw: Column) -> Column:
    """Judge answer -> (groundedness_score, tone_score, judge_decision, judge_notes)."""
    block = _json_block(raw)
    parsed = _parse(block, "groundedness_score string, tone_score string, judge_decision string, judge_notes string")

    def score(name: str) -> Column:
        return F.when(parsed[name].isNull(), F.lit(3)).otherwise(parsed[name].try_cast("double").cast("int"))

    readable = _is_object(block, parsed) & score("groundedness_score").isNotNull() & score("tone_score").isNotNull()
    return F.when(
        readable,
        F.struct(
            score("groundedness_score").alias("groundedness_score"),
            score("tone_score").alias("tone_score"),
            F.lower(trim_all(F.coalesce(parsed["judge_decision"], F.lit("fail")))).alias("judge_decision"),
            F.coalesce(parsed["judge_notes"], F.lit("")).alias("judge_notes"),
        ),
    ).otherwise(
        F.struct(
            F.lit(3).alias("groundedness_score"),
            F.lit(3).alias("tone_score"),
            F.lit("fail").alias("judge_decision"),
            F.lit("Judge parsing exception: unreadable response").alias("judge_notes"),
        )
    )


def judge_guardrails(judged: Column, synthetic: Column, n_chars: Column,
                     max_chars: int = d.MAX_REPLY_CHARS) -> Column:
    """Overrule the judge on made-up URLs and over-long replies, nothing else."""
    too_long = (n_chars > max_chars) & (judged["judge_decision"] == "pass")
    return F.struct(
        F.when(synthetic, F.lit(1)).otherwise(judged["groundedness_score"]).alias("groundedness_score"),
        judged["tone_score"].alias("tone_score"),
        F.when(synthetic | too_long, F.lit("fail")).otherwise(judged["judge_decision"]).alias("judge_decision"),
        F.concat(
            F.when(synthetic, F.lit("Deterministic Guardrail Triggered: Synthetic URL detected in reply. "))
            .when(too_long, F.concat(F.lit("Exceeds reply limit ("), n_chars.cast("string"), F.lit(" chars). ")))
            .otherwise(F.lit("")),
            judged["judge_notes"],
        ).alias("judge_notes"),
    )
