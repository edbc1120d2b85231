"""Whole runs: classify what is not stored, triage, draft, resume; text to search; judging an audit."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import replies as r
from ..functions.responses import (
    draft_request,
    fewshot_messages,
    judge_guardrails,
    judge_request,
    parse_intent,
    parse_judge,
    verifier_request,
)
from ..operators.agreement import merge_ratings
from ..operators.neighbours import knn
from ..operators.scoring import Scorer, cache_valid, hashed_vectors, score_batch
from ..operators.triage import with_cached_intent
from ..session import cut_lineage
from ..sources.answers import AnswerLog
from ..sources.tables import read_or_build, still_to_do
from .triage import TriageSettings, finish, prepare, verdict_requests, verdicts_from_scores

Factory = Callable[[], Scorer]


@dataclass(frozen=True)
class Scorers:
    """Scorers of a run; each gets a batch with ``request``, an array of chat messages, and the columns it was made from."""

    classify: Factory
    verify: Factory | None = None
    draft: Factory | None = None
    instructions: str = d.CLASSIFY_INSTRUCTIONS
    examples: Sequence[tuple[str, str]] = ()
    log_dir: str | None = None  # in the shared store; answers are kept there as they come, a folder for each stage


@dataclass(frozen=True)
class TriageRun:
    """Records of the messages that were still to do, and what is worth storing for the next run."""

    records: DataFrame
    predictions: DataFrame
    verdicts: DataFrame


def answers_to(requests: DataFrame, key: str, factory: Factory, log_dir: str | None, stage: str, request: Column | None = None) -> DataFrame:
    """(key, raw, error), written down before anything else reads it, since answers cost calls.

    ``request`` is made of the other columns where it is sent.  With ``log_dir`` answers are also logged while the
    stage runs; ``key`` has to name a request's whole content then.
    """
    derive = None if request is None else {"request": request}
    if log_dir is None:
        return cut_lineage(score_batch(requests, key, factory, derive=derive))
    requests = cut_lineage(requests)
    return cut_lineage(score_batch(requests, key, factory, derive=derive, log=AnswerLog.open(f"{log_dir}/{stage}", requests.count())))


def request_key(request: Column, *own: Column) -> Column:
    """Names a request's content and ``own`` columns: equal ones are sent once, and a changed one is sent anew."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in own], F.sha2(F.to_json(request), 256))


def classify_misses(messages: DataFrame, stored: DataFrame, scorers: Scorers, taxonomy: Sequence[str], fallback: str) -> tuple[DataFrame, DataFrame]:
    """(messages with ``predicted_intent`` and ``intent_confidence``, fresh predictions).

    Stored predictions are used as they are; the rest is asked, equal texts once.  Messages without usable text are not asked and have no intent.
    """
    known = with_cached_intent(messages, stored)
    wanted = F.col("known_intent").isNull() & F.coalesce(~r.is_degenerate(F.col("customer_text")), F.lit(False))
    def request(text: str) -> Column:
        return fewshot_messages(F.col(text), scorers.instructions, scorers.examples)

    # Only rows that are asked meet the answers; all others, null texts among them, go past the join.
    asked = known.filter(wanted).withColumn("text_key", request_key(request("customer_text")))
    requests = asked.select("text_key", F.col("customer_text").alias("text"))
    scored = answers_to(requests, "text_key", scorers.classify, scorers.log_dir, "classify", request("text"))
    answers = scored.select("text_key", parse_intent(F.col("raw"), taxonomy, fallback).alias("p"), F.col("raw").isNotNull().alias("answered"))
    intent, confidence = F.col("p.intent").alias("predicted_intent"), F.col("p.confidence").alias("intent_confidence")
    joined = asked.join(answers, "text_key", "left").select(*messages.columns, intent, confidence, "answered")
    others = known.filter(~wanted).select(*messages.columns, F.col("known_intent").alias("predicted_intent"),
                                          F.col("known_confidence").alias("intent_confidence"))
    fresh = joined.filter(F.coalesce("answered", F.lit(False))).select("id", "predicted_intent", F.col("intent_confidence").alias("confidence"))
    return joined.drop("answered").unionByName(others), fresh


def triage_run(messages: DataFrame, corpus: DataFrame, s: TriageSettings, scorers: Scorers, predictions: DataFrame, verdict_cache: DataFrame,
               drafts: DataFrame | None = None, done: DataFrame | None = None, fallback: str = d.FALLBACK_INTENT) -> TriageRun:
    """Triage of the messages whose id is not in ``done``: intents, gates, search, verdicts, decision, reply.

    ``messages``: id, customer_text, embedding (and columns to carry along).  Stored predictions, verdicts and
    drafts are used first; scorers are asked for the rest.  A draft that is missing or blank falls back to the template of its row.
    Every stage that calls a scorer, and the input of the next one, is checkpointed once.
    """
    todo = messages if done is None else still_to_do(messages, done, "id")
    classified, fresh = classify_misses(todo, predictions, scorers, s.taxonomy, fallback)
    prepared = cut_lineage(prepare(classified, corpus, s))
    columns = ["verdict_key", "resolves_problem", "reason"]
    verdicts, new = verdict_cache.select(*columns), verdict_cache.select(*columns).limit(0)
    if scorers.verify is not None:
        asked = verdict_requests(prepared, verdict_cache)
        request = verifier_request(F.col("customer_text"), F.col("procedure"))
        answers = verdicts_from_scores(answers_to(asked, "verdict_key", scorers.verify, scorers.log_dir, "verify", request))
        verdicts, new = verdicts.unionByName(answers.select(*columns)), answers.filter("cacheable").select(*columns)
    records = finish(prepared, verdicts, s, drafts)
    if scorers.draft is not None:
        records = _drafted(cut_lineage(records), scorers.draft, scorers.log_dir)
    return TriageRun(records, fresh, new)


def _drafted(records: DataFrame, factory: Factory, log_dir: str | None = None) -> DataFrame:
    """Generated replies in place of templates; reused drafts and messages without usable text keep theirs."""
    wants = ~F.coalesce("reused", F.lit(False)) & F.coalesce(F.col("gate_triggered") != "degenerate_input", F.lit(True))
    request = draft_request(F.col("customer_text"), F.col("decision"), F.array_join("evidence_used", "\n"))
    keyed = records.filter(wants).withColumn("_key", request_key(request, F.col("id")))
    asked = keyed.select("_key", "id", "customer_text", "decision", "evidence_used")
    answers = answers_to(asked, "_key", factory, log_dir, "draft", request).select("_key", F.col("raw").alias("_raw"))
    blank = F.trim(F.coalesce("_raw", F.lit(""))) == ""
    reply = F.when(blank, F.col("drafted_reply")).otherwise(r.clean_draft(F.col("_raw"), F.col("decision")))
    written = keyed.join(answers, "_key", "left").withColumn("drafted_reply", reply).drop("_raw", "_key")
    return written.unionByName(records.filter(~wants))


def store_vectors(spark: SparkSession, path: str, corpus: Callable[[], DataFrame], id_col: str = "tweet_id", text_col: str = "clean_text",
                  scope: str = "silver_intent", encode: Callable[[DataFrame, str, str], DataFrame] = hashed_vectors) -> DataFrame:
    """(id, text and other columns, embedding) of a corpus, built once and read from ``path`` afterwards."""
    def build() -> DataFrame:
        rows = corpus()
        return rows.join(encode(rows, id_col, text_col), id_col)

    return read_or_build(spark, path, build, [scope])


def search_texts(queries: DataFrame, index: DataFrame, k: int = 1, *, id_col: str = "id", text_col: str = "text", index_id: str = "tweet_id",
                 scopes: Column | None = None, scope: str | None = None, taxonomy: Sequence[str] = (),
                 encode: Callable[[DataFrame, str, str], DataFrame] = hashed_vectors) -> DataFrame:
    """The ``k`` nearest rows of a stored index for every text; texts without a word have none.

    With ``scope``, the column by which ``store_vectors`` partitioned the index, only folders that some text searches are read.
    """
    asked = queries.join(encode(queries, id_col, text_col), id_col)
    asked = cut_lineage(asked.select(id_col, "embedding", (scopes if scopes is not None else F.array().cast("array<string>")).alias("_scopes")))
    return knn(asked, index, k, scopes=F.col("_scopes"), corpus_scope=F.col(scope) if scope else None, taxonomy=taxonomy, query_id=id_col, corpus_id=index_id,
               prune=scope is not None)


def judge_run(audit: DataFrame, factory: Factory, model: str, cached: DataFrame | None = None, max_chars: int = d.MAX_REPLY_CHARS,
              log_dir: str | None = None) -> DataFrame:
    """Judgements of an audit: id, scores, decision and notes after the guardrails, char_count, has_synthetic_url, judge_model.

    ``audit``: id, customer_text, drafted_reply, evidence_used (text).  ``cached`` judgements are taken whole if
    they are valid for this audit and model, and otherwise all rows are judged anew, repeated ones by one call.
    Rows with a null id are judged like all others.  Answers are logged in a folder of the model below ``log_dir``.
    """
    if cached is not None and cache_valid(cached, audit, model).first()["valid"]:
        return cached
    keyed = audit.withColumn("_key", request_key(judge_request(F.col("customer_text"), F.col("drafted_reply"), F.col("evidence_used")), F.col("id")))
    requests = keyed.select("_key", "id", F.col("drafted_reply").alias("text"), "customer_text", "evidence_used")
    request = judge_request(F.col("customer_text"), F.col("text"), F.col("evidence_used"))
    stage = "judge-" + re.sub(r"[^A-Za-z0-9.-]", "_", model)
    answers = answers_to(requests, "_key", factory, log_dir, stage, request).select("_key", parse_judge(F.col("raw")).alias("judged"))
    rows = keyed.join(answers, "_key").select(
        "id", F.length("drafted_reply").alias("char_count"), r.synthetic_url(F.col("drafted_reply"), F.col("evidence_used")).alias("has_synthetic_url"), "judged")
    final = rows.withColumn("f", judge_guardrails(F.col("judged"), F.col("has_synthetic_url"), F.col("char_count"), max_chars))
    return final.select("id", "f.*", "char_count", "has_synthetic_url", F.lit(model).alias("judge_model"))


def judged_audit(audit: DataFrame, human: DataFrame, factory: Factory, model: str, cached: DataFrame | None = None,
                 max_chars: int = d.MAX_REPLY_CHARS, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Human ratings beside the judge's, ready for the validation report."""
    return merge_ratings(human, judge_run(audit, factory, model, cached, max_chars), keys)
