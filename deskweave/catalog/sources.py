"""Scans, sinks and stored results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as m
from ..operators.scoring import cache_valid
from ..session import checkpoint_dir
from ..sources import tables as s
from ..sources.store import KeyedStore
from . import views as v
from .metrics import RATED, ROUTED
from .registry import query
from .views import PREDS, with_


def scratch(t) -> str:
    """A fresh folder in the folder that all executors share."""
    return os.path.join(checkpoint_dir(t.spark), "deskweave-" + uuid.uuid4().hex)


@query("scan_messages", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def _(t):
    return s.scan_messages(t.spark, f"{t.folder}/conversations.parquet", "parquet")


LABEL_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@query("scan_typed", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def _(t):
    return s.scan_typed(t.spark, f"{t.folder}/labels.parquet", LABEL_SCHEMA, "parquet")


@query("sink_table", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, text, role FROM conversations")
def _(t):
    """CSV round trip: line breaks and quotes inside the texts have to survive."""
    path = scratch(t)
    s.sink_table(t.conversations.withColumnRenamed("conv_id", " Conv ID"), path, "csv")
    return s.scan_messages(t.spark, path).select("conv_id", "turn", "text", "role")


@query("sanitize_newlines", "SELECT conv_id, turn, replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM conversations")
def _(t):
    return s.flatten_newlines(t.conversations.select("conv_id", "turn", "text"), ["text"])


@query("read_or_build", with_(v.CORPUS) + "SELECT vec_id, label::BIGINT AS label, silver_intent FROM corpus")
def _(t):
    """The second call finds the stored table and must not build again."""
    path = scratch(t)
    s.read_or_build(t.spark, path, lambda: v.corpus(t), ["silver_intent"])

    def must_not_run():
        raise RuntimeError("the stored corpus was not reused")

    return s.read_or_build(t.spark, path, must_not_run).select("vec_id", "label", "silver_intent")


@query("cache_valid", """SELECT case_name, cached_rows, (SELECT count(*) FROM labels) AS expected_rows, valid FROM (
  SELECT 'complete' AS case_name, count(*) AS cached_rows, count(*) > 0 AS valid FROM labels
  UNION ALL SELECT 'partial', count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 1) = count(*) FROM labels
  UNION ALL SELECT 'other_model', count(*), false FROM labels)""")
def _(t):
    complete = t.labels.withColumn("judge_model", F.lit("judge-a"))
    cases = {"complete": complete, "partial": complete.filter("quality = 1"), "other_model": complete.withColumn("judge_model", F.lit("judge-b"))}
    parts = [cache_valid(c, t.labels, "judge-a").withColumn("case_name", F.lit(name)) for name, c in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sink_json_report", PREDS + f"SELECT difficulty_tier, {RATED} FROM (SELECT difficulty_tier, {ROUTED} FROM preds GROUP BY 1)")
def _(t):
    path = scratch(t)
    report = m.escalation_metrics(v.preds(t), by=["difficulty_tier"])
    s.sink_json_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


VERDICT_SCHEMA = T.StructType([T.StructField("verdict_key", T.StringType()), T.StructField("resolves_problem", T.BooleanType())])


def verdict_rows(t):
    return t.documents.select(F.sha2("text", 256).alias("verdict_key"), (F.length("text") % 2 == 0).alias("resolves_problem"), "lang")


@query("verdict_cache_scan", "SELECT DISTINCT sha256(text) AS verdict_key, length(text) % 2 = 0 AS resolves_problem FROM documents")
def _(t):
    """A store holding some verdicts receives a full batch; only new keys are appended, and a compacted store takes more."""
    rows, store = verdict_rows(t), KeyedStore(t.spark, scratch(t), "verdict_key", VERDICT_SCHEMA)
    store.append(rows.filter("lang = 'en'"))
    store.append(rows.filter("lang IN ('en', 'de')"))
    store.compact()
    store.append(rows)
    return store.rows()


@query("verdict_store_join", """SELECT doc_id, lang, sha256(text) AS verdict_key, CASE WHEN bool_or(lang IN ('en', 'de')) OVER (PARTITION BY text) THEN length(text) % 2 = 0 END AS resolves_problem FROM documents""")
def _(t):
    """Documents meet a store whose English verdicts lie in buckets and whose German ones were appended since."""
    rows, store = verdict_rows(t), KeyedStore(t.spark, scratch(t), "verdict_key", VERDICT_SCHEMA)
    store.append(rows.filter("lang = 'en'"))
    store.compact()
    store.append(rows.filter("lang = 'de'"))
    return store.lookup(t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("verdict_key")))


@query("resume_batch", with_(v.EVALF) + "SELECT id, gold_intent, lang FROM evalf WHERE lang <> 'en'")
def _(t):
    """A batch that stopped after its English rows picks up the others."""
    rows = v.evalf(t).select("id", "gold_intent", "lang")
    path = scratch(t)
    s.sink_table(rows.filter("lang = 'en'").select("id"), path)
    return s.still_to_do(rows, t.spark.read.parquet(path), "id")
