"""Decision table, procedures, drafts and the full batch."""

import json
import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from deskweave.functions import defaults as d
from deskweave.functions.replies import template_draft, verdict_key
from deskweave.functions.rules import first_gate, gate_array
from deskweave.functions.sops import default_sops
from deskweave.operators import triage as g
from deskweave.operators.procedures import sop_match, sop_table
from deskweave.operators.scoring import score_batch, stored_verdicts
from deskweave.plans.runs import Scorers, triage_run
from deskweave.plans.triage import TriageSettings, triage_batch

GATE = "struct<rank: int, gate: string, reason: string>"


def decide_rows(spark, rows, low=0.65, high=0.73):
    frame = spark.createDataFrame([(i, (0, x[0], "why") if x[0] else None, *x[1:]) for i, x in enumerate(rows)],
                                  f"i int, gate {GATE}, s double, v boolean").orderBy("i")
    out = frame.select(g.decide(F.col("gate"), F.col("s"), F.col("v"), F.lit("note"), low, high).alias("r")).select("r.*").collect()
    return [(r.decision, r.decision_layer, r.gate_triggered, r.threshold_used) for r in out]


def test_decision_table(spark):
    calibrated, verified, veto = "layer_2_calibrated_confidence", "layer_2_resolution_check_verified", "layer_2_resolution_check_veto"
    rows = [("billing", 0.99, True), (None, 0.5, True), (None, None, True), (None, math.nan, True), (None, 0.65, False), (None, 0.9, False),
            (None, 0.9, None), (None, 0.73, True), (None, 0.7, True), (None, 0.7, None)]
    assert decide_rows(spark, rows) == [
        ("escalate", "layer_1_hard_gate", "billing", 0.65), ("escalate", calibrated, None, 0.65), ("escalate", calibrated, None, 0.65),
        ("escalate", calibrated, None, 0.65), ("escalate", veto, "resolution_check_veto", 0.65), ("escalate", veto, "resolution_check_veto", 0.65),
        ("auto_handle", calibrated, None, 0.73), ("auto_handle", calibrated, None, 0.73), ("auto_handle", verified, None, 0.65),
        ("escalate", calibrated, None, 0.73)]


def test_nan_never_auto_handles_with_zero_threshold(spark):
    assert decide_rows(spark, [(None, math.nan, True)], 0.0, 0.0)[0][0] == "escalate"


def test_adversarial_messages(spark):
    frame = spark.createDataFrame(list(d.ADVERSARIAL_MESSAGES), "m string, intent string, expected string")
    gate = first_gate(F.col("m"), d.GATES, F.col("intent"), d.OTHER, d.OUT_OF_TAXONOMY)
    out = frame.withColumn("gate", gate).withColumn("r", g.decide(F.col("gate"), F.lit(0.99), F.lit(True)))
    for row in out.select("expected", "r.*").collect():
        assert (row.decision, row.gate_triggered) == ("escalate", row.expected)


def test_gate_order_and_catch_all(spark):
    frame = spark.createDataFrame([("hacked and charged", "other"), ("hello", "other"), ("hello", None)], "m string, intent string")
    out = frame.select(
        first_gate(F.col("m"), d.GATES, F.col("intent"), d.OTHER, d.OUT_OF_TAXONOMY)["gate"].alias("g"),
        gate_array(F.col("m"), d.GATES, F.col("intent"), d.OTHER, d.OUT_OF_TAXONOMY)["gate"].alias("all")).collect()
    assert [(r.g, r.all) for r in out] == [
        ("billing_dispute", ["billing_dispute", "account_security", "out_of_taxonomy"]), ("out_of_taxonomy", ["out_of_taxonomy"]), (None, [])]


def test_procedures(spark):
    sops = default_sops("Acme")
    table = sop_table(spark, sops)
    assert {r[0]: r[1] for r in table.groupBy("intent").count().collect()} == {
        "playback_issue": 4, "app_technical": 4, "account_login": 3, "device_platform": 3, "premium_billing": 3}
    rows = [(0, "playback_issue", "It is BUFFERING"), (1, "playback_issue", "nothing"), (2, "playback_issue", None), (3, "other", "skip"),
            (4, "device_platform", "acme connect fails"), (5, "device_platform", "my tv and bluetooth"), (6, "account_login", "  ")]
    out = sop_match(spark.createDataFrame(rows, "i int, intent string, t string"), "intent", "t", sops).orderBy("i").select("sop.sop_id").collect()
    assert [r[0] for r in out] == ["PB_02_NETWORK_STREAMING", "PB_01_BASIC_REFRESH", "PB_01_BASIC_REFRESH", None,
                                   "DEV_01_POWER_CYCLE_CONNECT", "DEV_01_POWER_CYCLE_CONNECT", "AUTH_01_PASSWORD_RESET"]


def test_stored_verdicts(spark):
    req = spark.createDataFrame([(1, " a ", "p"), (2, "b", "p"), (3, "", "p"), (4, "a", None)], "id int, t string, p string")
    key = spark.createDataFrame([("a", "p ")], "t string, p string").select(
        verdict_key(F.col("t"), F.col("p")).alias("verdict_key"), F.lit(True).alias("resolves_problem"), F.lit(0.9).alias("confidence"), F.lit("r").alias("reason"))
    out = stored_verdicts(req, key, "t", "p").orderBy("id").collect()
    assert [(r.resolves_problem, r.verdict_confidence, r.verdict_known) for r in out] == [(True, 0.9, True), (None, None, False), (False, 1.0, True), (False, 1.0, True)]


def test_score_batch_retries_and_reports(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        def score(batch):
            with open(calls, "a") as f:
                f.write(f"{len(batch)}\n")
            if (batch["k"] == "bad").any():
                raise RuntimeError("boom")
            return batch["t"].str.upper()
        return score

    rows = [("x", "one")] * 50 + [("y", "two")]
    out = {r.k: (r.raw, r.error) for r in score_batch(spark.createDataFrame(rows, "k string, t string"), "k", factory, backoff_seconds=0).collect()}
    assert out == {"x": ("ONE", None), "y": ("TWO", None)}
    assert sum(int(n) for n in open(calls)) == 2  # copies are sent once
    failed = score_batch(spark.createDataFrame([("bad", "z")], "k string, t string"), "k", factory, attempts=3, backoff_seconds=0).collect()
    assert [(r.raw, r.error) for r in failed] == [(None, "boom")]


def test_one_poisoned_row_costs_no_other_its_answer(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        def score(batch):
            with open(calls, "a") as f:
                f.writelines(f"{k}\n" for k in batch["k"])
            if (batch["k"] == "bad").any():
                raise RuntimeError("boom")
            return batch["k"].where(batch["k"] != "mute").str.upper()
        return score

    rows = [(f"k{i}",) for i in range(100)] + [("bad",), ("mute",)]
    out = {r.k: (r.raw, r.error) for r in score_batch(spark.createDataFrame(rows, "k string").coalesce(1), "k", factory, backoff_seconds=0, batch_size=30).collect()}
    assert out.pop("bad") == (None, "boom") and out.pop("mute") == (None, None)
    assert out == {f"k{i}": (f"K{i}", None) for i in range(100)}
    sent = Counter(open(calls).read().split())
    assert all(sent[k] <= 2 for k in out)  # once more at most


def test_long_replies_stay_whole(spark):
    frame = spark.createDataFrame([("auto_handle", "a" * 700)], "decision string, reply string")
    sop = F.lit(None).cast("struct<name: string, steps: array<string>>")
    assert frame.select(template_draft(F.col("decision"), sop, F.lit(True), F.col("reply"))).first()[0] == "a" * 700


def settings(**kw):
    return TriageSettings(sops=default_sops("Acme"), **kw)


def triage_frames(spark):
    messages = spark.createDataFrame([
        ("m1", "music stops after a minute", "playback_issue", [1.0, 0.0]), ("m2", "@a", "playback_issue", [1.0, 0.0]),
        ("m3", "I want a refund", "premium_billing", [0.0, 1.0]), ("m4", "it lags so much", "playback_issue", [0.7, 0.714]),
        ("m5", "weird question", "other", [0.6, 0.8]), ("m6", "it never loads", "playback_issue", [0.7, 0.7141])],
        "id string, customer_text string, predicted_intent string, embedding array<double>")
    corpus = spark.createDataFrame([
        ("t1", [1.0, 0.0], "playback_issue", "Please restart the app and log out."), ("t2", [0.0, 1.0], "premium_billing", "We sent you a DM")],
        "vec_id string, embedding array<double>, silver_intent string, brand_reply_text string")
    empty = spark.createDataFrame([], "verdict_key string, resolves_problem boolean, reason string")
    return messages, corpus, empty


def test_triage_batch_with_verifier(spark):
    messages, corpus, empty = triage_frames(spark)

    def factory():
        return lambda batch: batch["customer_text"].map(lambda t: json.dumps({"resolves_problem": "lag" in t or "music" in t, "reason": "r"}))

    records, fresh = triage_batch(messages, corpus, settings(), empty, factory)
    out = {r.id: r for r in records.collect()}
    assert (out["m1"].decision, out["m1"].grounding_source) == ("auto_handle", "retrieved_case")
    assert out["m1"].evidence_used == ["Retrieved historical tweet t1: Please restart the app and log out...."]
    assert (out["m2"].decision, out["m2"].gate_triggered, out["m2"].calibrated_confidence, out["m2"].predicted_intent) == (
        "escalate", "degenerate_input", 0.0, "playback_issue")
    assert out["m3"].gate_triggered == "billing_dispute" and out["m5"].gate_triggered == "out_of_taxonomy"
    assert (out["m4"].decision, out["m4"].decision_layer) == ("auto_handle", "layer_2_resolution_check_verified")
    assert (out["m6"].decision, out["m6"].gate_triggered) == ("escalate", "resolution_check_veto")
    assert fresh.count() == 3  # only ungated messages above the lower threshold were asked


def test_triage_without_verifier_uses_one_threshold(spark):
    messages, corpus, empty = triage_frames(spark)
    records, _ = triage_batch(messages, corpus, settings(verify=False), empty)
    assert {r.id: r.decision for r in records.collect() if r.id in ("m1", "m4", "m6")} == {"m1": "auto_handle", "m4": "escalate", "m6": "escalate"}


def test_global_policy_searches_everything(spark):
    messages, corpus, empty = triage_frames(spark)
    records, _ = triage_batch(messages, corpus, settings(scoped=False), empty)
    assert {r.id: r.hit_id for r in records.collect() if r.id in ("m4", "m5")} == {"m4": "t2", "m5": "t2"}


def test_draft_reuse(spark):
    decided = spark.createDataFrame([(1, "escalate"), (2, "escalate"), (3, "auto_handle"), (4, "escalate")], "id int, decision string")
    drafts = spark.createDataFrame([(1, "escalate", "kept", None), (2, "auto_handle", "stale", "x"), (3, "auto_handle", None, "x")],
                                   "id int, cached_decision string, cached_reply string, cached_source string")
    out = g.reuse_drafts(decided, drafts).orderBy("id").collect()
    assert [(r.reused, r.drafted_reply, r.reply_source) for r in out] == [(True, "kept", "curated_sop"), (False, None, None), (False, None, None), (False, None, None)]


def test_cached_intents(spark):
    out = g.with_cached_intent(
        spark.createDataFrame([("a",), ("b",)], "id string"),
        spark.createDataFrame(pd.DataFrame({"id": ["a"], "predicted_intent": ["x"], "confidence": [float("nan")]})).replace(float("nan"), None)).orderBy("id").collect()
    assert [(r.known_intent, r.known_confidence) for r in out] == [("x", 1.0), (None, None)]


def test_a_run_classifies_verifies_drafts_and_resumes(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def noted(kind, answer):
        def factory():
            def score(batch):
                with open(calls, "a") as f:
                    f.writelines(f"{kind}\n" for _ in range(len(batch)))
                assert all(len(m) >= 2 for m in batch["request"])
                return pd.Series([answer] * len(batch), index=batch.index)
            return score
        return factory

    messages = spark.createDataFrame(
        [("m1", "my song stops every minute", [1.0, 0.0]), ("m2", "my song stops every minute", [1.0, 0.0]), ("m3", "@x", [1.0, 0.0]), ("m4", "stored one", [1.0, 0.0]), ("m5", "done before", [1.0, 0.0])],
        "id string, customer_text string, embedding array<double>")
    corpus = spark.createDataFrame([(i, [1.0, 0.0], "playback_issue", "Please restart the app and clear the cache, that helps") for i in range(3)],
                                   "vec_id long, embedding array<double>, silver_intent string, brand_reply_text string")
    stored = spark.createDataFrame([("m4", "account_login", 0.9)], "id string, predicted_intent string, confidence double")
    empty = spark.createDataFrame([], "verdict_key string, resolves_problem boolean, reason string")
    scorers = Scorers(noted("classify", '{"intent": "playback_issue", "confidence": "0.8"}'), noted("verify", '{"resolves_problem": "true"}'), noted("draft", ' "Hi" there '))
    run = triage_run(messages, corpus, settings(), scorers, stored, empty, done=spark.createDataFrame([("m5",)], "id string"))
    records = {r.id: r for r in run.records.collect()}
    assert set(records) == {"m1", "m2", "m3", "m4"} and records["m1"].predicted_intent == "playback_issue" and records["m4"].predicted_intent == "account_login"
    assert records["m3"].gate_triggered == "degenerate_input" and records["m3"].drafted_reply == d.FALLBACK_REPLY and records["m1"].drafted_reply == "Hi there"
    assert sorted((r.id, r.confidence) for r in run.predictions.collect()) == [("m1", 0.8), ("m2", 0.8)]
    sent = Counter(open(calls).read().split())
    assert sent["classify"] == 1 and sent["draft"] == 3 and sent["verify"] == run.verdicts.count() <= 2  # equal texts are asked once, nothing twice
