"""Answers that are kept while a stage runs: lost tasks, runs started again, and a log with damage."""

from __future__ import annotations

import os
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskweave.operators.scoring import score_batch
from deskweave.plans.runs import judge_run
from deskweave.sources.answers import AnswerLog


def counted(calls, dies_after=None):
    """Upper case; every key asked is noted, and the worker dies without a word when it has answered so many."""
    def factory():
        answered = 0

        def score(batch):
            nonlocal answered
            if dies_after is not None and answered >= dies_after:
                os._exit(1)
            with open(calls, "a") as f:
                f.writelines(f"{k}\n" for k in batch["k"])
            answered += len(batch)
            return batch["t"].str.upper()
        return score
    return factory


def asked(calls):
    return Counter(open(calls).read().split()) if os.path.exists(calls) else Counter()


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(400)], "k string, t string").coalesce(1)


def test_a_lost_task_repeats_only_what_was_not_logged(spark, tmp_path, requests):
    calls, log = str(tmp_path / "calls"), AnswerLog(str(tmp_path / "log"), 1)
    with pytest.raises(Exception, match="(?i)worker|exit|abort"):
        score_batch(requests, "k", counted(calls, dies_after=200), batch_size=10, log=log).collect()
    assert asked(calls).total() == 200
    out = score_batch(requests, "k", counted(calls), batch_size=10, log=log).collect()
    assert {r.k: r.raw for r in out} == {f"k{i}": f"TEXT {i}" for i in range(400)} and len(out) == 400
    assert set(asked(calls).values()) == {1} and asked(calls).total() == 400
    score_batch(requests, "k", counted(calls), log=log).collect()  # a run started again asks nothing
    assert asked(calls).total() == 400
    assert {(r.key, r.raw) for r in log.answers(spark).collect()} == {(f"k{i}", f"TEXT {i}") for i in range(400)}


def test_buckets_share_tasks_and_failures_are_asked_again(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), AnswerLog.open(f"file://{tmp_path}/log", 100)
    assert log.buckets == 64 and AnswerLog.open(f"file://{tmp_path}/log", 10**9) == log  # a log keeps its buckets

    def moody(ok):
        def factory():
            def score(batch):
                with open(calls, "a") as f:
                    f.writelines(f"{k}\n" for k in batch["k"])
                if not ok and (batch["k"] % 7 == 0).any():
                    raise RuntimeError("boom")
                return batch["t"].where(batch["k"] != 5)
            return score
        return factory

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "none"), (3, "t3")], "k long, t string")
    first = {r.k: (r.raw, r.error) for r in score_batch(rows, "k", moody(False), backoff_seconds=0, attempts=2, log=log, parallelism=3).collect()}
    assert first[7] == (None, "boom") and first[5] == (None, None) and first[8] == ("t8", None) and first[None] == ("none", None)
    before = asked(calls)
    again = {r.k: r.raw for r in score_batch(rows, "k", moody(True), backoff_seconds=0, attempts=1, log=log).collect()}
    assert again == {i: None if i == 5 else f"t{i}" for i in range(50)} | {None: "none"}
    new = {k for k, n in asked(calls).items() if n > before[k]}
    assert new == {*(str(i) for i in range(0, 50, 7)), "5", "nan"} or new == {*(str(float(i)) for i in range(0, 50, 7)), "5.0", "nan"}


def test_two_attempts_leave_one_answer_for_each_key(spark, tmp_path):
    log = AnswerLog(str(tmp_path / "log"), 1)
    log.append(0, ["a", "b"], ["1", "2"])
    log.append(0, ["b", "c"], ["other", "3"])
    log.append(0, [], [])
    known = log.read(0)
    assert set(known) == {"a", "b", "c"} and known["b"] in ("2", "other")
    assert {r.key: r.raw for r in log.answers(spark).collect()} == known


def test_damaged_and_unfinished_files_are_passed_over(spark, tmp_path, requests):
    calls, log = str(tmp_path / "calls"), AnswerLog(str(tmp_path / "log"), 1)
    log.append(0, ["k1"], ["stored"])
    folder = tmp_path / "log" / "bucket=0"
    (folder / "damaged.parquet").write_bytes(b"PAR1 not really")
    (folder / "_half").write_bytes(b"PAR1")
    out = {r.k: r.raw for r in score_batch(requests, "k", counted(calls), log=log).collect()}
    assert out["k1"] == "stored" and out["k2"] == "TEXT 2" and asked(calls).total() == 399


def test_no_requests_and_no_log(spark, tmp_path, requests):
    log = AnswerLog.open(str(tmp_path / "log"), 0)
    assert score_batch(requests.limit(0), "k", counted(str(tmp_path / "calls")), log=log).collect() == []
    assert log.answers(spark).collect() == [] and log.read(3) == {}


def test_an_audit_is_judged_once_even_with_null_ids(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        def score(batch):
            with open(calls, "a") as f:
                f.writelines("call\n" for _ in range(len(batch)))
            return pd.Series(['{"groundedness_score": 4, "tone_score": 5, "judge_decision": "pass", "judge_notes": "n"}'] * len(batch), index=batch.index)
        return score

    audit = spark.createDataFrame([("a", "q", "reply", "e"), (None, "q", "reply", "e"), (None, "other", "reply", "e"), ("b", None, None, None)],
                                  "id string, customer_text string, drafted_reply string, evidence_used string")
    for _ in range(2):
        judged = judge_run(audit, factory, "judge/1", log_dir=str(tmp_path / "runs")).collect()
        assert Counter(r.id for r in judged) == Counter(["a", None, None, "b"])
    assert asked(calls).total() == 4
    changed = audit.withColumn("customer_text", F.lit("new"))
    judge_run(changed, factory, "judge/1", log_dir=str(tmp_path / "runs")).collect()
    assert asked(calls).total() == 7  # of the two null ids with equal content now, one is sent


@pytest.mark.parametrize("logged", [False, True])
def test_back_off_is_not_paid_by_each_batch(spark, tmp_path, monkeypatch, logged):
    """A seventh of the rows never has an answer, another one only the second time; the task waits for them together."""
    requests = spark.range(420).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text")).coalesce(1)
    calls = str(tmp_path / "calls")

    def factory():
        seen = Counter()

        def score(batch):
            assert len(batch) <= 10 and [*batch.columns] == ["k", "text"]
            seen.update(batch["k"])
            with open(calls, "a") as f:
                f.write("".join(f"{k}\n" for k in batch["k"]))
            ready = (batch["k"] % 7 != 0) & ((batch["k"] % 7 != 1) | (batch["k"].map(seen) > 1))
            return batch["text"].where(ready, None)

        return score

    log = AnswerLog(str(tmp_path / "log"), 1) if logged else None
    begun = time.monotonic()
    out = score_batch(requests, "k", factory, backoff_seconds=0.2, batch_size=10, parallelism=1, log=log).collect()
    took = time.monotonic() - begun
    assert {r.k: (r.raw, r.error) for r in out} == {k: (f"t{k}" if k % 7 else None, None) for k in range(420)} and len(out) == 420
    assert asked(calls) == {str(k): 3 if k % 7 == 0 else 2 if k % 7 == 1 else 1 for k in range(420)}
    assert took < 42 * 0.6  # 0.2 and 0.4 seconds for each of 42 batches
    if logged:
        assert {r.key: r.raw for r in log.answers(spark).collect()} == {str(k): f"t{k}" for k in range(420) if k % 7}
