"""Metrics replayed on published counts and on edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deskweave.functions import defaults as d
from deskweave.operators import agreement as a
from deskweave.operators import metrics as m
from deskweave.plans.baselines import baselines_report
from deskweave.plans.reports import evaluation_report, judge_validation_report

P, A, B, T, D = d.INTENTS
# Confusion counts of the published classifier run.
CONFUSION = {(P, P): 35, (P, T): 10, (P, D): 5, (P, B): 2, (A, A): 26, (A, T): 1, (B, B): 21, (B, A): 2, (T, T): 14, (T, D): 1, (D, D): 13, (D, A): 1, (D, T): 1}
PER_CLASS = {P: (1.0, 0.6731, 0.8046, 52), A: (0.8966, 0.9630, 0.9286, 27), B: (0.9130, 0.9130, 0.9130, 23), T: (0.5385, 0.9333, 0.6829, 15), D: (0.6842, 0.8667, 0.7647, 15)}


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(g, p) for (g, p), n in CONFUSION.items() for _ in range(n)]
    return spark.createDataFrame(rows, "gold_intent string, predicted_intent string")


def test_classification_replay(classified):
    row = m.accuracy(classified).collect()[0]
    assert (row.correct, row.total) == (109, 132)
    f1 = m.f1_summary(classified).collect()[0]
    assert (f1.macro_f1, f1.weighted_f1) == (0.818769, 0.830492)
    got = {r.label: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), r.support) for r in m.per_class_prf(classified, d.INTENTS).collect()}
    assert got == PER_CLASS
    matrix = {r.gold_intent: r for r in m.confusion_matrix(classified, d.INTENTS).collect()}
    assert all(matrix[g][p] == CONFUSION.get((g, p), 0) for g in d.INTENTS for p in d.INTENTS)


def test_invalid_label_adds_a_zero_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "zz"), ("b", "b")], "gold_intent string, predicted_intent string")
    out = m.f1_summary(rows).collect()[0]
    assert out.n_labels == 3 and out.macro_f1 == round((1 + 2 / 3 + 0) / 3, 6) and out.weighted_f1 == round((1 + 2 * 2 / 3) / 3, 6)
    absent = {r.label: (r.f1, r.support) for r in m.per_class_prf(rows, ["a", "never"]).collect()}
    assert absent == {"a": (1.0, 1), "never": (0.0, 0)}


@pytest.fixture(scope="module")
def routed(spark):
    """38 rows with the published totals: FAH 1/18, FE 10/20."""
    rows = [("escalate", "auto_handle")] + [("escalate", "escalate")] * 17 + [("auto_handle", "escalate")] * 10 + [("auto_handle", "auto_handle")] * 10
    return spark.createDataFrame([(g, x, "easy" if i % 3 == 0 else "hard") for i, (g, x) in enumerate(rows)],
                                 "gold_decision string, decision string, difficulty_tier string")


def test_routing_replay(routed):
    r = m.escalation_metrics(routed).collect()[0]
    assert (r.correct, r.total, r.fah_count, r.fah_total, r.fe_count, r.fe_total, r.cost) == (27, 38, 1, 18, 10, 20, 14.0)
    rolled = {x.difficulty_tier: x for x in m.escalation_rollup(routed).collect()}
    assert set(rolled) == {"easy", "hard", "overall"} and rolled["overall"].cost == 14.0
    assert rolled["easy"].total + rolled["hard"].total == 38


def test_empty_denominators(spark):
    rows = spark.createDataFrame([("auto_handle", "auto_handle", "easy")], "gold_decision string, decision string, difficulty_tier string")
    r = m.escalation_metrics(rows).collect()[0]
    assert (r.fah_rate, r.fe_rate, r.accuracy) == (0.0, 0.0, 1.0)
    assert m.escalation_metrics(rows.filter("false")).collect()[0].accuracy == 0.0


def test_sweep_and_grid_against_loops(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, math.nan, 0.3, rng.random()]), rng.random() < 0.2, rng.choice(["escalate", "auto_handle"]), rng.choice(["easy", "hard"]),
             rng.choice([None, True, False]), rng.choice(["calibration", "held_out"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, similarity double, gated boolean, gold_decision string, difficulty_tier string, resolves boolean, split string")
    taus = [0.5, 0.2, 0.3]

    def over(s, tau):
        return s is not None and not math.isnan(s) and s >= tau

    sweep = {r.tau: r for r in m.threshold_sweep(frame, taus).collect()}
    for tau in taus:
        auto = [not g and over(s, tau) for _, s, g, *_ in rows]
        assert sweep[tau].fah_count == sum(x and r[3] == "escalate" for x, r in zip(auto, rows))
        assert sweep[tau].fe_count == sum(not x and r[3] == "auto_handle" for x, r in zip(auto, rows))
        easy = [(x == (r[3] == "auto_handle")) for x, r in zip(auto, rows) if r[4] == "easy"]
        assert sweep[tau].accuracy_easy == round(sum(easy) / len(easy), 6)
    chosen = m.select_threshold(m.threshold_sweep(frame, taus), sweep[0.3].fah_rate).collect()[0]
    assert chosen.tau == min(t for t in taus if sweep[t].fah_rate <= sweep[0.3].fah_rate)

    lows, highs = [0.2, 0.4], [0.3, 0.6]
    grid = {(r.split, r.tau_low, r.tau_high): r for r in m.two_threshold_grid(frame, lows, highs).collect()}
    assert len(grid) == 6
    for (part, lo, hi), r in grid.items():
        picked = [x for x in rows if x[6] == part]
        auto = [not g and over(s, lo) and v is not False and (over(s, hi) or v is True) for _, s, g, _, _, v, _ in picked]
        assert r.fah_count == sum(x and p[3] == "escalate" for x, p in zip(auto, picked))
    best = m.select_pair(m.two_threshold_grid(frame, lows, highs)).collect()[0]
    assert best.calibration_cost == min(r.cost for key, r in grid.items() if key[0] == "calibration")


def test_kappa_replay(spark):
    pairs = [("pass", "pass")] * 35 + [("pass", "fail")] * 7 + [("fail", "pass")] * 3 + [("fail", "fail")] * 5
    rows = spark.createDataFrame([(h, j, "easy" if i % 5 < 2 else "hard") for i, (h, j) in enumerate(pairs)], "human_decision string, judge_decision string, difficulty_tier string")
    r = {x.difficulty_tier: x for x in a.kappa_with_ci(rows).collect()}["overall"]
    assert (round(r.kappa, 3), round(r.standard_error, 3), round(r.ci_low, 3), round(r.ci_high, 3)) == (0.381, 0.175, 0.038, 0.724)
    same = rows.filter("human_decision = judge_decision AND human_decision = 'pass'")
    assert {(x.kappa, x.standard_error) for x in a.kappa_with_ci(same).collect()} == {(0.0, 0.0)}
    agree = {x.difficulty_tier: x for x in a.agreement(rows).collect()}["overall"]
    assert (agree.n, agree.agreed, agree.agreement_rate, agree.discordant) == (50, 40, 0.8, 10)


def test_spearman(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 5]), rng.random(), 3) for _ in range(300)]
    frame = spark.createDataFrame(rows, "x int, y double, c int")

    def ranks(values):
        order = sorted(values)
        return [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values]

    rx, ry = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    mean = (len(rows) + 1) / 2
    cov = sum((p - mean) * (q - mean) for p, q in zip(rx, ry))
    rho = cov / math.sqrt(sum((p - mean) ** 2 for p in rx) * sum((q - mean) ** 2 for q in ry))
    got = {r.metric: (r.n, r.spearman) for r in a.spearman(frame, [("xy", "x", "y"), ("xc", "x", "c")]).collect()}
    assert got == {"xy": (300, pytest.approx(rho, abs=1e-6)), "xc": (300, 0.0)}


def test_evaluation_report_matches_single_metrics(spark):
    rng = random.Random(9)
    labels = ["a", "b", "c"]
    rows = [(i, rng.choice([*labels, "other"]), rng.choice([*labels, "zz"]), rng.choice(["easy", "hard"]), rng.choice(["calibration", "held_out"]),
             rng.choice(["escalate", "auto_handle"]), rng.choice(["escalate", "auto_handle"]), rng.choice([None, "g1"]), rng.choice(["none", "curated_sop"]), rng.random())
            for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, gold_intent string, predicted_intent string, difficulty_tier string, split string, gold_decision string, decision string, "
                                        "gate_triggered string, grounding_source string, calibrated_confidence double")
    got = {(r.section, r.metric): r.value for r in evaluation_report(frame, labels).collect()}
    known = frame.filter(F.col("gold_intent").isin(*labels))
    f1, acc = m.f1_summary(known).collect()[0], m.accuracy(known).collect()[0]
    assert got["classification", "macro_f1"] == f1.macro_f1 and got["classification", "weighted_f1"] == f1.weighted_f1
    assert got["classification", "accuracy"] == acc.accuracy and ("intent/zz", "f1") not in got
    for r in m.per_class_prf(known, labels).collect():
        assert (got[f"intent/{r.label}", "precision"], got[f"intent/{r.label}", "f1"], got[f"intent/{r.label}", "support"]) == (r.precision, r.f1, r.support)
    for r in m.escalation_metrics(frame, by=["split", "difficulty_tier"]).collect():
        assert got[f"routing/{r.split}/{r.difficulty_tier}", "cost"] == r.cost
    conf = m.mean_confidence(frame).collect()[0]
    assert got["confidence", "mean_auto_handle"] == pytest.approx(conf.mean_auto_handle, abs=1e-9)
    assert got["gate_triggered", "g1"] == sum(r[7] == "g1" for r in rows)
    # A label and a decision without a row are zeros, and leave the averages as they are.
    half = {(r.section, r.metric): r.value for r in evaluation_report(frame.filter("decision = 'escalate'"), [*labels, "never"]).collect()}
    assert half["confidence", "mean_auto_handle"] == 0.0
    assert [half["intent/never", x] for x in ("precision", "recall", "f1", "support")] == [0.0] * 4
    assert half["classification", "macro_f1"] == m.f1_summary(known.filter("decision = 'escalate'")).first().macro_f1


def test_fe_attribution_is_exclusive(spark):
    rows = [("layer_1_hard_gate", "a", "b"), ("layer_2_resolution_check_veto", "a", "b"), ("layer_2_calibrated_confidence", "a", "b"), ("layer_2_calibrated_confidence", "a", "a")]
    frame = spark.createDataFrame([("auto_handle", "escalate", *r) for r in rows], "gold_decision string, decision string, decision_layer string, gold_intent string, predicted_intent string")
    out = {r.cause: (r.n, r.share) for r in m.fe_attribution(frame).collect()}
    assert out == {c: (1, 0.25) for c in ("gate_misfire", "verifier_veto", "wrong_intent", "similarity_dead_zone")}


def test_judge_report(spark):
    human = spark.createDataFrame([(i, "easy", 1 + i % 5, "pass" if i % 5 > 2 else "fail") for i in range(20)], "id long, difficulty_tier string, h int, human_decision string")
    judge = spark.createDataFrame([(i, "easy", 1 + i % 5, "pass" if i % 5 > 2 else "fail") for i in range(20)], "id long, difficulty_tier string, j int, judge_decision string")
    got = {(r.section, r.metric): r.value for r in judge_validation_report(human, judge, [("score", "h", "j")]).collect()}
    assert got["overall", "kappa"] == 1.0 and got["overall", "score_spearman"] == 1.0 and got["overall", "score_mae"] == 0.0


def test_baselines_report(spark):
    words = {"a": "song skip album", "b": "login password account"}
    rng = random.Random(3)

    def text(label):
        return " ".join(rng.choices(words[label].split(), k=6))

    golden = spark.createDataFrame([(i, text(x), x, rng.choice(["escalate", "auto_handle"]), "easy") for i in range(40) for x in [rng.choice("ab")]],
                                   "id long, text string, gold_intent string, gold_decision string, difficulty_tier string")
    past = spark.createDataFrame([(100 + i, text(x), x) for i in range(40) for x in [rng.choice("ab")]], "id long, text string, silver_intent string")
    got = {(r.baseline, r.metric): r.value for r in baselines_report(golden, past, past.withColumnRenamed("silver_intent", "label"), (), ["a", "b"], (0.2, 0.5), 50).collect()}
    assert got["classifier", "accuracy"] == 1.0 and got["classifier", "macro_f1"] == 1.0 and got["retrieval@0.2", "intent_match"] == 1.0
    assert got["constant", "majority_accuracy"] >= 0.5 and got["retrieval@0.5", "total"] == 40.0


def test_split_report_counts_a_reference_policy(spark):
    rows = [("escalate", "auto_handle", 0.9, "held_out"), ("auto_handle", "escalate", 0.9, "calibration"), ("auto_handle", "auto_handle", 0.1, "held_out")]
    frame = spark.createDataFrame(rows, "gold_decision string, decision string, s double, split string")
    policy = F.when(F.col("s") > 0.5, "auto_handle").otherwise("escalate")
    got = {r["split"]: (r.correct, r.fah_count, r.fe_count) for r in m.split_report(frame, policies={"simple": policy}).collect()}
    assert got["simple"] == (1, 1, 1) and got["always_escalate"] == (1, 0, 2) and got["full_set"] == (1, 1, 1)
