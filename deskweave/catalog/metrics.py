"""Metrics over the decided rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as a
from ..operators import metrics as m
from . import views as v
from .registry import query
from .text import SILVER, silver
from .views import PREDS, PREDS_CTES, rate, with_

RIGHT = "gold_intent = predicted_intent"
ROUTED = """count(*) AS total, count(*) FILTER (WHERE gold_decision = decision) AS correct,
  count(*) FILTER (WHERE gold_decision = 'escalate' AND decision = 'auto_handle') AS fah_count, count(*) FILTER (WHERE gold_decision = 'escalate') AS fah_total,
  count(*) FILTER (WHERE gold_decision = 'auto_handle' AND decision = 'escalate') AS fe_count, count(*) FILTER (WHERE gold_decision = 'auto_handle') AS fe_total"""
RATED = f"""total, correct, fah_count, fah_total, fe_count, fe_total, {rate('correct', 'total')} AS accuracy,
  {rate('fah_count', 'fah_total')} AS fah_rate, {rate('fe_count', 'fe_total')} AS fe_rate, 4.0::DOUBLE * fah_count + 1.0::DOUBLE * fe_count AS cost"""


@query("accuracy", PREDS + f"SELECT count(*) AS total, count(*) FILTER (WHERE {RIGHT}) AS correct, {rate(f'count(*) FILTER (WHERE {RIGHT})', 'count(*)')} AS accuracy FROM preds")
def _(t):
    return m.accuracy(v.preds(t))


@query("accuracy_by_tier", PREDS + f"SELECT difficulty_tier, count(*) AS total, count(*) FILTER (WHERE {RIGHT}) AS correct, {rate(f'count(*) FILTER (WHERE {RIGHT})', 'count(*)')} AS accuracy FROM preds GROUP BY 1")
def _(t):
    return m.accuracy_by_tier(v.preds(t))


# A label that never occurs has a row of zeros.
ALL_LABELS = (*v.LABELS, "never")


@query("confusion_matrix", PREDS + "SELECT l.gold_intent, " + ", ".join(f"count(*) FILTER (WHERE predicted_intent = '{x}') AS {x}" for x in ALL_LABELS)
       + f" FROM (SELECT unnest([{', '.join(v.lit(x) for x in ALL_LABELS)}]) AS gold_intent) l LEFT JOIN preds p ON p.gold_intent = l.gold_intent GROUP BY 1")
def _(t):
    return m.confusion_matrix(v.preds(t), ALL_LABELS)


CLASS_COUNTS = """class_counts AS (
  SELECT label, sum(tp)::BIGINT AS tp, sum(g)::BIGINT AS gold_n, sum(p)::BIGINT AS predicted_n FROM (
    SELECT gold_intent AS label, (gold_intent = predicted_intent)::INT AS tp, 1 AS g, 0 AS p FROM preds
    UNION ALL SELECT predicted_intent, 0, 0, 1 FROM preds) GROUP BY 1),
scores AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted_n, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(gold_n, 0), 0) AS recall,
  coalesce(2.0 * tp / nullif(gold_n + predicted_n, 0), 0)::DOUBLE AS f1 FROM class_counts)"""


@query("per_class_prf", with_(*PREDS_CTES, CLASS_COUNTS) + f"""SELECT l.label, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall,
  round(coalesce(f1, 0), 6) AS f1, coalesce(gold_n, 0) AS support, coalesce(tp, 0) AS correct
FROM (SELECT unnest([{', '.join(f"'{x}'" for x in v.TAXONOMY)}]) AS label) l LEFT JOIN scores s ON s.label = l.label""")
def _(t):
    return m.per_class_prf(v.preds(t), v.TAXONOMY)


@query("macro_weighted_f1", with_(*PREDS_CTES, CLASS_COUNTS) + "SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * gold_n) / sum(gold_n), 6) AS weighted_f1, count(*) AS n_labels FROM scores")
def _(t):
    return m.f1_summary(v.preds(t))


@query("escalation_metrics", PREDS + f"SELECT {RATED} FROM (SELECT {ROUTED} FROM preds)")
def _(t):
    return m.escalation_metrics(v.preds(t))


@query("asymmetric_cost", PREDS + f"SELECT fah_count, fe_count, 4.0::DOUBLE AS w_fah, 1.0::DOUBLE AS w_fe, 4.0::DOUBLE * fah_count + fe_count AS cost FROM (SELECT {ROUTED} FROM preds)")
def _(t):
    return m.asymmetric_cost(v.preds(t))


@query("escalation_rollup", PREDS + f"SELECT coalesce(difficulty_tier, 'overall') AS difficulty_tier, {RATED} FROM (SELECT difficulty_tier, {ROUTED} FROM preds GROUP BY GROUPING SETS ((), (difficulty_tier)))")
def _(t):
    return m.escalation_rollup(v.preds(t))


SPLIT_CTES = (*PREDS_CTES, v.split_sql("preds"))


@query("split_report", with_(*SPLIT_CTES, f"parts AS (SELECT split, {ROUTED} FROM split_rows GROUP BY 1 UNION ALL SELECT 'full_set', {ROUTED} FROM preds)") + f"""
SELECT split, {RATED} FROM (SELECT * FROM parts UNION ALL
  SELECT 'always_escalate', total, fah_total, 0, fah_total, fe_total, fe_total FROM parts WHERE split = 'full_set' UNION ALL
  SELECT 'one_threshold', {ROUTED} FROM (SELECT gold_decision, CASE WHEN NOT gated AND similarity >= 0.25 THEN 'auto_handle' ELSE 'escalate' END AS decision FROM preds))""")
def _(t):
    one = F.when(~F.col("gated") & (F.col("similarity") >= 0.25), F.lit("auto_handle")).otherwise("escalate")
    return m.split_report(v.split_preds(t), policies={"one_threshold": one})


@query("split_gap", with_(*SPLIT_CTES, f"parts AS (SELECT split, {RATED} FROM (SELECT split, {ROUTED} FROM split_rows GROUP BY 1))") + "SELECT "
       + ", ".join(f"round(max({c}) FILTER (WHERE split = 'held_out') - max({c}) FILTER (WHERE split = 'calibration'), 6) AS {c}_gap" for c in ("accuracy", "fah_rate", "fe_rate", "cost")) + " FROM parts")
def _(t):
    return m.split_gap(v.split_preds(t))


@query("baseline_trivial", with_(v.EVALF) + f"""SELECT (SELECT gold_intent FROM evalf WHERE gold_intent IN {v.IN_TAXONOMY} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS majority_intent,
  count(*) FILTER (WHERE gold_intent IN {v.IN_TAXONOMY}) AS in_taxonomy_n,
  {rate(f'(SELECT max(n) FROM (SELECT count(*) AS n FROM evalf WHERE gold_intent IN {v.IN_TAXONOMY} GROUP BY gold_intent))', f'count(*) FILTER (WHERE gold_intent IN {v.IN_TAXONOMY})')} AS majority_accuracy,
  count(*) AS total, {rate("count(*) FILTER (WHERE gold_decision = 'escalate')", 'count(*)')} AS escalate_accuracy,
  0::BIGINT AS fah_count, count(*) FILTER (WHERE gold_decision = 'auto_handle') AS fe_count FROM evalf""")
def _(t):
    return m.baseline_trivial(v.evalf(t), F.col("gold_intent").isin(*v.TAXONOMY))


def sweep_sql(source: str = "preds") -> str:
    tiers = ", ".join(
        f"{rate(f'''count(*) FILTER (WHERE difficulty_tier = '{x}' AND gold_decision = decision)''', f'''count(*) FILTER (WHERE difficulty_tier = '{x}')''')} AS accuracy_{x}"
        for x in ("easy", "hard"))
    return f"""sweep AS (SELECT tau, {RATED}, accuracy_easy, accuracy_hard FROM (SELECT tau, {ROUTED}, {tiers} FROM (
  SELECT p.* EXCLUDE (decision), x.tau, CASE WHEN NOT gated AND similarity >= x.tau THEN 'auto_handle' ELSE 'escalate' END AS decision
  FROM {source} p, (SELECT unnest({[float(x) for x in v.TAUS]}::DOUBLE[]) AS tau) x) GROUP BY 1))"""


@query("threshold_sweep", with_(*PREDS_CTES, sweep_sql()) + "SELECT * FROM sweep")
def _(t):
    return m.threshold_sweep(v.preds(t), v.TAUS)


@query("select_threshold", with_(*PREDS_CTES, sweep_sql()) + "SELECT min(tau) AS tau, arg_min(fah_rate, tau) AS fah_rate, arg_min(fe_rate, tau) AS fe_rate FROM sweep WHERE fah_rate <= 0.15")
def _(t):
    return m.select_threshold(m.threshold_sweep(v.preds(t), v.TAUS))


GRID = f"""grid AS (SELECT split, tau_low, tau_high, {RATED} FROM (SELECT split, tau_low, tau_high, {ROUTED} FROM (
  SELECT p.* EXCLUDE (decision), tau_low, tau_high,
    CASE WHEN NOT gated AND similarity >= tau_low AND coalesce(resolves, true) AND (similarity >= tau_high OR coalesce(resolves, false)) THEN 'auto_handle' ELSE 'escalate' END AS decision
  FROM split_rows p, (SELECT unnest({list(v.GRID_LOWS)}::DOUBLE[]) AS tau_low) a, (SELECT unnest({list(v.GRID_HIGHS)}::DOUBLE[]) AS tau_high) b
  WHERE tau_low <= tau_high) GROUP BY 1, 2, 3))"""


@query("two_threshold_grid", with_(*SPLIT_CTES, GRID) + """SELECT tau_low, tau_high, max(cost) FILTER (WHERE split = 'calibration') AS calibration_cost, max(cost) FILTER (WHERE split = 'held_out') AS held_out_cost,
  max(accuracy) FILTER (WHERE split = 'held_out') AS held_out_accuracy, max(fah_rate) FILTER (WHERE split = 'held_out') AS held_out_fah_rate,
  max(fe_rate) FILTER (WHERE split = 'held_out') AS held_out_fe_rate FROM grid GROUP BY 1, 2 ORDER BY calibration_cost, tau_low, tau_high LIMIT 1""")
def _(t):
    return m.select_pair(m.two_threshold_grid(v.split_preds(t), v.GRID_LOWS, v.GRID_HIGHS))


@query("two_threshold_surface", with_(*SPLIT_CTES, GRID) + "SELECT * FROM grid")
def _(t):
    return m.two_threshold_grid(v.split_preds(t), v.GRID_LOWS, v.GRID_HIGHS)


@query("value_counts", PREDS + """SELECT 'grounding_source' AS field, grounding_source AS value, count(*) AS n FROM preds GROUP BY 2
UNION ALL SELECT 'gate_triggered', gate_triggered, count(*) FROM preds WHERE gate_triggered IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gate_or_null', gate_triggered, count(*) FROM preds GROUP BY 2""")
def _(t):
    rows = v.preds(t).groupBy("grounding_source", "gate_triggered").agg(F.count(F.lit(1)).alias("k"))

    def part(field, column, drop):
        kept = rows.filter(F.col(column).isNotNull()) if drop else rows
        return kept.groupBy(F.col(column).alias("value")).agg(F.sum("k").alias("n")).select(F.lit(field).alias("field"), "value", "n")

    return part("grounding_source", "grounding_source", True).unionByName(part("gate_triggered", "gate_triggered", True)).unionByName(
        part("gate_or_null", "gate_triggered", False))


MEANS = ", ".join(f"""coalesce((sum(calibrated_confidence::DECIMAL(20,10)) FILTER (WHERE decision = '{x}'))::DOUBLE
  / nullif(count(*) FILTER (WHERE decision = '{x}'), 0), 0)::DOUBLE AS mean_{x}""" for x in ("auto_handle", "escalate"))


@query("mean_confidence", PREDS + f"SELECT {MEANS}, count(*) AS total FROM preds")
def _(t):
    return m.mean_confidence(v.preds(t))


@query("gate_precision", PREDS + f"""SELECT gate_triggered, count(*) AS fired, count(*) FILTER (WHERE gold_decision = 'escalate') AS "right",
  {rate("count(*) FILTER (WHERE gold_decision = 'escalate')", 'count(*)')} AS precision FROM preds WHERE gate_triggered IS NOT NULL GROUP BY 1""")
def _(t):
    return m.gate_precision(v.preds(t))


@query("fe_by_intent", PREDS + f"""SELECT gold_intent, count(*) AS handleable, count(*) FILTER (WHERE decision = 'escalate') AS fe_count,
  {rate("count(*) FILTER (WHERE decision = 'escalate')", 'count(*)')} AS fe_rate FROM preds WHERE gold_decision = 'auto_handle' GROUP BY 1""")
def _(t):
    return m.fe_by_intent(v.preds(t))


@query("fe_attribution", PREDS + f"""SELECT cause, count(*) AS n, {rate('count(*)', 'sum(count(*)) OVER ()')} AS share FROM (
  SELECT CASE WHEN decision_layer = 'layer_1_hard_gate' THEN 'gate_misfire' WHEN decision_layer = 'layer_2_resolution_check_veto' THEN 'verifier_veto'
    WHEN gold_intent <> predicted_intent THEN 'wrong_intent' ELSE 'similarity_dead_zone' END AS cause
  FROM preds WHERE gold_decision = 'auto_handle' AND decision = 'escalate') GROUP BY 1""")
def _(t):
    return m.fe_attribution(v.preds(t))


@query("bucket_distribution", with_(v.USERS, SILVER) + "SELECT coalesce(silver_intent, 'unclassified') AS bucket, count(*) AS n FROM silver GROUP BY 1")
def _(t):
    return silver(t).groupBy(F.coalesce("silver_intent", F.lit("unclassified")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("crosstab_report", with_(v.EVALF) + "SELECT coalesce(gold_intent, 'total') AS gold_intent, coalesce(gold_decision, 'total') AS gold_decision, count(*) AS n FROM evalf GROUP BY CUBE (gold_intent, gold_decision)")
def _(t):
    return m.crosstab(v.evalf(t), "gold_intent", "gold_decision")


# --- raters ---------------------------------------------------------------

SCORES = (("groundedness", "human_score", "judge_score"), ("tone", "human_tone", "judge_tone"))


@query("judge_merge", with_(v.RATINGS) + "SELECT * FROM ratings")
def _(t):
    return a.merge_ratings(*v.ratings(t))


def merged(t):
    return a.merge_ratings(*v.ratings(t))


AGREEMENT = f"""agreement AS (SELECT coalesce(difficulty_tier, 'overall') AS difficulty_tier, n, agreed, {rate('agreed', 'n')} AS agreement_rate, n - agreed AS discordant,
  {rate('gap_g', 'n')} AS groundedness_mae, {rate('gap_t', 'n')} AS tone_mae
FROM (SELECT difficulty_tier, count(*) AS n, count(*) FILTER (WHERE human_decision = judge_decision) AS agreed,
  sum(abs(human_score - judge_score)) AS gap_g, sum(abs(human_tone - judge_tone)) AS gap_t FROM ratings GROUP BY GROUPING SETS ((), (difficulty_tier))))"""


@query("agreement", with_(v.RATINGS, AGREEMENT) + "SELECT * FROM agreement")
def _(t):
    return a.agreement(merged(t), scores=SCORES)


@query("discordant_rows", with_(v.RATINGS) + "SELECT * FROM ratings WHERE human_decision <> judge_decision")
def _(t):
    return a.discordant(merged(t))


KAPPA = """kappa_in AS (SELECT difficulty_tier, count(*)::DOUBLE AS n, count(*) FILTER (WHERE human_decision = judge_decision) AS same,
  count(*) FILTER (WHERE human_decision = 'pass')::DOUBLE AS hp, count(*) FILTER (WHERE judge_decision = 'pass')::DOUBLE AS jp
  FROM ratings GROUP BY GROUPING SETS ((), (difficulty_tier))),
kappa_p AS (SELECT *, same / n AS po, (hp * jp + (n - hp) * (n - jp)) / (n * n) AS pe FROM kappa_in),
kappa_k AS (SELECT *, coalesce((po - pe) / nullif(1.0 - pe, 0), 0) AS k,
  CASE WHEN pe >= 1 OR po = 1 THEN 0 ELSE sqrt(po * (1.0 - po) / (n * (1.0 - pe) * (1.0 - pe))) END AS se FROM kappa_p),
kappa AS (SELECT coalesce(difficulty_tier, 'overall') AS difficulty_tier, n::BIGINT AS n, round(k, 6) AS kappa, round(se, 6) AS standard_error,
  round(greatest(-1.0::DOUBLE, k - 1.96 * se), 6) AS ci_low, round(least(1.0::DOUBLE, k + 1.96 * se), 6) AS ci_high FROM kappa_k)"""


@query("kappa_ci", with_(v.RATINGS, KAPPA) + "SELECT * FROM kappa")
def _(t):
    return a.kappa_with_ci(merged(t))


def rho_sql(name: str, x: str, y: str) -> str:
    return f"""SELECT '{name}' AS metric, count(*) AS n, round(coalesce(corr(rx, ry), 0), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM ratings)"""


@query("spearman", with_(v.RATINGS) + " UNION ALL ".join(rho_sql(*s) for s in SCORES))
def _(t):
    return a.spearman(merged(t), SCORES)
