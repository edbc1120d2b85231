"""Evaluation metrics.

Predictions are first counted per combination of the labels that matter; the
label sets are small, so everything after that first map-side-combined
aggregation works on a handful of rows however large the input is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import defaults as d

DECIMALS = 6


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), DECIMALS)


def accuracy(df: DataFrame, gold: str = "gold_intent", predicted: str = "predicted_intent") -> DataFrame:
    right = F.count_if(F.col(gold) == F.col(predicted))
    return df.agg(F.count(F.lit(1)).alias("total"), right.alias("correct")).select(
        "total", "correct", rate(F.col("correct"), F.col("total")).alias("accuracy"))


def accuracy_by_tier(df: DataFrame, tier: str = "difficulty_tier", gold: str = "gold_intent",
                     predicted: str = "predicted_intent") -> DataFrame:
    return (
        df.groupBy(tier).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(gold) == F.col(predicted)).alias("correct"))
        .withColumn("accuracy", rate(F.col("correct"), F.col("total")))
    )


def confusion_matrix(df: DataFrame, labels: Sequence[str], gold: str = "gold_intent",
                     predicted: str = "predicted_intent") -> DataFrame:
    """One row per label of the list, seen or not, and one count column per predicted label."""
    counted = df.filter(F.col(gold).isin(*labels)).groupBy(gold).agg(
        *[F.count_if(F.col(predicted) == name).alias(name) for name in labels])
    every = df.sparkSession.createDataFrame([(name,) for name in labels], f"{gold} string")
    return every.join(counted, gold, "left").na.fill(0)


def class_counts(df: DataFrame, gold: str = "gold_intent", predicted: str = "predicted_intent") -> DataFrame:
    """(label, tp, gold_n, predicted_n) over every label seen on either side."""
    cells = df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
    same = F.col(gold) == F.col(predicted)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(gold).alias("label"), F.when(same, F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("gold_n"), zero.alias("predicted_n")),
        F.struct(F.col(predicted).alias("label"), zero.alias("tp"), zero.alias("gold_n"), F.col("n").alias("predicted_n")))
    return (
        cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "gold_n", "predicted_n")])
    )


def prf(tp: Column, gold_n: Column, predicted_n: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    def plain(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return plain(tp, predicted_n), plain(tp, gold_n), plain(tp * 2, gold_n + predicted_n)


def per_class_prf(df: DataFrame, labels: Sequence[str], gold: str = "gold_intent",
                  predicted: str = "predicted_intent") -> DataFrame:
    """Precision, recall, F1, support and hits for each of the fixed ``labels``."""
    counted = class_counts(df, gold, predicted).filter(F.col("label").isin(*labels))
    # The label list on the left keeps labels that never occur.
    every = df.sparkSession.createDataFrame([(name,) for name in labels], "label string")
    full = every.join(counted, "label", "left").na.fill(0)
    precision, recall, f1 = prf(F.col("tp"), F.col("gold_n"), F.col("predicted_n"))
    return full.select(
        "label", F.round(precision, DECIMALS).alias("precision"), F.round(recall, DECIMALS).alias("recall"),
        F.round(f1, DECIMALS).alias("f1"), F.col("gold_n").alias("support"), F.col("tp").alias("correct"))


def f1_summary(df: DataFrame, gold: str = "gold_intent", predicted: str = "predicted_intent") -> DataFrame:
    """Macro F1 over the labels seen on either side; weighted F1 by gold support."""
    f1 = prf(F.col("tp"), F.col("gold_n"), F.col("predicted_n"))[2]
    return class_counts(df, gold, predicted).withColumn("f1", f1).agg(
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), DECIMALS).alias("macro_f1"),
        rate(F.sum(F.col("f1") * F.col("gold_n")), F.sum("gold_n")).alias("weighted_f1"),
        F.count(F.lit(1)).alias("n_labels"))


# --- routing metrics -------------------------------------------------------

COUNTS = ("total", "correct", "fah_count", "fah_total", "fe_count", "fe_total")


def routing_counts(gold: Column, decision: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates behind every routing metric; ``weight`` for pre-counted rows."""

    def count(condition: Column) -> Column:
        if weight is None:
            return F.count_if(condition)
        return F.sum(F.when(condition, weight).otherwise(F.lit(0).cast("long")))

    needs_human, safe = gold == d.ESCALATE, gold == d.AUTO_HANDLE
    return [
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("total"),
        count(gold == decision).alias("correct"),
        count(needs_human & (decision == d.AUTO_HANDLE)).alias("fah_count"),
        count(needs_human).alias("fah_total"),
        count(safe & (decision == d.ESCALATE)).alias("fe_count"),
        count(safe).alias("fe_total"),
    ]


def with_routing_rates(counted: DataFrame, w_fah: float = d.COST_FALSE_AUTO,
                       w_fe: float = d.COST_FALSE_ESCALATION) -> DataFrame:
    return (
        counted.withColumn("accuracy", rate(F.col("correct"), F.col("total")))
        .withColumn("fah_rate", rate(F.col("fah_count"), F.col("fah_total")))
        .withColumn("fe_rate", rate(F.col("fe_count"), F.col("fe_total")))
        .withColumn("cost", F.lit(float(w_fah)) * F.col("fah_count") + F.lit(float(w_fe)) * F.col("fe_count"))
    )


def escalation_metrics(df: DataFrame, by: Sequence[str] = (), gold: str = "gold_decision", decision: str = "decision",
                       w_fah: float = d.COST_FALSE_AUTO, w_fe: float = d.COST_FALSE_ESCALATION) -> DataFrame:
    """Accuracy, false auto-handles, false escalations and cost, overall or per group."""
    return with_routing_rates(df.groupBy(*by).agg(*routing_counts(F.col(gold), F.col(decision))), w_fah, w_fe)


def asymmetric_cost(df: DataFrame, w_fah: float = d.COST_FALSE_AUTO, w_fe: float = d.COST_FALSE_ESCALATION) -> DataFrame:
    return escalation_metrics(df, w_fah=w_fah, w_fe=w_fe).select(
        "fah_count", "fe_count", F.lit(float(w_fah)).alias("w_fah"), F.lit(float(w_fe)).alias("w_fe"), "cost")


def escalation_rollup(df: DataFrame, tier: str = "difficulty_tier", gold: str = "gold_decision",
                      decision: str = "decision") -> DataFrame:
    """Metrics per tier and, under the tier 'overall', for everything.

    Counts per tier first, then rolls those few rows up; rolling up the raw rows
    would copy each of them.
    """
    per_tier = df.groupBy(tier).agg(*routing_counts(F.col(gold), F.col(decision)))
    rolled = per_tier.rollup(tier).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping(tier).alias("_all"))
    named = rolled.withColumn(tier, F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(tier))).drop("_all")
    return with_routing_rates(named)


def split_report(df: DataFrame, split: str = "split", gold: str = "gold_decision", decision: str = "decision",
                 policies: Mapping[str, Column] | None = None) -> DataFrame:
    """Metrics per split, for the full set, and on it for a policy that always escalates and for ``policies``, by name their decision.

    A reference policy is thus counted on the rows at hand, in the same pass.
    """
    others = dict(policies or {})
    right = {name: (F.count_if(F.col(gold) == c), F.count_if((F.col(gold) == d.ESCALATE) & (c == d.AUTO_HANDLE)),
                    F.count_if((F.col(gold) == d.AUTO_HANDLE) & (c == d.ESCALATE))) for name, c in others.items()}
    own = [c.alias(f"_{i}_{name}") for name, cs in right.items() for i, c in enumerate(cs)]
    names = [*COUNTS, *[f"_{i}_{name}" for name in others for i in range(3)]]
    per_split = df.groupBy(split).agg(*routing_counts(F.col(gold), F.col(decision)), *own)
    full = per_split.rollup(split).agg(*[F.sum(c).alias(c) for c in names], F.grouping(split).alias("_all"))
    named = full.withColumn(split, F.when(F.col("_all") == 1, F.lit("full_set")).otherwise(F.col(split))).drop("_all")
    zero = F.lit(0).cast("long")

    def constant(name: str, correct: str, fah: Column, fe: Column) -> Column:
        return F.struct(F.lit(name).alias(split), F.col("total"), F.col(correct).alias("correct"),
                        fah.alias("fah_count"), F.col("fah_total"), fe.alias("fe_count"), F.col("fe_total"))

    same = F.struct(F.col(split).alias(split), *[F.col(c) for c in COUNTS])
    always = constant("always_escalate", "fah_total", zero, F.col("fe_total"))
    given = [constant(name, f"_0_{name}", F.col(f"_1_{name}"), F.col(f"_2_{name}")) for name in others]
    rows = F.when(F.col(split) == "full_set", F.array(same, always, *given)).otherwise(F.array(same))
    return with_routing_rates(named.select(F.explode(rows).alias("r")).select("r.*"))


def split_gap(df: DataFrame, split: str = "split", held_out: str = "held_out", calibration: str = "calibration") -> DataFrame:
    """Held-out minus calibration, per metric."""
    m = escalation_metrics(df, by=[split])

    def gap(name: str) -> Column:
        return F.round(F.max(F.when(F.col(split) == held_out, F.col(name)))
                       - F.max(F.when(F.col(split) == calibration, F.col(name))), DECIMALS).alias(f"{name}_gap")

    return m.agg(gap("accuracy"), gap("fah_rate"), gap("fe_rate"), gap("cost"))


def baseline_trivial(df: DataFrame, in_taxonomy: Column, gold_intent: str = "gold_intent",
                     gold_decision: str = "gold_decision") -> DataFrame:
    """Majority-intent accuracy and the always-escalate policy."""
    cells = df.groupBy(gold_intent, gold_decision).agg(F.count(F.lit(1)).alias("n"), F.count_if(in_taxonomy).alias("n_tax"))
    per_intent = cells.groupBy(gold_intent).agg(
        F.sum("n_tax").alias("n_tax"), F.sum("n").alias("n"),
        F.sum(F.when(F.col(gold_decision) == d.ESCALATE, F.col("n")).otherwise(0)).alias("esc"))
    best = per_intent.agg(
        F.min(F.struct((-F.col("n_tax")).alias("neg"), F.col(gold_intent).alias("intent"))).alias("top"),
        F.sum("n_tax").alias("in_taxonomy_n"), F.sum("n").alias("total"), F.sum("esc").alias("esc"))
    return best.select(
        F.col("top.intent").alias("majority_intent"), "in_taxonomy_n",
        rate(-F.col("top.neg"), F.col("in_taxonomy_n")).alias("majority_accuracy"), "total",
        rate(F.col("esc"), F.col("total")).alias("escalate_accuracy"),
        F.lit(0).cast("long").alias("fah_count"), (F.col("total") - F.col("esc")).alias("fe_count"))


# --- thresholds ------------------------------------------------------------


def _bucket(score: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts the score reaches; null and NaN reach none."""
    reached = F.lit(0)
    for cut in cuts:
        reached = reached + F.coalesce((score >= F.lit(float(cut))) & ~F.isnan(score), F.lit(False)).cast("int")
    return reached


def threshold_sweep(df: DataFrame, taus: Sequence[float], score: str = "similarity", gated: str = "gated",
                    gold: str = "gold_decision", tier: str = "difficulty_tier",
                    also_count: Mapping[str, Column] | None = None) -> DataFrame:
    """Single-threshold policy at each tau: gated -> escalate, score >= tau -> auto.

    Scores are bucketed between the thresholds and counted once; each tau then
    reads the few bucket counts, so the input is not multiplied by the taus.
    ``also_count`` adds row counts of other conditions (the same at every tau).
    """
    counters = dict(also_count or {})
    cuts = sorted(taus)
    reached = F.when(F.col(gated), F.lit(0)).otherwise(_bucket(F.col(score), cuts))
    cells = df.groupBy(reached.alias("reached"), F.col(gold).alias("gold"), F.col(tier).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in counters.items()])
    grid = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(i + 1).alias("needs")) for i, t in enumerate(cuts)])
    per_tau = cells.select("*", F.explode(grid).alias("g")).select(
        "g.tau", "gold", "tier", "n", *counters,
        F.when(F.col("reached") >= F.col("g.needs"), d.AUTO_HANDLE).otherwise(d.ESCALATE).alias("decision"))
    n = F.col("n")
    hit = F.col("gold") == F.col("decision")
    extra = [F.sum(F.when(F.col("tier") == t, n)).alias(f"_n_{t}") for t in d.TIERS] + [
        F.sum(F.when((F.col("tier") == t) & hit, n)).alias(f"_c_{t}") for t in d.TIERS] + [F.sum(name).alias(name) for name in counters]
    counted = per_tau.groupBy("tau").agg(*routing_counts(F.col("gold"), F.col("decision"), n), *extra)
    rated = with_routing_rates(counted)
    for t in d.TIERS:
        rated = rated.withColumn(f"accuracy_{t}", rate(F.coalesce(F.col(f"_c_{t}"), F.lit(0)), F.col(f"_n_{t}")))
    return rated.drop(*[f"_{p}_{t}" for p in "nc" for t in d.TIERS])


def select_threshold(sweep: DataFrame, max_fah_rate: float = 0.15) -> DataFrame:
    """Lowest threshold whose false-auto-handle rate stays within the limit."""
    fit = F.col("fah_rate") <= max_fah_rate
    return sweep.agg(
        F.min(F.when(fit, F.col("tau"))).alias("tau"),
        F.min_by("fah_rate", F.when(fit, F.col("tau"))).alias("fah_rate"),
        F.min_by("fe_rate", F.when(fit, F.col("tau"))).alias("fe_rate"))


def two_threshold_grid(df: DataFrame, lows: Sequence[float], highs: Sequence[float], score: str = "similarity",
                       gated: str = "gated", resolves: str = "resolves", gold: str = "gold_decision",
                       by: Sequence[str] = ("split",)) -> DataFrame:
    """Routing metrics of every (tau_low <= tau_high) pair per group, from one count of the input."""
    cuts = sorted({*lows, *highs})
    need = {cut: i + 1 for i, cut in enumerate(cuts)}
    reached = F.when(F.col(gated), F.lit(0)).otherwise(_bucket(F.col(score), cuts))
    cells = df.groupBy(*by, reached.alias("reached"), F.col(resolves).alias("resolves"), F.col(gold).alias("gold")).agg(
        F.count(F.lit(1)).alias("n"))
    pairs = [(lo, hi) for lo in lows for hi in highs if lo <= hi]
    grid = F.array(*[
        F.struct(F.lit(float(lo)).alias("tau_low"), F.lit(float(hi)).alias("tau_high"),
                 F.lit(need[lo]).alias("lo"), F.lit(need[hi]).alias("hi")) for lo, hi in pairs])
    spread = cells.select("*", F.explode(grid).alias("g"))
    auto = ((F.col("reached") >= F.col("g.lo")) & F.coalesce(F.col("resolves"), F.lit(True))
            & ((F.col("reached") >= F.col("g.hi")) | F.coalesce(F.col("resolves"), F.lit(False))))
    decided = spread.withColumn("decision", F.when(auto, d.AUTO_HANDLE).otherwise(d.ESCALATE))
    counted = decided.groupBy(*by, F.col("g.tau_low").alias("tau_low"), F.col("g.tau_high").alias("tau_high")).agg(
        *routing_counts(F.col("gold"), F.col("decision"), F.col("n")))
    return with_routing_rates(counted)


def select_pair(grid: DataFrame, keys: Sequence[str] = ("tau_low", "tau_high"), split: str = "split",
                calibration: str = "calibration", held_out: str = "held_out") -> DataFrame:
    """Cheapest pair on calibration (ties: smallest keys), with its held-out score."""

    def on(name: str, part: str) -> Column:
        return F.max(F.when(F.col(split) == part, F.col(name)))

    wide = grid.groupBy(*keys).agg(
        on("cost", calibration).alias("calibration_cost"), on("cost", held_out).alias("held_out_cost"),
        on("accuracy", held_out).alias("held_out_accuracy"), on("fah_rate", held_out).alias("held_out_fah_rate"),
        on("fe_rate", held_out).alias("held_out_fe_rate"))
    return wide.orderBy("calibration_cost", *keys).limit(1)


# --- distributions and diagnostics ----------------------------------------


def value_counts(df: DataFrame, column: str, drop_null: bool = True) -> DataFrame:
    rows = df.filter(F.col(column).isNotNull()) if drop_null else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def exact_sum(value: Column) -> Column:
    """Sum in fixed-point arithmetic, so the total does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(20,10)")).cast("double")


def mean_confidence(df: DataFrame, decision: str = "decision", confidence: str = "calibrated_confidence") -> DataFrame:
    """Mean confidence per decision; 0 for a decision that was never taken."""

    def mean(which: str) -> Column:
        hit = F.col(decision) == which
        total = exact_sum(F.when(hit, F.col(confidence)))
        return F.coalesce(F.try_divide(total, F.count_if(hit & F.col(confidence).isNotNull())), F.lit(0.0))

    return df.agg(mean(d.AUTO_HANDLE).alias("mean_auto_handle"), mean(d.ESCALATE).alias("mean_escalate"),
                  F.count(F.lit(1)).alias("total"))


def gate_precision(df: DataFrame, gate: str = "gate_triggered", gold: str = "gold_decision") -> DataFrame:
    return (
        df.filter(F.col(gate).isNotNull()).groupBy(gate)
        .agg(F.count(F.lit(1)).alias("fired"), F.count_if(F.col(gold) == d.ESCALATE).alias("right"))
        .withColumn("precision", rate(F.col("right"), F.col("fired")))
    )


def fe_by_intent(df: DataFrame, intent: str = "gold_intent") -> DataFrame:
    """Handleable messages and how many of them were escalated, per intent."""
    handleable = df.filter(F.col("gold_decision") == d.AUTO_HANDLE)
    return (
        handleable.groupBy(intent)
        .agg(F.count(F.lit(1)).alias("handleable"), F.count_if(F.col("decision") == d.ESCALATE).alias("fe_count"))
        .withColumn("fe_rate", rate(F.col("fe_count"), F.col("handleable")))
    )


def fe_attribution(df: DataFrame) -> DataFrame:
    """Exclusive cause of each false escalation: gate, veto, wrong intent or the dead zone below tau_high."""
    wrong = df.filter((F.col("gold_decision") == d.AUTO_HANDLE) & (F.col("decision") == d.ESCALATE))
    cause = (
        F.when(F.col("decision_layer") == "layer_1_hard_gate", "gate_misfire")
        .when(F.col("decision_layer") == "layer_2_resolution_check_veto", "verifier_veto")
        .when(F.col("gold_intent") != F.col("predicted_intent"), "wrong_intent")
        .otherwise("similarity_dead_zone"))
    counted = wrong.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    # At most four rows are left here.
    whole = Window.partitionBy(F.lit(1))
    return counted.withColumn("share", rate(F.col("n"), F.sum("n").over(whole)))


def match_rate(df: DataFrame, gold: str, found: str) -> DataFrame:
    """Share of rows whose nearest neighbour carries the gold intent; no neighbour is a miss."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(gold) == F.col(found)).alias("matched")).select(
        "total", "matched", rate(F.col("matched"), F.col("total")).alias("match_rate"))


def coverage(pool: DataFrame, is_member: Column) -> DataFrame:
    """Rows of the pool that made it into the corpus."""
    return pool.agg(F.count(F.lit(1)).alias("pool_rows"), F.count_if(is_member).alias("corpus_rows")).select(
        "pool_rows", "corpus_rows", rate(F.col("corpus_rows"), F.col("pool_rows")).alias("coverage"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts for every pair with margins named 'total'."""
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    cubed = pairs.cube(row, column).agg(
        F.sum("n").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    return cubed.select(
        F.when(F.col("_r") == 1, "total").otherwise(F.col(row)).alias(row),
        F.when(F.col("_c") == 1, "total").otherwise(F.col(column)).alias(column), "n")
