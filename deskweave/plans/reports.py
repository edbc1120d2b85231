"""Evaluation and judge-validation reports as (section, metric, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..operators import agreement as a
from ..operators import metrics as m
from ..session import cut_lineage


def long_format(df: DataFrame, section: Column, names: Sequence[str]) -> DataFrame:
    """One row per metric column."""
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return df.select(section.alias("section"), F.explode(F.array(*cells)).alias("c")).select("section", "c.metric", "c.value")


def evaluation_cells(preds: DataFrame, split: str = "split") -> DataFrame:
    """Predictions counted per combination of all label columns.

    This one aggregation is the only pass over the predictions; its size is
    bounded by the label sets, not by the data.
    """
    return preds.groupBy("gold_intent", "predicted_intent", "difficulty_tier", split, "gold_decision", "decision",
                         "gate_triggered", "grounding_source").agg(
        F.count(F.lit(1)).alias("n"), m.exact_sum(F.col("calibrated_confidence")).alias("confidence_sum"))


# Raw counts a section can carry; each section fills the ones it needs.
_RAW = (*m.COUNTS, "predicted_n", "value_sum")


def evaluation_report(preds: DataFrame, labels: Sequence[str], split: str = "split") -> DataFrame:
    """Classification, routing per split and tier, distributions and confidences.

    Labels and decisions without a row are reported as zeros.  One straight chain: cells, the sections each cell adds to, raw counts per
    section, metrics per section, final rows.  Nothing is read twice.
    """
    cells = evaluation_cells(preds, split)
    parts = cells.select(F.explode(F.concat(*_contributions(labels, split))).alias("p")).filter("p IS NOT NULL").select("p.*")
    parts = parts.unionByName(_empty_sections(preds.sparkSession, labels))
    sections = parts.groupBy("section", "kind").agg(*[(m.exact_sum(F.col(c)) if c == "value_sum" else F.sum(c)).alias(c) for c in _RAW])
    rows = sections.select("section", F.explode(F.array_compact(F.array(*_section_metrics(labels)))).alias("m")).select(
        F.coalesce("m.in_section", "section").alias("section"), "m.metric", "m.value", "m.weight")
    # Averages over labels are weighted means; every other metric has a single row.
    mean = F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")), F.lit(0.0))
    averaged = F.col("metric").isin("macro_f1", "weighted_f1")
    return rows.groupBy("section", "metric").agg(mean.alias("value")).select(
        "section", "metric", F.when(averaged, F.round("value", m.DECIMALS)).otherwise(F.col("value")).alias("value"))


def _contributions(labels: Sequence[str], split: str) -> list[Column]:
    """Arrays of section counts one cell contributes to."""
    n, none = F.col("n"), F.lit(0).cast("long")

    def part(section: Column, kind: str, **counts: Column) -> Column:
        return F.struct(section.alias("section"), F.lit(kind).alias("kind"),
                        *[counts.get(c, F.lit(0.0) if c == "value_sum" else none).alias(c) for c in _RAW])

    known = F.col("gold_intent").isin(*labels)
    right = F.when(F.col("gold_intent") == F.col("predicted_intent"), n).otherwise(none)
    gold, decision = F.col("gold_decision"), F.col("decision")

    def only(condition: Column) -> Column:
        return F.when(condition, n).otherwise(none)

    routing = dict(
        total=n, correct=only(gold == decision), fah_count=only((gold == d.ESCALATE) & (decision == d.AUTO_HANDLE)),
        fah_total=only(gold == d.ESCALATE), fe_count=only((gold == d.AUTO_HANDLE) & (decision == d.ESCALATE)),
        fe_total=only(gold == d.AUTO_HANDLE))
    tier = F.col("difficulty_tier")
    classified = F.array(
        part(F.lit("classification"), "classification", total=n, correct=right),
        part(F.concat(F.lit("classification/"), tier), "classification", total=n, correct=right),
        part(F.concat(F.lit("intent/"), "gold_intent"), "label", total=n, correct=right),
        part(F.concat(F.lit("intent/"), "predicted_intent"), "label", predicted_n=n))
    routed = F.array(*[
        part(F.concat(F.lit("routing/"), s, F.lit("/"), t), "routing", **routing)
        for s in (F.lit("full_set"), F.col(split)) for t in (F.lit("all"), tier)])
    other = F.array(
        F.when(F.col("grounding_source").isNotNull(), part(F.concat(F.lit("grounding_source/"), "grounding_source"), "count", total=n)),
        F.when(F.col("gate_triggered").isNotNull(), part(F.concat(F.lit("gate_triggered/"), "gate_triggered"), "count", total=n)),
        part(F.concat(F.lit("confidence/mean_"), decision), "mean", total=n, value_sum=F.coalesce("confidence_sum", F.lit(0.0))))
    return [F.when(known, classified).otherwise(F.array().cast(_array_of_parts())), routed, other]


def _empty_sections(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """Sections that are reported even if no row belongs to them."""
    rows = [(f"intent/{name}", "label") for name in labels] + [(f"confidence/mean_{x}", "mean") for x in (d.AUTO_HANDLE, d.ESCALATE)]
    zeros = {c: F.lit(0.0 if c == "value_sum" else 0).cast("double" if c == "value_sum" else "long") for c in _RAW}
    return spark.createDataFrame(rows, "section string, kind string").withColumns(zeros)


def _array_of_parts() -> str:
    counts = ", ".join(f"{c}: {'double' if c == 'value_sum' else 'bigint'}" for c in _RAW)
    return f"array<struct<section: string, kind: string, {counts}>>"


def _section_metrics(labels: Sequence[str]) -> list[Column]:
    """Metric structs of a section; those of other kinds are null."""
    kind, section = F.col("kind"), F.col("section")
    one = F.lit(1.0)

    def metric(when: Column, name: Column | str, value: Column, weight: Column = one, in_section: Column | None = None) -> Column:
        return F.when(when, F.struct(
            (in_section if in_section is not None else F.lit(None).cast("string")).alias("in_section"),
            (F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("double").alias("value"),
            weight.cast("double").alias("weight")))

    total, correct = F.col("total"), F.col("correct")
    precision, recall, f1 = m.prf(correct, total, F.col("predicted_n"))
    is_class, is_label, is_route = kind == "classification", kind == "label", kind == "routing"
    named_label = is_label & F.regexp_replace(section, "^intent/", "").isin(*labels)
    # 'field/value' sections hold one distribution entry or mean each.
    entry = (kind == "count") | (kind == "mean")
    cost = d.COST_FALSE_AUTO * F.col("fah_count") + d.COST_FALSE_ESCALATION * F.col("fe_count")
    return [
        metric(is_class | is_route, "total", total), metric(is_class | is_route, "correct", correct),
        metric(is_class | is_route, "accuracy", m.rate(correct, total)),
        metric(named_label, "precision", F.round(precision, m.DECIMALS)), metric(named_label, "recall", F.round(recall, m.DECIMALS)),
        metric(named_label, "f1", F.round(f1, m.DECIMALS)), metric(named_label, "support", total),
        metric(is_label, "macro_f1", f1, (total + F.col("predicted_n") > 0).cast("int"), F.lit("classification")),
        metric(is_label, "weighted_f1", f1, total, F.lit("classification")),
        *[metric(is_route, c, F.col(c)) for c in m.COUNTS[2:]],
        metric(is_route, "fah_rate", m.rate(F.col("fah_count"), F.col("fah_total"))),
        metric(is_route, "fe_rate", m.rate(F.col("fe_count"), F.col("fe_total"))), metric(is_route, "cost", cost),
        metric(entry, F.substring_index(section, "/", -1),
               F.when(kind == "count", total).otherwise(F.coalesce(F.try_divide(F.col("value_sum"), total), F.lit(0.0))),
               one, F.substring_index(section, "/", 1)),
    ]


def judge_validation_report(human: DataFrame, judge: DataFrame, scores: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Agreement, kappa and rank correlation of merged ratings, in long format.

    Ratings are counted per combination first; all statistics start from those rows, which are written down once.
    """
    score_columns = [c for _, h, j in scores for c in (h, j)]
    cells = cut_lineage(a.rating_cells(a.merge_ratings(human, judge), ["difficulty_tier", "human_decision", "judge_decision", *score_columns]))
    agree = a.agreement(cells, scores=scores, weight="weight")
    kappa = a.kappa_with_ci(cells, weight="weight")
    report = long_format(agree, F.col("difficulty_tier"),
                         ["n", "agreed", "agreement_rate", "discordant", *[f"{name}_mae" for name, _, _ in scores]])
    report = report.unionByName(long_format(kappa, F.col("difficulty_tier"), ["kappa", "standard_error", "ci_low", "ci_high"]))
    rho = a.spearman(cells, scores, weight="weight")
    return report.unionByName(rho.select(
        F.lit("overall").alias("section"), F.concat(F.col("metric"), F.lit("_spearman")).alias("metric"),
        F.col("spearman").alias("value")))
