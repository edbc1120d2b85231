"""Agreement between a human rater and a judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import DECIMALS, rate
from .ranks import average_ranks


def merge_ratings(human: DataFrame, judge: DataFrame, keys: Sequence[str] = ("id", "difficulty_tier")) -> DataFrame:
    return human.join(judge, list(keys))


def rating_cells(df: DataFrame, columns: Sequence[str], weight: str = "weight") -> DataFrame:
    """Ratings counted per combination of their values: few rows, whatever the input size."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(weight))


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def agreement(df: DataFrame, tier: str = "difficulty_tier", human: str = "human_decision",
              judge: str = "judge_decision", scores: Sequence[tuple[str, str, str]] = (),
              weight: str | None = None) -> DataFrame:
    """Agreement rate and mean absolute score errors per tier and 'overall'.

    ``scores`` lists (name, human column, judge column); ``weight`` names the
    count column of pre-counted ratings.
    """
    w = _weight(weight)
    gaps = [F.sum(w * F.abs(F.col(h) - F.col(j))).cast("double").alias(f"_{name}") for name, h, j in scores]
    per_tier = df.groupBy(tier).agg(F.sum(w).alias("n"), _count(F.col(human) == F.col(judge), w).alias("agreed"), *gaps)
    rolled = per_tier.rollup(tier).agg(
        F.sum("n").alias("n"), F.sum("agreed").alias("agreed"),
        *[F.sum(f"_{name}").alias(f"_{name}") for name, _, _ in scores], F.grouping(tier).alias("_all"))
    return rolled.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col(tier)).alias(tier), "n", "agreed",
        rate(F.col("agreed"), F.col("n")).alias("agreement_rate"), (F.col("n") - F.col("agreed")).alias("discordant"),
        *[rate(F.col(f"_{name}"), F.col("n")).alias(f"{name}_mae") for name, _, _ in scores])


def _count(condition: Column, weight: Column) -> Column:
    return F.sum(F.when(condition, weight).otherwise(F.lit(0).cast("long")))


def discordant(df: DataFrame, human: str = "human_decision", judge: str = "judge_decision") -> DataFrame:
    return df.filter(F.col(human) != F.col(judge))


def kappa_with_ci(df: DataFrame, tier: str = "difficulty_tier", human: str = "human_decision",
                  judge: str = "judge_decision", labels: Sequence[str] = ("pass", "fail"), z: float = 1.96,
                  weight: str | None = None) -> DataFrame:
    """Cohen's kappa, its asymptotic standard error and a clamped interval, per tier and 'overall'.

    Two identical constant raters (expected agreement 1) get kappa 0.
    """
    # Counted conditionally instead of filtered, so that pre-counted ratings stay one shared exchange.
    w = F.when(F.col(human).isin(*labels) & F.col(judge).isin(*labels), _weight(weight)).otherwise(F.lit(0).cast("long"))
    marginals: list[Column] = [F.sum(w).alias("n"), _count(F.col(human) == F.col(judge), w).alias("same")]
    names = ["n", "same"]
    for i, label in enumerate(labels):
        marginals += [_count(F.col(human) == label, w).alias(f"_h{i}"), _count(F.col(judge) == label, w).alias(f"_j{i}")]
        names += [f"_h{i}", f"_j{i}"]
    per_tier = df.groupBy(tier).agg(*marginals)
    rolled = per_tier.rollup(tier).agg(*[F.sum(c).alias(c) for c in names], F.grouping(tier).alias("_all"))
    chance = F.lit(0.0)
    for i in range(len(labels)):
        chance = chance + F.col(f"_h{i}").cast("double") * F.col(f"_j{i}")
    n = F.col("n").cast("double")
    po = F.coalesce(F.try_divide(F.col("same").cast("double"), n), F.lit(0.0))
    pe = F.coalesce(F.try_divide(chance, n * n), F.lit(0.0))
    measured = rolled.withColumn("po", po).withColumn("pe", pe)
    kappa = F.coalesce(F.try_divide(F.col("po") - F.col("pe"), F.lit(1.0) - F.col("pe")), F.lit(0.0))
    spread = F.when((F.col("pe") >= 1.0) | (F.col("po") == 1.0), F.lit(0.0)).otherwise(
        F.sqrt(F.coalesce(F.try_divide(F.col("po") * (1.0 - F.col("po")), n * (1.0 - F.col("pe")) * (1.0 - F.col("pe"))), F.lit(0.0))))
    final = measured.withColumn("kappa", kappa).withColumn("se", spread)
    return final.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col(tier)).alias(tier), F.col("n").cast("long").alias("n"),
        F.round("kappa", DECIMALS).alias("kappa"), F.round("se", DECIMALS).alias("standard_error"),
        F.round(F.greatest(F.lit(-1.0), F.col("kappa") - z * F.col("se")), DECIMALS).alias("ci_low"),
        F.round(F.least(F.lit(1.0), F.col("kappa") + z * F.col("se")), DECIMALS).alias("ci_high"))


def spearman(df: DataFrame, scores: Sequence[tuple[str, str, str]], weight: str | None = None) -> DataFrame:
    """(metric, n, spearman) per (name, x, y): rank correlation with average ranks; 0 if a side is constant.

    Rows are counted per distinct value pair first, so a value shared by most
    rows is one row in everything that follows, and all sides are ranked in one
    pass.
    """
    entries = [F.struct(F.lit(name).alias("metric"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
               for name, x, y in scores]
    pairs = (
        df.select(F.explode(F.array(*entries)).alias("e"), _weight(weight).alias("w")).select("e.*", "w")
        .filter("x IS NOT NULL AND y IS NOT NULL").groupBy("metric", "x", "y").agg(F.sum("w").alias("n"))
    )
    sides = pairs.select("metric", "x", "y", "n", F.explode(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("value")))).alias("s")).select("metric", "x", "y", "s.side", "s.value", "n")
    # Values tell their ranks to the pairs they are in; a pair then puts its two sides together.
    ranks = average_ranks(sides, ["metric", "side"], "value", "n", ["x", "y"])
    ranked = ranks.groupBy("metric", "x", "y").agg(
        F.max(F.when(F.col("side") == "x", F.col("avg_rank"))).alias("rx"), F.max(F.when(F.col("side") == "y", F.col("avg_rank"))).alias("ry"),
        F.max("n").alias("n"))
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("metric").agg(
        F.sum("n").alias("n"), F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"))
    total = F.col("n").cast("double")
    centre = total * (total + 1.0) * (total + 1.0) / 4.0
    vx, vy = F.col("xx") - centre, F.col("yy") - centre
    rho = F.when((vx > 0) & (vy > 0), (F.col("xy") - centre) / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    return sums.select("metric", "n", F.round(rho, DECIMALS).alias("spearman"))
