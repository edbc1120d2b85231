"""Statistics and normalisation around human labelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions.text import trim_all
from .metrics import rate
from .ranks import running_sums


def normalise_code(code: Column, codes: Mapping[str, str]) -> Column:
    """Canonical label of a typed code; null marks an invalid one."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(trim_all(code)))


def ensure_columns(df: DataFrame, columns: Sequence[str] = d.LABEL_COLUMNS) -> DataFrame:
    """Every column as text without nulls; missing label columns appear empty."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    absent = [F.lit("").alias(c) for c in columns if c not in df.columns]
    return df.select(*present, *absent)


def label_progress(df: DataFrame, id_col: str, label: str, stratum: str, other: str = d.OTHER,
                   archived_other: int = d.ARCHIVED_OTHER, archived_total: int = d.ARCHIVED_TOTAL) -> DataFrame:
    """Labelled and 'other' counts per stratum and overall, with the first row still to label.

    Labels are empty while missing.  The overall rate includes archived rows.
    """
    done = F.col(label) != ""
    per = df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("labelled"),
        F.count_if(F.col(label) == other).alias("other_n"), F.min(F.when(~done, F.col(id_col))).alias("resume_id"))
    rolled = per.rollup(stratum).agg(
        F.sum("total").alias("total"), F.sum("labelled").alias("labelled"), F.sum("other_n").alias("other_n"),
        F.min("resume_id").alias("resume_id"), F.grouping(stratum).alias("_all"))
    whole = F.col("_all") == 1
    extra_other = F.when(whole, F.lit(archived_other)).otherwise(0)
    extra_total = F.when(whole, F.lit(archived_total)).otherwise(0)
    return rolled.select(
        F.when(whole, "overall").otherwise(F.col(stratum)).alias(stratum), "total", "labelled", "other_n",
        rate(F.col("other_n") + extra_other, F.col("labelled") + extra_total).alias("other_rate"), "resume_id")


def running_other_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_other: Column,
                       limit: float = d.OTHER_ALERT_RATE, min_labelled: int = 10) -> DataFrame:
    """Running share of 'other' per key, flagging the rows where it first exceeds the limit."""
    flag = is_other.cast("long")
    summed = running_sums(df, keys, order, {"labelled": F.lit(1).cast("long"), "others": flag})
    now = F.col("others") / F.col("labelled")
    before = F.coalesce(F.try_divide(F.col("others") - flag, F.col("labelled") - 1), F.lit(0.0))
    return summed.select(
        *df.columns, "labelled", "others", F.round(now, 6).alias("other_rate"),
        ((F.col("labelled") > min_labelled) & (now > limit) & (before <= limit)).alias("alert"))


def difficulty_hint(text: Column, hits: Column, escalation_word: Column, max_chars: int = 50) -> Column:
    """'hard' for short texts, several intents or escalation words."""
    return F.when((F.length(text) <= max_chars) | (F.size(hits) >= 2) | escalation_word, "hard").otherwise("easy")
