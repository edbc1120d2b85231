"""Reproducible sampling and exact stratified splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import hash_ranks, seeded_hash, top_n_per_group


def balanced_sample(df: DataFrame, class_col: str, id_col: str, n: int = 250, seed: object = 42) -> DataFrame:
    """Up to ``n`` rows per class, chosen by seeded hash."""
    return top_n_per_group(df, [class_col], [seeded_hash(F.col(id_col), seed), F.col(id_col)], n, id_col)


def quota_sample(df: DataFrame, keys: Sequence[str], quota: Mapping[tuple, int], id_col: str, seed: object = 42) -> DataFrame:
    """Rows per key combination up to its quota; combinations without a quota are left out."""
    allowed = F.coalesce(*[
        F.when(_all_equal(keys, combo), F.lit(n)) for combo, n in quota.items()], F.lit(0))
    wanted = df.withColumn("quota", allowed).filter(F.col("quota") > 0)
    order = [seeded_hash(F.col(id_col), seed), F.col(id_col)]
    largest = top_n_per_group(wanted, [*keys, "quota"], order, max(quota.values()), id_col)
    return largest.filter(F.col("rn") <= F.col("quota"))


def _all_equal(keys: Sequence[str], combo: tuple) -> Column:
    test = F.lit(True)
    for key, value in zip(keys, combo):
        test = test & (F.col(key) == F.lit(value))
    return test


def stratified_split(df: DataFrame, strata: Sequence[str], id_col: str, test_size: int | float = 0.5, seed: object = 42,
                     test_name: str = "held_out", train_name: str = "calibration", col: str = "split") -> DataFrame:
    """Exact-size split; every stratum is within one row of its share.

    Rows are numbered through all strata; row ``r`` of ``total`` is a test row
    when ``ceil(r * size / total)`` steps up, in integer arithmetic.  A share is
    rounded up to a whole number of rows.  Pass narrow rows (id and strata) and
    join the split by id: they are written down.
    """
    total = F.col("all_n")
    if isinstance(test_size, float):
        size = F.ceil(total * F.lit(test_size)).cast("long")
    else:
        size = F.least(F.lit(test_size).cast("long"), total)
    ranked = hash_ranks(df, strata, id_col, seed)
    numbered = ranked.withColumn("_r", F.col("stratum_before") + F.col("rank")).withColumn("_size", size)
    up = F.expr("(_r * _size + all_n - 1) div all_n > ((_r - 1) * _size + all_n - 1) div all_n")
    return numbered.withColumn(col, F.when(up, test_name).otherwise(train_name)).drop(
        "_r", "_size", "rank", "stratum_n", "stratum_before", "all_n")


def seeded_head(df: DataFrame, id_col: str, n: int, seed: object = 42) -> DataFrame:
    """``n`` rows in seeded-hash order."""
    return df.orderBy(seeded_hash(F.col(id_col), seed), id_col).limit(n)
