"""Distinct counts from sketches that are kept by group and day, so that new days merge without reading old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logarithm of a sketch's buckets; the relative standard error is about 1.04 / sqrt(2 ** LG_BUCKETS).
LG_BUCKETS = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_BUCKETS / 2)


def day_sketches(rows: DataFrame, by: Sequence[str], day: Column, value: Column) -> DataFrame:
    """(by..., day, n, sketch): rows and a sketch of their distinct values for each group and day; nulls are no values."""
    return rows.withColumn("day", day).groupBy(*by, "day").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, F.lit(LG_BUCKETS)).alias("sketch"))


def store_days(spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str], day: Column, value: Column) -> DataFrame:
    """The sketches stored at ``path``, after the days of ``rows`` were added or replaced; other days are not read.

    Bring the rows of whole days: a day is stored as a folder, and a new version of it takes the place of the
    old one.  Runs that write different days do not meet.
    """
    fresh = day_sketches(rows.filter(day.isNotNull()), by, day, value)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return read_days(spark, path, fresh.schema)


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The sketches stored at ``path``; none if nothing was stored there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def merged(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., days, n, about): days and rows of each group and its estimated distinct values over all its days."""
    return days.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
