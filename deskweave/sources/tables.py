"""Readers, sinks and stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import Rule
from ..functions.text import sanitize_newlines

# Columns of the stored files.
CORPUS_COLUMNS = ("tweet_id", "clean_text", "brand_reply_text", "silver_intent")
PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("gold_intent", T.StringType()),
    T.StructField("difficulty_tier", T.StringType()), T.StructField("predicted_intent", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())])
AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("difficulty_tier", T.StringType()),
    T.StructField("decision", T.StringType()), T.StructField("gold_decision", T.StringType()),
    T.StructField("customer_text", T.StringType()), T.StructField("drafted_reply", T.StringType()),
    T.StructField("evidence_used", T.StringType()), T.StructField("human_groundedness", T.IntegerType()),
    T.StructField("human_tone", T.IntegerType()), T.StructField("human_decision", T.StringType()),
    T.StructField("human_notes", T.StringType())])

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case and with underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def scan_messages(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The message dump with every column as text.

    Quoted line breaks survive.  A multi-line CSV file cannot be split, so keep
    the dump as many files or convert it once with ``sink_table``.
    """
    if fmt == "csv":
        return normalise_header(spark.read.options(**_CSV).option("inferSchema", "false").csv(path))
    return as_strings(normalise_header(spark.read.format(fmt).load(path)))


def scan_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A result file with an explicit schema; empty fields are null."""
    reader = spark.read.schema(schema)
    return (reader.options(**_CSV) if fmt == "csv" else reader).format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a few large input splits every core.

    A scan that already has at least as many splits as cores is left alone, so
    large tables are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def flatten_newlines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sanitize_newlines(F.col(c)) for c in columns})


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def sink_json_report(report: DataFrame, path: str) -> None:
    """Write report rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def report_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def read_rules(table: DataFrame, rule_set: str, limit: int = 1000) -> tuple[Rule, ...]:
    """Rules of one set kept as (rule_set, rank, name, pattern, reason) rows, in rank order.

    Rules become part of the plan, unrolled into one expression, so a table with more than ``limit`` is
    refused; ``limit`` bounds what reaches the driver.
    """
    rows = table.filter(F.col("rule_set") == rule_set).orderBy("rank", "name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule set {rule_set!r} has more than {limit} rules")
    return tuple(Rule(r["name"], r["pattern"], r["reason"] or "") for r in rows)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A finished table is there (a write that failed half-way leaves no success marker)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(hadoop_path, "_SUCCESS"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Reuse the table at ``path`` or build and store it."""
    if not table_exists(spark, path):
        sink_table(build(), path, partition_by=partition_by)
    return spark.read.parquet(path)


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored rows, or an empty frame when there is no readable cache; a damaged file in it is passed over, and its entries are asked for again."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_new(new: DataFrame, path: str, existing: DataFrame, key: str) -> None:
    """Append the rows whose key is not stored yet."""
    fresh = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def still_to_do(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows a restarted batch has yet to process."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
