"""A cleaning pipeline over documents: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.llm import benchmark_leaks, byte_bpe, language, passages, simhash
from deskweave.llm.catalog import RANKS_PATTERN, encoding_digests, tokenizer_file
from deskweave.llm.sides import small_side
from deskweave.session import checkpoint_dir, cut_lineage

#: Mean probability of the language named below which a document is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.3

#: SQL cannot train a network; tests compare the stages with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which the network, trained on the labelled rows, sees a language; all columns stay as they are."""
    model = language.fit(docs, "text", F.col("lang"))
    others, schema = _columns_but_text(docs)
    judged = language.predict(docs, model, [docs[f"`{c}`"] for c in others], schema, with_text=True)
    # A null text is rejected, so none comes out as an empty one.
    fine = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _named(judged.where(fine), others, F.col("text")).select(*[f"`{c}`" for c in docs.columns])


def _columns_but_text(docs: DataFrame) -> tuple[list[str], str]:
    """Names of the other columns, and a schema in which they are c0, c1, ..."""
    others = [c for c in docs.columns if c != "text"]
    return others, ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))


def _named(rows: DataFrame, others: list[str], text: Column) -> DataFrame:
    """Columns c0, c1, ... under their own names, and the text."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], text.alias("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one whose id names it; rows with a null id stay only if no other is alike."""
    groups = cut_lineage(simhash.simhash_groups(docs).where("doc_id <=> component_id").groupBy("doc_id").count())
    kept = _matching(docs, groups, "left_semi")
    again = groups.where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # Of an id that repeats, the first row in the order of the other columns.
    rest = [c for c in docs.columns if c != "doc_id"]
    rows = _matching(kept, again, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[docs[f"`{c}`"] for c in rest])).alias("row"))
    return _matching(kept, again, "left_anti").unionByName(rows.select("doc_id", *[F.col("row")[c].alias(c) for c in rest]))


def _matching(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id, null included, is among ``ids`` or (left_anti) is not."""
    other = small_side(ids.select(F.col("doc_id").alias("other_id")).distinct())
    return docs.join(other, docs["doc_id"].eqNullSafe(other["other_id"]), how)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has; n_chars follows, and a document of nothing else goes."""
    others, schema = _columns_but_text(docs)
    cleaned = passages.remove_repeats(docs, [docs[f"`{c}`"] for c in others], schema)
    left = cleaned.where((F.size("cuts") == 0) | (F.col("clean") != ""))
    named = _named(left, others, F.col("clean"))
    if "n_chars" in named.columns:
        named = named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return named.select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window repeats a benchmark item."""
    found = benchmark_leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _matching(docs, found, "left_anti")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, checked by digests of the ids and of the bytes they decode to."""
    ranks = byte_bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    return encoding_digests(byte_bpe.decode(byte_bpe.encode(docs, ranks, RANKS_PATTERN), ranks))


STAGES = [
    ("language identification", identify_language),
    ("SimHash near-duplicates", drop_near_copies),
    ("repeated passages", cut_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
