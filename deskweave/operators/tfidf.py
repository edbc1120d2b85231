"""TF-IDF features: the whole vocabulary or its most frequent terms, and unit-length sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams_of, tokens


def terms_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): every unigram and bigram occurrence.

    Texts are spread by id once; the explode keeps that partitioning, so the
    per-document aggregations that follow need no further shuffle.
    """
    spread = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition("id")
    return (
        spread.select("id", tokens(F.col("_text")).alias("_toks"))
        .select("id", F.explode(ngrams_of(F.col("_toks"))).alias("term"))
    )


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return terms_of(docs, id_col, text_col).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


#: Vocabularies of at most this size are broadcast.
BROADCAST_TERMS = 100_000
#: Words that are looked up at a time.
_WORDS_AT_ONCE = 2_000_000


def known_counts(docs: DataFrame, id_col: str, text_col: str, terms: pa.Array) -> DataFrame:
    """(id, entries): the terms of a bounded vocabulary in each document, as places in ``terms`` with their counts.

    Terms are counted where a text is read, so only known ones travel, once for each document.  Rows with
    equal ids are one document, as in ``term_counts``, and may list a term several times; one without a known term has no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up_to = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(up_to, (up_to[low - 1] if low else 0) + _WORDS_AT_ONCE, side="right")))
                yield _counted(batch.slice(low, high - low), shared.value)
                low = high

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, terms array<int>, counts array<int>")
    entries = F.flatten(F.collect_list(F.arrays_zip("terms", "counts")))
    return found.groupBy("id").agg(entries.alias("entries"))


def _counted(batch: pa.RecordBatch, terms: pa.Array) -> pa.RecordBatch:
    """(id, terms, counts) of the rows with a known term."""
    words = batch.column(1).flatten()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
    pairs = pc.binary_join_element_wise(words[:-1], words[1:], " ") if len(words) > 1 else words[:0]
    within = row[1:] == row[:-1]
    keys = []
    for grams, owner, wanted in ((words, row, None), (pairs, row[:-1], within)):
        place = pc.fill_null(pc.index_in(grams, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = place >= 0 if wanted is None else (place >= 0) & wanted
        keys.append(owner[known] * len(terms) + place[known])
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    held, first = np.unique(key // max(1, len(terms)), return_index=True)
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % max(1, len(terms)), counts))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), *lists], ["id", "terms", "counts"])


def unit_weights(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of a batch of ``known_counts``, by row and then by term; what equal ids listed several times is added up."""
    entries = batch.column(1).flatten()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
    key, which = np.unique(row * len(idf) + entries.field("terms").to_numpy(zero_copy_only=False), return_inverse=True)
    tf = np.bincount(which, entries.field("counts").to_numpy(zero_copy_only=False))
    row, term = np.divmod(key, max(1, len(idf)))
    raw = (1.0 + np.log(tf)) * idf[term]
    return row, term, raw / np.sqrt(np.bincount(row, raw * raw, minlength=batch.num_rows))[row]


def known_rows(docs: DataFrame, id_col: str, text_col: str, vocabulary: pa.Table) -> DataFrame:
    """(id, terms, weights): ``sparse_rows`` of a bounded vocabulary (term, term_ix, idf), whose terms are counted where a text is read.

    ``term_ix`` counts from 0 in the order of the rows.
    """
    counts = known_counts(docs, id_col, text_col, vocabulary.column("term").combine_chunks())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.column("idf").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, weight = unit_weights(batch, shared.value)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term.astype(np.int32), weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "terms", "weights"])

    return counts.mapInArrow(run, f"id {counts.schema['id'].dataType.simpleString()}, terms array<int>, weights array<double>")


def term_totals(counts: DataFrame) -> DataFrame:
    """(term, total, df)."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def top_terms(counts: DataFrame, n: int) -> DataFrame:
    """(term, total, df) of the ``n`` most frequent terms; equal counts go alphabetically."""
    totals = term_totals(counts)
    return totals.orderBy(F.col("total").desc(), F.col("term")).limit(n)


def fit_idf(counts: DataFrame, n_docs: DataFrame, n: int | None) -> DataFrame:
    """(term, term_ix, idf) for the ``n`` most frequent terms, or for all of them if ``n`` is None.

    ``term_ix`` follows the frequency order; without ``n`` it is a 64-bit hash of the term, so that no task
    has to number the whole vocabulary.  ``n_docs`` holds the documents that are counted.
    """
    total = n_docs.agg(F.count(F.lit(1))).scalar()
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    if n is None:
        return term_totals(counts).select("term", F.xxhash64("term").alias("term_ix"), idf.alias("idf"))
    vocab = top_terms(counts, n)
    # The vocabulary has at most n rows, so sorting it in one place is safe.
    packed = vocab.agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("neg"), "term", "df"))).alias("v"))
    return packed.select(F.posexplode("v").alias("term_ix", "e")).select(
        F.col("e.term").alias("term"), "term_ix",
        (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("e.df"))) + F.lit(1.0)).alias("idf"),
    )


def _raw(counts: DataFrame, idf: DataFrame, n: int | None) -> DataFrame:
    known = F.broadcast(idf) if n is not None and n <= BROADCAST_TERMS else idf
    return counts.join(known, "term").withColumn("raw", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))


def weigh(counts: DataFrame, idf: DataFrame, n: int | None = None) -> DataFrame:
    """(id, term, term_ix, weight): sublinear tf times idf, unit length per document.

    ``n`` is the bound that ``idf`` was fitted with; a large or unbounded vocabulary is joined by a shuffle.
    """
    raw = _raw(counts, idf, n)
    rows = raw.groupBy("id").agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        F.collect_list(F.struct("term", "term_ix", "raw")).alias("entries"),
    )
    return rows.select("id", "norm", F.explode("entries").alias("e")).select(
        "id", F.col("e.term").alias("term"), F.col("e.term_ix").alias("term_ix"), (F.col("e.raw") / F.col("norm")).alias("weight"))


def sparse_rows(counts: DataFrame, idf: DataFrame, n: int | None = None) -> DataFrame:
    """(id, terms, weights): one unit-length sparse row per document with a known term; ``n`` as for ``weigh``."""
    raw = _raw(counts, idf, n)
    rows = raw.groupBy("id").agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        F.array_sort(F.collect_list(F.struct("term_ix", "raw"))).alias("entries"),
    )
    return rows.select(
        "id",
        F.col("entries.term_ix").alias("terms"),
        F.transform("entries", lambda e: e["raw"] / F.col("norm")).alias("weights"),
    )
