"""Reference policies: TF-IDF retrieval with gates, and a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..functions.text import strip_handles
from ..operators import metrics as m
from ..operators.postings import sparse_best
from ..operators.tfidf import BROADCAST_TERMS, fit_idf, known_counts, known_rows, sparse_rows, term_counts, unit_weights
from ..session import cut_lineage

_ROWS_PER_TASK = 20_000
SWEEP_TAUS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.50)


def tfidf_nearest(queries: DataFrame, corpus: DataFrame, n_terms: int | None = 5000) -> DataFrame:
    """Nearest corpus row by TF-IDF cosine for (id, text) frames.

    Vocabulary and idf come from the corpus only: its ``n_terms`` most frequent terms, or all (None).  Every query is returned; one
    without a shared term has a null ``hit_id`` and similarity 0.
    """
    counts = term_counts(corpus, "id", "text")
    bounded = n_terms is not None and n_terms <= BROADCAST_TERMS
    if bounded:
        # Other terms weigh nothing, so they are counted for the vocabulary alone and neither written down nor joined.
        vocabulary = fit_idf(counts, corpus, n_terms).toArrow().sort_by("term_ix").combine_chunks()
        asked, indexed = (known_rows(side, "id", "text", vocabulary) for side in (queries, corpus))
    else:
        counts = cut_lineage(counts)  # texts are taken apart once
        idf = cut_lineage(fit_idf(counts, corpus, n_terms))
        indexed = sparse_rows(counts, idf, n_terms)
        asked = sparse_rows(term_counts(queries, "id", "text"), idf, n_terms)
    hits = sparse_best(asked, indexed, query_id="id", corpus_id="id", bounded_terms=bounded)
    return queries.select("id").join(hits, "id", "left").select(
        "id", "hit_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def retrieval_policy_report(golden: DataFrame, corpus: DataFrame, gates: Sequence[Rule], in_taxonomy: Sequence[str],
                            taus: Sequence[float] = SWEEP_TAUS, n_terms: int | None = 5000, searched: Column | None = None) -> DataFrame:
    """Sweep of 'gated -> escalate, similar enough -> auto' plus the top-1 intent match.

    ``golden``: id, text, gold_intent, gold_decision, difficulty_tier;
    ``corpus``: id, text, silver_intent.  Gates read the raw text; the search reads ``searched``, by default
    the text without leading handles.
    """
    gated = F.lit(False)
    for gate in gates:
        gated = gated | gate.hits(F.col("text"))
    rows = golden.select("id", "gold_intent", "gold_decision", "difficulty_tier", gated.alias("gated"))
    asked = searched if searched is not None else strip_handles(F.col("text"))
    nearest = tfidf_nearest(golden.select("id", asked.alias("text")), corpus.select("id", "text"), n_terms)
    intents = corpus.select(F.col("id").alias("hit_id"), F.col("silver_intent").alias("hit_intent"))
    scored = rows.join(nearest, "id").join(intents, "hit_id", "left")
    known = F.col("gold_intent").isin(*in_taxonomy)
    sweep = m.threshold_sweep(scored, taus, also_count={
        "_known": known, "_matched": known & (F.col("gold_intent") == F.col("hit_intent"))})
    return sweep.withColumn("intent_match", m.rate(F.col("_matched"), F.col("_known"))).drop("_known", "_matched")


def train_intent_model(train: DataFrame, n_terms: int | None = 5000, regularisation: float = 1.0, max_iter: int = 500):
    """Multinomial logistic regression on TF-IDF rows of (id, text, label).

    Returns a function that adds ``predicted`` to (id, text) rows.  The training
    set is a bounded balanced sample, and the label list is bounded by the taxonomy; the vocabulary is the
    ``n_terms`` most frequent terms of the sample, or all of them (None).  Rows are sparse throughout, so
    a row holds as many numbers as it has terms, whatever the vocabulary.  The fit runs here and now.
    """
    counts = cut_lineage(term_counts(train, "id", "text"))
    idf = cut_lineage(fit_idf(counts, train, n_terms))
    if n_terms is None:
        idf = cut_lineage(_numbered(idf))
    size = idf.count()
    labels = [row[0] for row in train.select("label").distinct().orderBy("label").collect()]
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))])
    rows = train.select("id", F.try_element_at(codes, F.col("label")).alias("label"))
    n_rows = max(1, train.count())
    # Few rows per task would spend every iteration on scheduling.
    parts = -(-n_rows // _ROWS_PER_TASK)
    data = rows.join(_ml_vectors(sparse_rows(counts, idf, n_terms), size), "id").repartition(parts).persist()
    fitted = LogisticRegression(maxIter=max_iter, regParam=1.0 / (regularisation * n_rows),
                                elasticNetParam=0.0, standardization=False, family="multinomial", tol=1e-4).fit(data)
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    data.unpersist()
    vocabulary = idf.select("term", "term_ix", "idf").toArrow().sort_by("term_ix").combine_chunks()  # of a bounded sample, as the coefficients

    def predict(texts: DataFrame) -> DataFrame:
        # Only the sample's terms weigh anything, so a text becomes their counts where it is read, and one sum per label from these.
        counts = known_counts(texts, "id", "text", vocabulary.column("term").combine_chunks())
        sums = _linear_sums(counts, vocabulary.column("idf").to_numpy(), matrix)
        best = F.array_max(F.array(*[
            F.struct((F.coalesce(F.element_at("_sums", i + 1), F.lit(0.0)) + F.lit(float(bias[i]))).alias("score"), F.lit(name).alias("label"))
            for i, name in enumerate(labels)]))
        return texts.join(sums, "id", "left").select(*texts.columns, best["label"].alias("predicted"))

    return predict


def baselines_report(golden: DataFrame, corpus: DataFrame, train: DataFrame, gates: Sequence[Rule], in_taxonomy: Sequence[str],
                     taus: Sequence[float] = SWEEP_TAUS, n_terms: int | None = 5000) -> DataFrame:
    """(baseline, metric, value) of all three: constant answers, the fitted classifier, and TF-IDF retrieval with gates at each tau.

    ``golden`` as for ``retrieval_policy_report``; ``train``: id, text, label.  The classifier is rated on golden rows of the taxonomy.
    """
    known = F.col("gold_intent").isin(*in_taxonomy)
    rated = golden.filter(known)
    predicted = rated.join(train_intent_model(train, n_terms)(rated.select("id", "text")).select("id", F.col("predicted").alias("predicted_intent")), "id")
    trivial = m.baseline_trivial(golden, known)
    sweep = retrieval_policy_report(golden, corpus, gates, in_taxonomy, taus, n_terms)

    def rows(name: Column, df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
        numbers = [c for c in df.columns if c not in drop]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
        return df.select(name.alias("baseline"), F.explode(cells).alias("c")).select("baseline", "c.*")

    return (rows(F.lit("constant"), trivial, ["majority_intent"])
            .unionByName(rows(F.lit("classifier"), m.accuracy(predicted)))
            .unionByName(rows(F.lit("classifier"), m.f1_summary(predicted)))
            .unionByName(rows(F.concat(F.lit("retrieval@"), F.col("tau").cast("string")), sweep, ["tau"])))


def _linear_sums(counts: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(id, _sums): for each label, the product of its coefficients with the unit-length TF-IDF row of a document's term counts."""
    shared = counts.sparkSession.sparkContext.broadcast((idf, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, matrix = shared.value
        for batch in batches:
            row, term, weight = unit_weights(batch, idf)
            sums = np.stack([np.bincount(row, weight * own[term], minlength=batch.num_rows) for own in matrix], axis=1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(matrix))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["id", "_sums"])

    return counts.mapInArrow(run, f"id {counts.schema['id'].dataType.simpleString()}, _sums array<double>")


def _numbered(idf: DataFrame) -> DataFrame:
    """Terms numbered 0, 1, ... without a gap, each partition by itself after those before it."""
    rows = cut_lineage(idf.select("term", "idf").withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).cast("int")
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    before = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0))
    start = F.element_at(F.array(*[F.lit(x) for x in before]), part + 1)
    return rows.select("term", (start + F.col("_row") % (1 << 33)).cast("int").alias("term_ix"), "idf")


def _ml_vectors(rows: DataFrame, size: int) -> DataFrame:
    """(id, features): sparse rows of a bounded training set as sparse ML vectors."""
    @F.udf(VectorUDT())
    def vector(terms, weights):
        return SparseVector(size, terms, weights)

    return rows.select("id", vector("terms", "weights").alias("features"))
