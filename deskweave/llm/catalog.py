"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_leaks, byte_bpe, centroids, importance, language, licences, passages, pieces, quality, sharding, simhash, token_counts, vectors

#: Fixed value: how the rank file's vocabulary splits a text before merging.
RANKS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARDS = 40
TOKEN_LIMIT = 2048
CLUSTERS = 8
CLUSTER_ROUNDS = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(docs: DataFrame, by: int) -> F.Column:
    """crc32 of the id's text modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % by


def tokenizer_file(name: str) -> str:
    """Where the driver finds a vocabulary file; tasks get its content from the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(_remainder(docs, 3) != 1), _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, [docs["doc_id"], _remainder(docs, 3) == 1], "doc_id bigint, held_out boolean")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    docs = _table(spark, sf_dir, "documents")
    return licences.scan_licences(docs, [docs["doc_id"]], "doc_id bigint")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of nearly the same bytes."""
    docs = _table(spark, sf_dir, "documents")
    placed = sharding.shard_by_bytes(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95 or more."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, tokenizer_file("word_bpe_49k.json"), [docs["doc_id"]], "doc_id bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that a document repeats from one with a smaller id."""
    docs = _table(spark, sf_dir, "documents")
    cleaned = passages.remove_repeats(docs, [docs["doc_id"]], "doc_id bigint")
    return cleaned.select("doc_id", F.explode("cuts").alias("cut")).select(
        "doc_id", F.col("cut.start").alias("start_byte"), F.col("cut.end").alias("end_byte"), F.col("cut.n_words").alias("n_words"), F.col("cut.kept_id").alias("kept_doc_id"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    ranks = byte_bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    decoded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, RANKS_PATTERN), ranks)
    return encoding_digests(decoded)


def encoding_digests(decoded: DataFrame) -> DataFrame:
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_remainder(docs, 4) != 2), "text", F.col("lang"))
    return language.predict(docs, model, [docs["doc_id"], _remainder(docs, 4) == 2], "doc_id bigint, held_out boolean")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats a benchmark item, with the item and the place."""
    return benchmark_leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text they decode to, as digests."""
    path, docs = tokenizer_file("piece_bpe_32k.model"), _table(spark, sf_dir, "documents")
    decoded = pieces.decode(pieces.encode(docs, path, [docs["doc_id"]], "doc_id bigint"), path)
    written = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector after ten rounds of eight centroids."""
    placed = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=CLUSTER_ROUNDS, dim=64, seed="3:")
    written = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written.cast("binary"), 256).alias("centroid_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's n-grams, and the ranks of the quarter drawn."""
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline at the top of the repository, one after the other."""
    sys.path[:0] = [] if _TOP in sys.path else [_TOP]
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_SQL = {
    "op4_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
""",
}


def _centroids_sql() -> str:
    """Each round as its own pair of tables, since a recursive query may not aggregate what it has made so far."""
    parts = ["""r AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM r ORDER BY h LIMIT {CLUSTERS}))"""]
    for i in range(CLUSTER_ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, vec_id, v, m % {CLUSTERS} AS cluster, m // {CLUSTERS} AS distance FROM (
        SELECT rid, any_value(vec_id) AS vec_id, any_value(r.v) AS v,
               min(list_sum(list_transform(r.v, lambda x, i: (x - c.v[i]) * (x - c.v[i])))::BIGINT * {CLUSTERS} + cluster) AS m
        FROM r CROSS JOIN c{i} c GROUP BY rid))""")
        if i < CLUSTER_ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT o.cluster, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM (
            SELECT cluster, place, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place)
        GROUP BY cluster) n ON n.cluster = o.cluster)""")
    last = f"a{CLUSTER_ROUNDS}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} a JOIN c{CLUSTER_ROUNDS} c ON c.cluster = a.cluster
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_licences, op3_sharding, op4_vectors, op5_token_counts, op6_simhash, op7_passages, op8_byte_bpe,
           op9_language, op10_benchmark_leaks, op11_pieces,
           op12_centroids, op13_importance, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op12_centroids": _centroids_sql()}
