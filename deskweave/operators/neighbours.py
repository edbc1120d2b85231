"""Exact top-k neighbours as a blocked join.

Queries and corpus are cut into blocks of bounded size per search scope, and
every (query block, corpus block) pair that has to meet becomes one small
group.  A group is scored with one numpy product and hands back only the k best
rows per query, so neither pairs nor whole scopes ever travel.  A scope that
holds most of the data simply has more blocks.

Shuffled rows are |Q||C| / corpus_block + |Q||C| / query_block, hence the large
default blocks; one block pair of 384 floats needs about 0.4 GB in its task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

GLOBAL = "*"
DECIMALS = 6
_MAX_CELLS = 4_000_000
_MIN_BLOCK = 2048
_GROUP = 128

# A kernel prepares a corpus block and returns a scorer of query chunks.
Kernel = Callable[[pa.Table], Callable[[pa.Table], np.ndarray]]


def knn(queries: DataFrame, corpus: DataFrame, k: int, *, scopes: Column | None = None,
        corpus_scope: Column | None = None, taxonomy: Sequence[str] = (), query_id: str = "id",
        corpus_id: str = "vec_id", vector: str = "embedding", query_block: int = 32768,
        corpus_block: int = 32768, prune: bool = False) -> DataFrame:
    """The ``k`` corpus rows with the largest dot product per query.

    ``scopes`` is an array column of scope names on the query side.  Names
    outside ``taxonomy`` are ignored; when the remaining scopes hold fewer than
    ``k`` rows the whole corpus is searched.  Ties go to the higher corpus id.
    Returns (query_id, corpus_id, similarity, rank).

    ``prune`` is for a stored corpus that is partitioned by ``corpus_scope``, a column as it stands: folders
    of scopes that no query searches are not read (dynamic partition pruning), unless one searches everything.
    All its rows hold vectors then: they are counted by their scopes alone, without reading any vector.
    """
    wanted = scopes if scopes is not None else F.array().cast("array<string>")
    scope = corpus_scope if corpus_scope is not None else F.lit(GLOBAL)
    q = queries.filter(F.col(vector).isNotNull()).select(
        F.col(query_id).alias("q_id"), F.col(vector).alias("q_vec"), wanted.alias("wanted"))
    c = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(corpus_id).alias("c_id"), F.col(vector).alias("c_vec"), scope.alias("scope"))
    stored = corpus.select(scope.alias("scope")) if prune else None
    found = _blocked_top_k(q, c, k, taxonomy, _dense_kernel, query_block, corpus_block, ties_high=True, stored=stored)
    return found.withColumnsRenamed({"q_id": query_id, "c_id": corpus_id if corpus_id != query_id else "hit_id"})


def _blocked_top_k(q: DataFrame, c: DataFrame, k: int, taxonomy: Sequence[str], kernel: Kernel, query_block: int,
                   corpus_block: int, ties_high: bool, stored: DataFrame | None = None) -> DataFrame:
    payload_q = [n for n in q.columns if n not in ("wanted",)]
    payload_c = [n for n in c.columns if n not in ("scope",)]
    known = F.array(*[F.lit(t) for t in taxonomy]).cast("array<string>")

    # Rows per scope and in total: at most one entry per taxonomy name, plus two.
    rows = c if stored is None else stored
    sizes = _size_map(rows.select(F.when(F.col("scope").isin(*taxonomy), F.col("scope")).otherwise("").alias("scope"))
                      if taxonomy else rows.select(F.lit("").alias("scope")))

    valid = F.array_intersect(F.coalesce(F.col("wanted"), known), known) if taxonomy else known
    # The map is bound to a column first: lambdas may not contain subqueries.
    counted = q.withColumn("_sizes", sizes).withColumn("_valid", valid)
    reachable = F.aggregate("_valid", F.lit(0).cast("long"),
                            lambda acc, s: acc + F.coalesce(F.try_element_at(F.col("_sizes"), s), F.lit(0)))
    searched = F.when(reachable >= k, F.col("_valid")).otherwise(F.array(F.lit(GLOBAL)))
    scoped = counted.select(*payload_q, F.explode(searched).alias("s"))
    asked = _asked_map(counted.select(F.explode(searched).alias("scope")))
    if stored is not None:
        c = _only_asked(c, stored, counted.select(F.explode(searched).alias("scope")))

    # Smaller corpora get smaller blocks, so that every core has some to score.
    cores = q.sparkSession.sparkContext.defaultParallelism
    total = F.try_element_at(sizes, F.lit(GLOBAL))
    block = F.greatest(F.lit(min(_MIN_BLOCK, corpus_block)), F.least(F.lit(corpus_block), F.ceil(total / (2 * cores))))
    corpus_blocks = F.ceil(F.coalesce(F.try_element_at(sizes, F.col("s")), F.lit(0)) / block).cast("long")
    query_blocks = F.ceil(F.coalesce(F.try_element_at(asked, F.col("s")), F.lit(0)) / query_block).cast("long")

    homes = F.array_distinct(F.array(F.col("scope"), F.lit(GLOBAL)))
    q_cells = (
        scoped.withColumn("qb", F.pmod(F.xxhash64("q_id"), query_blocks))
        .withColumn("cb", F.explode(_upto(corpus_blocks)))
    )
    c_cells = (
        c.select(*payload_c, F.explode(homes).alias("s"))
        .withColumn("_nq", query_blocks).filter(F.col("_nq") > 0)
        .withColumn("cb", F.pmod(F.xxhash64("c_id"), corpus_blocks))
        .withColumn("qb", F.explode(_upto(F.col("_nq")))).drop("_nq")
    )
    ids = f"q_id {q.schema['q_id'].dataType.simpleString()}, c_id {c.schema['c_id'].dataType.simpleString()}"
    partial = (
        q_cells.groupBy("s", "qb", "cb").cogroup(c_cells.groupBy("s", "qb", "cb"))
        .applyInArrow(_block_scorer(kernel, k, ties_high), f"{ids}, similarity double")
    )
    tie = F.col("c_id").desc() if ties_high else F.col("c_id").asc()
    best = Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), tie)
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _only_asked(c: DataFrame, stored: DataFrame, searched: DataFrame) -> DataFrame:
    """Corpus rows in scopes that are searched; a broadcast of at most one row for each scope filters the scan's partitions."""
    named = F.coalesce(F.col("scope"), F.lit(""))
    asked = searched.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    everything = stored.select(named.alias("scope")).distinct().withColumn("all", F.lit(GLOBAL)).join(
        asked.select(F.col("scope").alias("all")), "all", "left_semi").select("scope", F.lit(1).cast("long").alias("n"))
    needed = asked.unionByName(everything).groupBy(F.col("scope").alias("asked_scope")).agg(F.sum("n").alias("n"))
    # Written down, so that the scan's filter and the join are seen to use the same few rows.
    return c.join(F.broadcast(cut_lineage(needed).filter("n > 0")), named == F.col("asked_scope"), "left_semi")


def _size_map(scopes: DataFrame) -> Column:
    """Scalar map scope -> row count, with the total under the global scope."""
    counted = scopes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("scope", "n")))
    total = F.create_map(F.lit(GLOBAL), F.coalesce(F.sum("n"), F.lit(0)))
    return counted.agg(F.map_concat(entries, total).alias("m")).scalar()


def _asked_map(scopes: DataFrame) -> Column:
    """Scalar map searched scope -> number of queries."""
    counted = scopes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.map_from_entries(F.collect_list(F.struct("scope", "n"))).alias("m")).scalar()


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _block_scorer(kernel: Kernel, k: int, ties_high: bool):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", left.schema.field("q_id").type), ("c_id", right.schema.field("c_id").type),
                            ("similarity", pa.float64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        # Preferred ids first, so the leftmost of equal scores wins.
        right = right.sort_by([("c_id", "descending" if ties_high else "ascending")])
        parts = []
        step = max(1, _MAX_CELLS // right.num_rows)
        scores_of = kernel(right)
        for start in range(0, left.num_rows, step):
            chunk = left.slice(start, step)
            rows, cols, sims = _best_columns(scores_of(chunk), k)
            parts.append(pa.table(
                [chunk.column("q_id").take(pa.array(rows)), right.column("c_id").take(pa.array(cols)), pa.array(sims)],
                schema=schema))
        return pa.concat_tables(parts)

    return score


def _best_columns(sims: np.ndarray, k: int, positive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the k largest rounded scores per row, leftmost first among equals.

    The k-th largest maximum of column groups is no larger than the k-th score,
    so only the few scores above it (less one rounding step) are rounded and
    sorted.  ``positive`` leaves out scores of zero, which most sparse rows have.
    """
    n = sims.shape[1]
    if k < n:
        groups = n // _GROUP
        tops = sims[:, :groups * _GROUP].reshape(-1, groups, _GROUP).max(axis=2) if groups > k else sims
        kth = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k]
        floor = kth - 1.01 * 10.0**-DECIMALS
        rows, cols = np.nonzero(sims >= (np.maximum(floor, np.finfo(float).tiny) if positive else floor)[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(sims.shape))
    scores = np.round(sims[rows, cols], DECIMALS) + 0.0
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    keep = np.arange(rows.size) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], scores[keep]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, -1)


def _dense_kernel(corpus: pa.Table) -> Callable[[pa.Table], np.ndarray]:
    matrix = _matrix(corpus.column("c_vec"), corpus.num_rows).T.copy()
    return lambda chunk: _matrix(chunk.column("q_vec"), chunk.num_rows) @ matrix
