"""Nearest sparse row over an inverted index whose commonest terms are columns of a matrix.

Queries and corpus are cut into blocks, as in ``neighbours``; two blocks meet in a group that builds the postings
of its rows, so that no pair is shuffled.  A few terms stand in so many rows that they bring together most pairs
that share a term at all: these are the columns of one matrix product.  Postings of all other terms are short and
are added to it.  Scores are taken in single precision for some queries at a time; pairs that may be the best of their query, by the
error that single precision can have, are scored exactly from their whole rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a block at most, and blocks of either side that there are at least, if they are not smaller than LEAST_BLOCK.
BLOCK, BLOCKS, LEAST_BLOCK = 32_768, 4, 1_024
#: Terms that are columns at most; only those that bring together at least every so-manieth pair of two blocks.
COLUMNS, COMMON = 512, 512
#: Scores, and postings beside them, that are held at a time; rows of the corpus that they are of at most.
CELLS, TOUCHED, STRIP = 1_000_000, 2_000_000, 4_096
DECIMALS = 6
#: Pairs whose whole rows are put side by side at a time.
PAIRS = 20_000
_ROUNDING = 1.1 * 10.0**-DECIMALS


def sparse_best(queries: DataFrame, corpus: DataFrame, *, query_id: str, corpus_id: str, bounded_terms: bool = False) -> DataFrame:
    """(query_id, corpus_id, similarity): the corpus row with the largest sparse dot product, the lower id among equal ones.

    Both sides carry ``terms`` and positive ``weights``, each term once in a row, and unique ids; they are
    written down, since they are read several times.  A query that shares no term with any corpus row gets
    no row back.  ``bounded_terms`` makes no difference any more: no table of terms is joined.
    """
    found = best_pairs(*_sides(queries, corpus, query_id, corpus_id), bounded_terms)
    return found.withColumnsRenamed({"q_id": query_id, "c_id": corpus_id if corpus_id != query_id else "hit_id"})


def _sides(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides, written down; of corpus rows that are alike, the one with the lowest id."""
    q = queries.select(F.col(query_id).alias("q_id"), F.col("terms").alias("q_terms"), F.col("weights").alias("q_weights"))
    c = corpus.groupBy(F.col("terms").alias("c_terms"), F.col("weights").alias("c_weights")).agg(F.min(corpus_id).alias("c_id"))
    return cut_lineage(q), cut_lineage(c.select("c_id", "c_terms", "c_weights"))


def best_pairs(q: DataFrame, c: DataFrame, bounded_terms: bool) -> DataFrame:
    scored = candidates(q, c, bounded_terms, best=True)
    order = Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), "c_id")
    return scored.withColumn("place", F.row_number().over(order)).filter("place = 1 AND similarity > 0").select("q_id", "c_id", "similarity")


def candidates(q: DataFrame, c: DataFrame, bounded_terms: bool, best: bool = False) -> DataFrame:
    """(q_id, c_id, similarity): pairs that may be the best of a query in a block, or only the ``best`` one of a query in each block.

    The best one of each query is among them.
    """
    blocks = [max(-(-n // BLOCK), min(BLOCKS, -(-n // LEAST_BLOCK)), 1) for n in (q.count(), c.count())]
    numbers = [F.sequence(F.lit(0), F.lit(n - 1)) for n in blocks]
    left = q.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(blocks[0])).cast("int")).withColumn("cb", F.explode(numbers[1]))
    right = c.withColumn("cb", F.pmod(F.xxhash64("c_id"), F.lit(blocks[1])).cast("int")).withColumn("qb", F.explode(numbers[0]))
    kinds = dict(q.dtypes)["q_id"], dict(c.dtypes)["c_id"]
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        _block_scorer(best), f"q_id {kinds[0]}, c_id {kinds[1]}, similarity double")


def _block_scorer(best: bool):
    """Of the pairs of two blocks, those that may be the best of their query, scored exactly."""
    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", asked.schema.field("q_id").type), ("c_id", held.schema.field("c_id").type), ("similarity", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        asked, held = asked.combine_chunks(), held.sort_by("c_id").combine_chunks()  # lower ids first
        found = [*_near(asked, held)]
        row, other, sims = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64 if i < 2 else float) for i in range(3))
        if best:
            order = np.lexsort((other, -sims, row))
            order = order[np.concatenate([[True], np.diff(row[order]) != 0])] if len(order) else order
            row, other, sims = row[order], other[order], sims[order]
        return pa.table([asked.column("q_id").take(pa.array(row)), held.column("c_id").take(pa.array(other)), pa.array(sims, pa.float64())], schema=schema)

    return score


def _near(asked: pa.Table, held: pa.Table):
    """(rows of ``asked``, rows of ``held``, exact scores), of some queries after the other."""
    n, m = asked.num_rows, held.num_rows
    a_row, a_term, a_weight = _entries(asked.column("q_terms").chunk(0), asked.column("q_weights").chunk(0))
    h_row, h_term, h_weight = _entries(held.column("c_terms").chunk(0), held.column("c_weights").chunk(0))
    # Only terms of both sides bring rows together; they are numbered.
    names = np.intersect1d(a_term, h_term)
    if not len(names):
        return
    (a_row, a_term, a_weight), (h_row, h_term, h_weight) = _numbered(names, a_row, a_term, a_weight), _numbered(names, h_row, h_term, h_weight)
    met = np.bincount(a_term, minlength=len(names)) * np.bincount(h_term, minlength=len(names))
    common = np.argsort(-met, kind="stable")[:COLUMNS]
    common = common[met[common] * COMMON >= n * m]
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    # A strip of the rows held, so that the scores of a part stay near the processor from one step to the next.
    strips = [slice(at, min(m, at + STRIP)) for at in range(0, m, STRIP)]
    width = min(m, STRIP)
    right = _dense(column, h_row, h_term, h_weight, m, len(common))
    rare = column[h_term] < 0
    key = (h_row // STRIP * len(names) + h_term)[rare]
    by = np.argsort(key, kind="stable")
    p_row, p_weight = (x[rare][by] for x in (h_row % STRIP, h_weight))
    start = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(strips) * len(names)))])
    up_to = np.cumsum(np.bincount(a_row, np.bincount(h_term[rare], minlength=len(names))[a_term], minlength=n))  # nothing for a column
    # All weights are positive, so each shared term adds no more than one rounding to the error of a sum.
    share = 2.0**-23 * (int(np.bincount(a_row).max()) + 8)
    # New memory for each part would take as long as its scores.
    most = min(n, max(1, CELLS // width))
    held_scores, held_marks = np.empty(most * width, np.float32), np.empty(-(-most * width // 8) * 8, bool)
    low = 0
    while low < n:
        high = max(low + 1, min(low + most, n, int(np.searchsorted(up_to, (up_to[low - 1] if low else 0) + TOUCHED, side="right"))))
        some = slice(int(np.searchsorted(a_row, low)), int(np.searchsorted(a_row, high)))
        left = _dense(column, a_row[some] - low, a_term[some], a_weight[some], high - low, len(common))
        best, found = np.zeros(high - low, np.float32), []
        for number, strip in enumerate(strips):
            wide = strip.stop - strip.start
            scores = held_scores[: (high - low) * wide].reshape(high - low, wide)
            np.matmul(left, right[strip].T, out=scores)
            begin = start[number * len(names) + a_term[some]]
            counts = start[number * len(names) + a_term[some] + 1] - begin
            place = np.repeat(begin - (np.cumsum(counts) - counts), counts)
            place += np.arange(len(place))
            cell, value = np.repeat((a_row[some] - low) * wide, counts), np.repeat(a_weight[some], counts)
            cell += p_row[place]
            value *= p_weight[place]
            np.add.at(scores.reshape(-1), cell, value)
            top = scores.max(axis=1)
            np.maximum(best, top, out=best)
            floor = _floor(best, share)
            hot = np.flatnonzero(top >= floor)  # for most queries, an earlier strip has a better row
            row, other = _reached(scores[hot], floor[hot], held_marks)
            found.append((hot[row], other + strip.start, scores[hot[row], other]))
        row, other, value = (np.concatenate(x) for x in zip(*found))
        near = value >= _floor(best, share)[row]
        row, other = row[near], other[near]
        for at in range(0, len(row), PAIRS):  # whole rows of a few pairs at a time
            a, b = row[at : at + PAIRS] + low, other[at : at + PAIRS]
            batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(asked.column(x).chunk(0).take(pa.array(a)) for x in ("q_terms", "q_weights")),
                                                *(held.column(x).chunk(0).take(pa.array(b)) for x in ("c_terms", "c_weights"))], ["a", "b", "c", "d", "e", "f"])
            yield a, b, _dot(batch)
        low = high


def _floor(best: np.ndarray, share: float) -> np.ndarray:
    """What a score reaches at least that may be its row's best one, by the error of single precision."""
    return np.maximum(best * np.float32(1 - 2 * share) - np.float32(_ROUNDING), np.finfo(np.float32).tiny)


def _reached(scores: np.ndarray, floor: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that reach their row's floor; few do, so marks are looked at by eights first."""
    cells = scores.size
    marks = marks[: -(-cells // 8) * 8]
    marks[cells:] = False
    np.greater_equal(scores, floor[:, None], out=marks[:cells].reshape(scores.shape))
    eights = np.flatnonzero(marks.view(np.uint64))
    place = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(place[marks[place]], scores.shape[1])


def _numbered(names: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose term is among the sorted ``names``, with its place there."""
    place = np.minimum(np.searchsorted(names, term), len(names) - 1)
    known = names[place] == term
    return row[known], place[known], weight[known].astype(np.float32)


def _dense(column: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """Weights of the common terms as a matrix."""
    held = column[term] >= 0
    out = np.zeros((n, width), np.float32)
    out[row[held], column[term[held]]] = weight[held]
    return out


def _entries(lists: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)


def _dot(batch: pa.RecordBatch) -> np.ndarray:
    """Rounded sparse dot product of the rows' two sides."""
    row, term, weight = _entries(batch.column(2), batch.column(3))
    other, held, value = _entries(batch.column(4), batch.column(5))
    # Terms as small numbers, so that row and term make one key.
    names, number = np.unique(np.concatenate([term, held]), return_inverse=True)
    left, right = row * len(names) + number[: len(term)], other * len(names) + number[len(term):]
    order = np.argsort(right, kind="stable")
    place = np.minimum(np.searchsorted(right[order], left), max(0, len(right) - 1))
    hit = right[order][place] == left if len(right) else np.zeros(len(left), bool)
    sums = np.bincount(row[hit], weight[hit] * value[order][place[hit]], minlength=batch.num_rows)
    return np.round(sums, DECIMALS) + 0.0
