"""A stored index of vectors by their nearest pivot, and exact search that skips what cannot hold a better row.

The corpus is cut into blocks: per search scope the rows nearest to one pivot, in rings by their angle to it.
A block knows its least and largest angle and norm, which bound the dot product of all its rows with a query.
A query scores the blocks with the highest bounds first, until they hold enough rows, and then meets only
blocks whose bound reaches the k-th score found there.  On vectors that gather in groups that is a small part
of all blocks; on vectors that are spread evenly it is nearly all, and ``neighbours.knn`` is as good.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..sources.tables import table_exists
from .neighbours import DECIMALS, _best_columns, _matrix

#: Rows for each pivot, and the most pivots there are.
ROWS_PER_PIVOT, MOST_PIVOTS = 256, 1024
#: Rows of a cell for each ring, and the most rings there are.
ROWS_PER_RING, MOST_RINGS = 128, 16
#: Rows that are scored at a time at most, and queries that meet them.
SLICE_ROWS, QUERY_ROWS = 32_768, 8_192
#: Shelves of blocks side by side into which a corpus is cut at least; more if they would be too large.
SHELVES = 16
#: Blocks up to which the table of bounds is handed to the tasks; pivots, rings and scopes bound their number.
MOST_BLOCKS = 1_000_000
#: Visited blocks up to which they are broadcast, and scopes or cells up to which a scan's filter names them.
BROADCAST_BLOCKS, NAMED_AT_MOST = 200_000, 1_000
_DECIMALS_MARGIN = 2e-6
# Scopes are stored behind it, so that an empty one has a folder and none is read as a number.
_SCOPE = "scope:"
_CHUNK_CELLS = 4_000_000
# Rows found beside twice k for each query, after which the best are taken.
_CUT_ROWS = 100_000
_BLOCKS = ("scope", "cell", "ring")


def _units(values: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, norms); a zero vector has no direction."""
    flat = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.where(norms > 0, norms, 1.0)[:, None], norms


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Of a bounded sample of directions, rows that lie far from one another: each next one is the furthest from those before."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


@dataclass(frozen=True)
class PivotIndex:
    """``rows``: scope, cell, ring, slice, c_id, c_vec; ``blocks``: for each block its angles, norms, rows and slices; ``pivots``: directions."""

    rows: DataFrame
    blocks: pa.Table
    pivots: np.ndarray
    corpus_id: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, corpus: DataFrame | None = None, *, corpus_id: str = "vec_id", vector: str = "embedding",
             scope: Column | None = None, seed: int = 7) -> PivotIndex:
        """The index stored at ``path``; built from ``corpus`` if it is not there.

        Rows without a vector are left out; vectors are finite and of one length.  The rows are partitioned
        by scope (a null one counts as empty), and within it files keep cells together.
        """
        if not table_exists(spark, f"{path}/blocks"):
            if corpus is None:
                raise ValueError(f"no index at {path}")
            _build(spark, path, corpus, corpus_id, vector, scope, seed)
        held = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
        pivots, schema = np.array([r["pivot"] for r in held]), T.StructType.fromJson(json.loads(held[0]["kinds"]))
        blocks = spark.read.parquet(f"{path}/blocks")
        if blocks.count() > MOST_BLOCKS:
            raise ValueError("too many scopes for one table of bounds")
        return cls(spark.read.schema(schema).parquet(f"{path}/rows"), blocks.orderBy(*_BLOCKS).toArrow(), pivots, corpus_id)

    def search(self, queries: DataFrame, k: int, *, query_id: str = "id", vector: str = "embedding", scopes: Column | None = None,
               taxonomy: Sequence[str] = ()) -> Found:
        """The ``k`` rows with the largest dot product per query, as ``neighbours.knn`` gives them; higher ids first among equal scores.

        ``scopes``: as there, names outside ``taxonomy`` are ignored, and where the others hold fewer than
        ``k`` rows everything is searched.  Queries without a vector have no rows; ids of queries are unique.
        """
        wanted = scopes if scopes is not None else F.array().cast("array<string>")
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("q_id"), F.col(vector).alias("q_vec"), wanted.alias("wanted"))
        if not self.blocks.num_rows:
            empty = self.rows.sparkSession.createDataFrame([], f"{query_id} {asked.schema['q_id'].dataType.simpleString()}, "
                                                           f"{self._hit(query_id)} {self.rows.schema['c_id'].dataType.simpleString()}, similarity double, rank int")
            return Found(empty, 0, 0)
        plan = _Plan(self.blocks, self.pivots, k, tuple(taxonomy))
        # No bound is known yet: the best blocks, until they hold k rows.
        first = plan.visits(asked.withColumn("floor", F.lit(None).cast("double")))
        near, met_first = self._meet(first, plan, k)
        near = cut_lineage(near)
        floor = _kth(near, k)
        rest = plan.visits(asked.join(floor, "q_id"))
        far, met_rest = self._meet(rest, plan, k)
        best = Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), F.col("c_id").desc())
        ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return Found(ranked.withColumnsRenamed({"q_id": query_id, "c_id": self._hit(query_id)}), met_first + met_rest, self.blocks.num_rows)

    def _hit(self, query_id: str) -> str:
        return self.corpus_id if self.corpus_id != query_id else "hit_id"

    def _meet(self, visits: DataFrame, plan: _Plan, k: int) -> tuple[DataFrame, int]:
        """Best rows of each query in the blocks it visits, and the number of visits."""
        spark = visits.sparkSession
        counts = {r["shelf"]: (r["n"], r["met"]) for r in visits.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("met")).alias("met")).collect()}
        table = self.blocks.to_pylist()
        parts = {shelf: -(-n // QUERY_ROWS) for shelf, (n, _) in counts.items()}
        met = spark.createDataFrame([(*[table[b][c] for c in _BLOCKS], b, shelf, parts[shelf]) for b, shelf in enumerate(plan.shelf.tolist()) if shelf in parts],
                                    "scope string, cell int, ring int, block int, shelf int, parts int")
        shelves = spark.createDataFrame([(shelf, n, int(plan.slices[plan.shelf == shelf].max())) for shelf, n in parts.items()], "shelf int, parts int, slices int")
        met = F.broadcast(met) if met.count() <= BROADCAST_BLOCKS else met
        # Only what is visited is read: scopes are folders, and files keep the rows of a cell together.
        rows = self.rows
        for name in ("scope", "cell"):
            visited = sorted({table[b][name] for b, shelf in enumerate(plan.shelf.tolist()) if shelf in parts})
            if len(visited) <= NAMED_AT_MOST:
                rows = rows.filter(F.col(name).isin(visited))
        rows = rows.join(met, list(_BLOCKS)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        q = visits.join(F.broadcast(shelves), "shelf").withColumn("part", F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int"))
        q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        ids = f"q_id {visits.schema['q_id'].dataType.simpleString()}, c_id {self.rows.schema['c_id'].dataType.simpleString()}"
        keys = ["shelf", "slice", "part"]
        scored = (q.select("q_id", "q_vec", "floor", "met", *keys).groupBy(*keys).cogroup(rows.select("c_id", "c_vec", "block", *keys).groupBy(*keys))
                  .applyInArrow(_shelf_scorer(k), f"{ids}, similarity double"))
        return scored, sum(n for _, n in counts.values())


@dataclass(frozen=True)
class Found:
    """``hits``: (query id, corpus id, similarity, rank); how many (query, block) pairs were scored, and the blocks there are for each query."""

    hits: DataFrame
    visited: int
    blocks: int


def _kth(near: DataFrame, k: int) -> DataFrame:
    """(q_id, floor): the k-th best score so far; a query with fewer rows has none."""
    order = Window.partitionBy("q_id").orderBy(F.col("similarity").desc())
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("q_id", F.col("similarity").alias("floor"))


class _Plan:
    """Which blocks a query visits."""

    def __init__(self, blocks: pa.Table, pivots: np.ndarray, k: int, taxonomy: tuple[str, ...]):
        self.k, self.pivots = k, pivots
        self.cell, self.rows = blocks.column("cell").to_numpy(), blocks.column("n").to_numpy()
        self.slices = blocks.column("slices").to_numpy()
        # Blocks side by side share a shelf, to which a query travels once; one that is scored in slices has its own.
        room, self.shelf, shelf, held = max(1, min(SLICE_ROWS, -(-int(self.rows.sum()) // SHELVES))), np.zeros(len(self.rows), np.int32), 0, 0
        for b, (n, slices) in enumerate(zip(self.rows.tolist(), self.slices.tolist(), strict=True)):
            if held and (held + n > room or slices > 1):
                shelf, held = shelf + 1, 0
            self.shelf[b], held = shelf, held + n if slices == 1 else room
        self.low, self.high, self.least, self.most = (blocks.column(c).to_numpy() for c in ("low", "high", "least_norm", "most_norm"))
        names = blocks.column("scope").to_pylist()
        self.inside = {t: np.array([n == _SCOPE + t for n in names], bool) for t in taxonomy}

    def _allowed(self, wanted: list[str] | None) -> np.ndarray | None:
        valid = list(self.inside) if wanted is None else [s for s in dict.fromkeys(wanted) if s in self.inside]
        held = np.any([self.inside[s] for s in valid], axis=0) if valid else None
        return held if held is not None and self.rows[held].sum() >= self.k else None

    def _bounds(self, unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """For each query and block, what no row of the block can exceed."""
        to_pivot = np.arccos(np.clip(unit @ self.pivots.T, -1.0, 1.0))[:, self.cell]
        apart = np.maximum(0.0, np.maximum(to_pivot - self.high, self.low - to_pivot))
        cosine = np.cos(np.minimum(apart, np.pi))
        return norm[:, None] * np.where(cosine >= 0, cosine * self.most, cosine * self.least) + 1e-7 * norm[:, None] * self.most

    def visits(self, asked: DataFrame) -> DataFrame:
        """(q_id, q_vec, floor, shelf, met): the first blocks of queries without a floor, and all other blocks that may reach it of those with one."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, _CHUNK_CELLS // len(self.cell))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    row, block = self._chosen(part)
                    if not len(row):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(self.shelf[block]) != 0)]))
                    offsets = np.append(first, len(row)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(row[first])), part.column(1).take(pa.array(row[first])), part.column(3).take(pa.array(row[first])),
                        pa.array(self.shelf[block[first]]), pa.ListArray.from_arrays(offsets, pa.array(block.astype(np.int32)))], ["q_id", "q_vec", "floor", "shelf", "met"])

        kinds = dict(asked.dtypes)
        return asked.select("q_id", "q_vec", "wanted", "floor").mapInArrow(run, f"q_id {kinds['q_id']}, q_vec {kinds['q_vec']}, floor double, shelf int, met array<int>")

    def _chosen(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, block), in this order, of the blocks that the queries of a batch visit."""
        bounds = self._bounds(*_units(part.column(1), part.num_rows))
        for i, wanted in enumerate(part.column(2).to_pylist()):
            allowed = self._allowed(wanted)
            if allowed is not None:
                bounds[i, ~allowed] = -np.inf
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, before < self.k, axis=1)
        floor = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        wanted = np.where(np.isnan(floor)[:, None], first, ~first & (bounds >= (floor - _DECIMALS_MARGIN)[:, None]))
        return np.nonzero(wanted & (bounds > -np.inf))


def _shelf_scorer(k: int):
    """The best rows of each query among those of the blocks of a shelf that it visits."""
    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("q_id", asked.schema.field("q_id").type), ("c_id", held.schema.field("c_id").type), ("similarity", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by([("block", "ascending"), ("c_id", "descending")]).combine_chunks()  # preferred ids first
        asked = asked.combine_chunks()
        corpus, queries = _matrix(held.column("c_vec"), held.num_rows), _matrix(asked.column("q_vec"), asked.num_rows)
        blocks, begin = np.unique(held.column("block").to_numpy(), return_index=True)
        end = np.append(begin[1:], held.num_rows)
        lists = asked.column("met").combine_chunks()
        visitor, visited = np.repeat(np.arange(asked.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        by = np.argsort(visited, kind="stable")
        visitor, visited = visitor[by], visited[by]
        best, parts, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        # What is below the k-th score known so far, here or from the first blocks, need not be ranked.
        floor = np.nan_to_num(asked.column("floor").to_numpy().astype(np.float64), nan=-np.inf)
        most = 2 * k * asked.num_rows + _CUT_ROWS
        for block, low, high in zip(blocks.tolist(), begin.tolist(), end.tolist(), strict=True):
            some = visitor[np.searchsorted(visited, block) : np.searchsorted(visited, block, side="right")]
            for at in range(0, len(some), max(1, _CHUNK_CELLS // (high - low))):
                rows = some[at : at + max(1, _CHUNK_CELLS // (high - low))]
                sims = queries[rows] @ corpus[low:high].T
                if np.isneginf(floor[rows]).any():
                    row, col, sims = _best_columns(sims, k)
                else:
                    row, col = np.nonzero(sims >= (floor[rows] - _DECIMALS_MARGIN)[:, None])
                    sims = np.round(sims[row, col], DECIMALS) + 0.0
                parts.append((rows[row], low + col, sims))
                waiting += len(row)
                if waiting > most:
                    best, parts, waiting = _cut(_joined([best, *parts]), held, k), [], 0
                    last = np.searchsorted(best[0], np.arange(asked.num_rows), side="right") - 1
                    full = np.bincount(best[0], minlength=asked.num_rows) == k
                    floor[full] = np.maximum(floor[full], best[2][last[full]])
        row, col, sims = _cut(_joined([best, *parts]), held, k)
        return pa.table([asked.column("q_id").take(pa.array(row)), held.column("c_id").take(pa.array(col)), pa.array(sims)], schema=schema)

    return score


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _cut(found: tuple[np.ndarray, np.ndarray, np.ndarray], held: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, the higher id first among equal scores."""
    preferred = np.empty(held.num_rows, np.int64)
    preferred[pc.array_sort_indices(held.column("c_id").combine_chunks(), order="descending").to_numpy()] = np.arange(held.num_rows)
    row, col, sims = found
    order = np.lexsort((preferred[col], -sims, row))
    row, col, sims = row[order], col[order], sims[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], sims[keep]


def _build(spark: SparkSession, path: str, corpus: DataFrame, corpus_id: str, vector: str, scope: Column | None, seed: int) -> None:
    named = F.concat(F.lit(_SCOPE), F.coalesce(scope.cast("string"), F.lit("")) if scope is not None else F.lit(""))
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(corpus_id).alias("c_id"), F.col(vector).alias("c_vec"), named.alias("scope"))
    n = rows.count()
    wanted = max(1, min(MOST_PIVOTS, n // ROWS_PER_PIVOT))
    # A sample of a few rows for each pivot, by a hash of the id, so that it is the same each time.
    part = F.pmod(F.xxhash64("c_id", F.lit(seed)), F.lit(1 << 30))
    drawn = rows.filter(part < min(1 << 30, int((1 << 30) * min(1.0, 8 * wanted / max(1, n))))).orderBy(part, "c_id").limit(4 * wanted).select("c_vec").toArrow()
    sample = _units(drawn.column(0), drawn.num_rows)[0] if drawn.num_rows else np.zeros((0, 1))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    pivots = choose_pivots(sample, wanted) if len(sample) else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, norm = _units(batch.column(1), batch.num_rows)
            close = unit @ (pivots if pivots is not None else np.zeros((1, unit.shape[1]))).T
            cell = close.argmax(axis=1)
            angle = np.arccos(np.clip(close[np.arange(len(cell)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm)], [*batch.schema.names, "cell", "angle", "norm"])

    placed = rows.mapInArrow(assign, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int, angle double, norm double")
    shares = F.array(*[F.lit(i / MOST_RINGS) for i in range(1, MOST_RINGS)])
    cells = cut_lineage(placed.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("held"), F.percentile_approx("angle", shares, F.lit(1000)).alias("edges")))
    # Every so many of the sixteen parts of equal rows make a ring; a large ring is scored in slices.
    rings = F.greatest(F.lit(1), F.least(F.lit(MOST_RINGS), F.floor(F.col("held") / ROWS_PER_RING))).cast("int")
    slices = F.ceil(F.col("held") / F.col("rings") * 2 / SLICE_ROWS).cast("int")
    cells = cells.withColumn("rings", rings).withColumn("slices", F.greatest(F.lit(1), slices))
    ring = F.floor(F.size(F.filter("edges", lambda e: e < F.col("angle"))) * F.col("rings") / MOST_RINGS).cast("int")
    cut = (placed.join(F.broadcast(cells) if cells.count() <= MOST_BLOCKS // MOST_RINGS else cells, ["scope", "cell"])
           .withColumn("ring", ring).withColumn("slice", F.pmod(F.xxhash64("c_id", F.lit(3)), F.col("slices")).cast("int")))
    stored = cut.select("c_id", "c_vec", "cell", "ring", "slice", "slices", "angle", "norm", "scope")
    (stored.repartition("scope", "cell", "ring", "slice").sortWithinPartitions("scope", "cell", "ring", "slice")
     .write.mode("overwrite").partitionBy("scope").parquet(f"{path}/rows"))
    spark.createDataFrame([(i, p.tolist(), stored.schema.json()) for i, p in enumerate(pivots if pivots is not None else np.zeros((1, 1)))],
                          "cell int, pivot array<double>, kinds string").write.mode("overwrite").parquet(f"{path}/pivots")
    # Last, since this is what says that the index is whole.
    (spark.read.schema(stored.schema).parquet(f"{path}/rows").groupBy(*_BLOCKS).agg(
        F.count(F.lit(1)).alias("n"), F.first("slices").alias("slices"), F.min("angle").alias("low"), F.max("angle").alias("high"),
        F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm")).coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks"))
