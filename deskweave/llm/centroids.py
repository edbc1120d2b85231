"""Centroid clustering in whole numbers; the nearest centroid is found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .texts import column, tidy

#: Vectors searched at a time; each has a mark for every centroid.
CHUNK = 4096
#: Whole numbers beyond this are held at it.
LARGEST = 1 << 60
_LONG_MAX = (1 << 63) - 1


class Orchard:
    """Centroids with a list for each of all others by distance, nearest first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dim = centroids.shape
        #: Numbers up to which four times a squared distance fits 64 bits.
        self.fits = int(((1 << 60) // max(1, dim)) ** 0.5) // 4
        self._set(centroids if np.abs(centroids).max(initial=0) <= self.fits else centroids.astype(object))
        self.starts = np.arange(0, k, max(1, int(k**0.5)))

    def _set(self, centroids: np.ndarray) -> None:
        self.exact = centroids
        self.gaps = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        near = self.gaps.astype(object) if self.gaps.dtype == object else self.gaps.copy()
        np.fill_diagonal(near, -1)
        self.lists = np.argsort(near, axis=1, kind="stable")[:, 1:]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) for each vector; the smaller number if two are as near.

        A vector looks through the list of its nearest centroid so far, and changes to a nearer one's list
        as soon as it meets it.  It stops where a centroid is strictly further from the list's own than twice
        the vector's distance: that and all later ones are further from the vector.
        """
        if self.exact.dtype != object and np.abs(vectors).max(initial=0) > self.fits:
            self._set(self.centroids.astype(object))  # 64 bits are too few here
        vectors = vectors.astype(object) if self.exact.dtype == object else vectors
        found = [self._chunk(vectors[at : at + CHUNK]) for at in range(0, len(vectors), CHUNK)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])

    def _chunk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(vectors), len(self.exact)
        visited = np.zeros((n, k), bool)
        visited[:, self.starts] = True
        first = np.stack([((vectors - self.exact[c]) ** 2).sum(axis=1) for c in self.starts], axis=1)
        best = first.argmin(axis=1)
        own, distance = self.starts[best].copy(), first[np.arange(n), best]
        step, active = np.zeros(n, np.int64), np.arange(n if k > 1 else 0)
        while len(active):
            other = self.lists[own[active], step[active]]
            go_on = ~(self.gaps[own[active], other] > 4 * distance[active]).astype(bool)
            active, other = active[go_on], other[go_on]
            step[active] += 1
            new = ~visited[active, other]
            rows, met = active[new], other[new]
            visited[rows, met] = True
            apart = ((vectors[rows] - self.exact[met]) ** 2).sum(axis=1)
            nearer = ((apart < distance[rows]) | ((apart == distance[rows]) & (met < own[rows]))).astype(bool)
            rows, met = rows[nearer], met[nearer]
            own[rows], distance[rows], step[rows] = met, apart[nearer], 0
            active = active[step[active] < k - 1]
        return own, distance


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values.astype(np.float64)), -float(LARGEST), float(LARGEST)).astype(np.int64)


def _over_batches(search: Broadcast, dim: int, scale: float, work: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Orchard(search.value)
        for batch in batches:
            if batch.num_rows:
                vectors = whole(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                yield from work(batch, vectors, *index.nearest(vectors))
        yield from work(None, None, None, None)

    return tidy(run)


def _summed(search: Broadcast, dim: int, scale: float) -> Callable:
    """For each cluster the sums of a task's vectors, a row for each component."""
    sums: dict[int, list] = {}

    def add(batch: pa.RecordBatch | None, vectors: np.ndarray, own: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        if batch is None:
            if sums:
                rows = [(c, place, Decimal(int(x)), n) for c, (total, n) in sums.items() for place, x in enumerate(total)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()), strict=True)],
                                                 ["cluster", "place", "total", "n"])
            sums.clear()
            return
        by = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(own[by]) != 0]))
        # In halves of 32 bits, whose sums cannot overflow.
        high = np.add.reduceat((vectors >> 32)[by], first, axis=0).astype(object)
        low = np.add.reduceat((vectors & 0xFFFFFFFF)[by], first, axis=0).astype(object)
        for cluster, total, n in zip(own[by][first].tolist(), high * (1 << 32) + low, np.diff(np.append(first, len(own))).tolist(), strict=True):
            held = sums.setdefault(cluster, [np.zeros(dim, object), 0])
            held[0], held[1] = held[0] + total, held[1] + n

    return _over_batches(search, dim, scale, add)


def _assigned(search: Broadcast, dim: int, scale: float) -> Callable:
    def rows(batch: pa.RecordBatch | None, vectors: np.ndarray, own: np.ndarray, distance: np.ndarray) -> Iterator[pa.RecordBatch]:
        if batch is not None:
            held = pa.array([min(x, _LONG_MAX) for x in distance.tolist()] if distance.dtype == object else distance, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), held], ["id", "cluster", "distance"])

    return _over_batches(search, dim, scale, rows)


def kept_vectors(table: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows whose vector has ``dim`` components, none of them null or non-finite."""
    vector = column(table, vector_col)
    fit = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return table.select(column(table, id_col).alias("id"), vector.alias("vector")).where((F.size("vector") == dim) & F.col("vector").isNotNull() & fit)


def cluster_vectors(table: DataFrame, k: int, rounds: int, dim: int, seed: str, scale: float = 1024.0,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) for every vector that is kept.

    Kept are vectors of ``dim`` components, none null or non-finite; a component x counts as floor(scale * x)
    and all further arithmetic is exact.  The first ``k`` centroids are the kept vectors with the least
    sha256 of seed and id (a null id: of the seed alone; equal hashes: by the vector), in that order.  Each
    round assigns every vector to its nearest centroid - of several, the smallest number - and replaces
    centroids by the floored means of their vectors; one without vectors stays.  Then all are assigned once
    more.  centroid is the final one's components.

    A round is one pass over the table: tasks add up their vectors by cluster, and k x dim sums come to the
    driver, so that k is what bounds it.  Materialise vectors that are costly to make.  Repeated rows count
    each; fewer kept vectors than ``k`` make as many centroids; none, or an empty table, give no rows.
    Components beyond 2**60 after scaling are held there, and distances and sums at the largest long.
    """
    spark = table.sparkSession
    rows = kept_vectors(table, dim, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    firsts = rows.orderBy(hashed, "vector").limit(k).select("vector").collect()
    centroids = whole(np.array([r[0] for r in firsts], np.float64).reshape(-1, dim), scale)
    kind = dict(rows.dtypes)["id"]
    for _ in range(rounds if len(centroids) else 0):
        search = spark.sparkContext.broadcast(centroids)
        added = rows.select("vector").mapInArrow(_summed(search, dim, scale), "cluster int, place int, total decimal(38,0), n bigint")
        for r in added.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        search.destroy()
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid", "array<bigint>"))]).limit(0)
    search = spark.sparkContext.broadcast(centroids)
    placed = cut_lineage(rows.select("id", "vector").mapInArrow(_assigned(search, dim, scale), f"id {kind}, cluster int, distance bigint"))
    search.destroy()
    sums = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    inertia = min(sum(sums.values()), _LONG_MAX)
    described = spark.createDataFrame([(c, min(s, _LONG_MAX), inertia, centroids[c].tolist()) for c, s in sorted(sums.items())],
                                      "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    joined = placed.join(F.broadcast(described), "cluster")  # k rows at most
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """Lowercase hex sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
