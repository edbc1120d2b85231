"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .components import connected_components
from .texts import column, forest

#: Hashes of one bit each that make up a pass's sort key.
KEY_BITS = 60
#: Vectors before it, in the order of a pass, that a vector is compared with at least.
WINDOW = 256
#: Chance that a pair exactly at the threshold may be missed by all passes.
MISSED = 0.002
#: Passes made again over vectors that stand crowded.
MORE_PASSES = 12
#: Places of a pass's order in a chunk, besides the window before it.
CHUNK = 4096
#: Vectors of a component that are compared with each other at a time.
PIECE = 1024


def passes_for(n: int, threshold: float, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has been neighbours in one of them, but for a chance ``missed``.

    A random hyperplane parts two vectors with a chance of their angle over pi; in sorted order they are
    within the window once they agree on as many leading bits as leave about a window of vectors.
    """
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = max(1.0, math.log2(max(2, n) / window) + 1)
    return max(4, math.ceil(math.log(missed) / math.log1p(-min(0.999, agree**bits))))


def _unit(table: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = table.combine_chunks() if isinstance(table, pa.ChunkedArray) else table
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no over- or underflow in the squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _sort_keys(distinct: DataFrame, dim: int, passes: int, seed: int) -> DataFrame:
    """(node, vector, keys): for each pass, the signs of random projections put together into one number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((passes, dim, KEY_BITS))
        place = np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(batch.column(1), dim)
            keys = np.stack([(unit @ planes[p] > 0) @ place for p in range(passes)], axis=1)
            offsets = np.arange(0, keys.size + 1, passes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, keys.ravel())], ["node", "vector", "keys"])

    kind = dict(distinct.dtypes)["vector"]
    return distinct.select("node", "vector").mapInArrow(run, f"node bigint, vector {kind}, keys array<bigint>")


def _placed(keyed: DataFrame, window: int) -> DataFrame:
    """(chunk, pos, turn, key, node): every pass's order as one row of places, cut into chunks that each begin with the window before them.

    A window is at most a chunk.
    """
    order = ["turn", "key", "node"]
    rows = keyed.select("node", F.posexplode("keys").alias("turn", "key")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).cast("int")
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
    pos = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in before]), part + 1) + F.col("row") % (1 << 33)
    rows = rows.withColumn("pos", pos).withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    tail = F.when(F.col("pos") % CHUNK >= CHUNK - window, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))
    return rows.select("turn", "key", "node", "pos", F.explode(tail).alias("chunk"))


def _compared(keyed: DataFrame, same: DataFrame, dim: int, threshold: float, window: int) -> DataFrame:
    """What the windows of all passes say, written down.

    Rows with ``b``: links (a, b) of vectors within the window that reach the threshold, a spanning forest of
    each window's.  Rows with ``turn``: how many leading bits vector ``a`` shares in that pass with the one
    a whole window away from it, which says how crowded it stands; -1 if all in between are linked to it.
    """
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        node, turn, key, pos = (table.column(c).to_numpy() for c in ("node", "turn", "key", "pos"))
        unit, chunk = _unit(table.column("vector"), dim), table.column("chunk")[0].as_py()
        begin = int(np.searchsorted(pos, chunk * CHUNK))  # those before it have been compared with each other
        n, links = len(node), []
        alike_before, alike_behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at in range(begin, n, window):
            rows, low = np.arange(at, min(n, at + window)), max(0, at - window)
            close = (unit[rows] @ unit[low : rows[-1] + 1].T >= threshold) & (turn[rows][:, None] == turn[None, low : rows[-1] + 1])
            apart = rows[:, None] - np.arange(low, rows[-1] + 1)[None, :]
            row, other = np.nonzero(close & (apart > 0))
            root = forest(n - low, row + at - low, other)
            linked = np.flatnonzero(root != np.arange(len(root)))
            links.append((node[low + linked], node[low + root[linked]]))
            near = close & (apart > 0) & (apart <= window)
            alike_before[rows] += near.sum(axis=1)
            np.add.at(alike_behind, np.arange(low, rows[-1] + 1), near.sum(axis=0))
        late = np.arange(max(begin, window), n)
        late = late[turn[late] == turn[late - window]]
        shared = _shared_bits(key[late], key[late - window])
        # A vector's window behind it ends in its chunk, or else in the next one, which begins with the vector.
        full = np.concatenate([np.where(alike_before[late] == window, -1, shared), np.where(alike_behind[late - window] == window, -1, shared)])
        ends = np.concatenate([late, late - window])
        a, b = (np.concatenate([x[i] for x in links]) if links else np.zeros(0, np.int64) for i in (0, 1))
        none, some = np.ones(len(a), bool), np.ones(len(ends), bool)
        return pa.table({
            "a": np.concatenate([a, node[ends]]), "b": pa.array(np.concatenate([b, node[ends]]), mask=np.concatenate([~none, some])),
            "turn": pa.array(np.concatenate([np.zeros(len(a), np.int32), turn[ends].astype(np.int32)]), mask=np.concatenate([none, ~some])),
            "shared": pa.array(np.concatenate([np.zeros(len(a), np.int32), full.astype(np.int32)]), mask=np.concatenate([none, ~some]))})

    chunked = _placed(keyed, window).join(same.select("node", "vector"), "node")
    return cut_lineage(chunked.groupBy("chunk").applyInArrow(compare, "a bigint, b bigint, turn int, shared int"))


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits, of KEY_BITS, that two keys have in common."""
    return KEY_BITS - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64)


def _chances(seen: DataFrame, passes: int, threshold: float) -> DataFrame:
    """(node, missed): logarithm of the chance that a pair of it at the threshold stood further apart than the window in all passes.

    In a pass the pair is within the window if it agrees on one bit more than the vector shares with those a
    window away.  A vector that in some pass has nobody a window away has met all others; one that is linked
    to all in its window counts as met there.
    """
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    turns = seen.where("turn IS NOT NULL").groupBy(F.col("a").alias("node"), "turn").agg(F.max("shared").alias("shared"))
    met = F.least(F.lit(0.999999), F.pow(F.lit(agree), F.col("shared") + 1))
    nodes = turns.groupBy("node").agg(F.sum(F.log1p(-met)).alias("missed"), F.count(F.lit(1)).alias("turns"))
    return nodes.where(F.col("turns") == passes).select("node", "missed")


def _links(same: DataFrame, n: int, dim: int, threshold: float, window: int, passes: int | None, seed: int, missed: float) -> DataFrame:
    """Links of all passes; vectors that stand too crowded for the passes made so far are sorted again, by themselves, until none does."""
    wanted, found, active, left = passes or passes_for(n, threshold, window), [], same, None
    while True:
        seen = _compared(_sort_keys(active, dim, wanted, seed + len(found)), active, dim, threshold, window)
        found.append(seen.where("b IS NOT NULL").select("a", "b"))
        chances = _chances(seen, wanted, threshold)
        if left is not None:
            chances = chances.join(left.withColumnRenamed("missed", "before"), "node").select("node", (F.col("missed") + F.col("before")).alias("missed"))
        left = cut_lineage(chances.where(F.col("missed") > math.log(missed)))
        if passes or left.isEmpty():
            return functools.reduce(DataFrame.union, found)
        active, wanted = cut_lineage(active.join(left.select("node"), "node")), MORE_PASSES


def _links_each(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, others): copies of other vectors that a vector links with, exactly, within its component.

    Small components share a bucket.  A large one is cut into pieces, and each two pieces meet in a group of
    their own that returns counts, never pairs.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(1, sizes.agg(F.sum("n")).first()[0] // PIECE if not sizes.isEmpty() else 1)
    sizes = cut_lineage(sizes.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")))
    spread = (members.join(sizes, "root")
              .withColumn("bucket", F.when(F.col("pieces") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets))))
              .withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("pieces")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
              .select("node", "vector", "copies", "root", "own", "bucket", (F.col("pieces") > 1).alias("cut"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        copies, unit = table.column("copies").to_numpy().astype(np.float64), _unit(table.column("vector"), dim)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        others = np.zeros(len(node))
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            close = (unit[some] @ unit[right].T >= threshold) & (root[some][:, None] == root[right][None, :]) & (some[:, None] != right[None, :])
            others[some] += close @ copies[right]
            if low != high:
                others[right] += copies[some] @ close
        return pa.table({"node": node, "others": others.astype(np.int64)})

    counted = spread.groupBy("cut", "bucket", "low", "high").applyInArrow(count, "node bigint, others bigint")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 window: int = WINDOW, passes: int | None = None, seed: int = 11) -> DataFrame:
    """Every row's id with n_links, component_id and kept, for links at cosine ``threshold`` or more.

    Equal vectors are one node with a count.  In each pass nodes are sorted by a concatenation of random
    hashes and compared with their neighbours; verified pairs of all passes are united into components, whose
    members are then compared exactly to count links.  Windows run over chunks of the whole order, whatever
    the number of partitions.  A pair is missed only if no pass and no chain of other links brings it together:
    the passes follow the number of vectors, and vectors that stand more crowded than evenly spread ones
    would - many in one cone - are sorted again by themselves until the chance of a miss that was measured
    for each is at most MISSED.  ``passes`` fixes their number instead.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, and
    vectors of different lengths don't link.  kept is true for the row whose id is its component_id.
    Rows with a null id take part, but name no component unless they are alone; repeated rows link with each other.
    """
    vector = column(table, vector_col)
    fit = F.forall(F.transform(vector, lambda x: x.cast("double")), lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fine = F.coalesce((F.size(vector) > 0) & fit & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = table.select(column(table, id_col).alias("id"), F.when(fine, vector).alias("vector")).withColumn("hash", F.xxhash64("vector"))
    good = rows.where("vector IS NOT NULL")
    distinct = (good.groupBy("hash", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
                .withColumn("node", F.monotonically_increasing_id()))
    distinct = cut_lineage(distinct)
    found = []
    for dim, n in [(r[0], r[1]) for r in distinct.groupBy(F.size("vector").alias("dim")).count().collect()]:
        same = distinct.where(F.size("vector") == dim)
        roots = cut_lineage(connected_components(_links(same, n, dim, threshold, window, passes, seed, MISSED)))
        members = cut_lineage(same.join(roots, "node"))
        # Written down, so that Spark can split a component with very many members in the join.
        least = cut_lineage(members.groupBy("root").agg(F.min("least").alias("component_id")))
        found.append(members.select("node", "root").join(least, "root").join(_links_each(members, dim, threshold), "node").select("node", "component_id", "others"))
    if found:
        linked = found[0]
        for more in found[1:]:
            linked = linked.union(more)
        nodes = distinct.join(linked, "node", "left")
    else:
        nodes = distinct.withColumn("component_id", F.lit(None)).withColumn("others", F.lit(0))
    nodes = cut_lineage(nodes.select("hash", "vector", F.coalesce("component_id", "least").alias("component_id"),
                                     (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    joined = good.join(nodes, ["hash", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
