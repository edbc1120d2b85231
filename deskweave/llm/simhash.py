"""SimHash near-duplicates, found with BK-trees."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .components import connected_components
from .texts import column, forest, per_text, ragged

BITS = 64
#: Fingerprints of a shard's tree, on average.
TREE_SIZE = 1024
#: Fingerprints from which a shard is cut into several trees.
TREE_LIMIT = 4096

# Each byte's bits, one in each of eight lanes of a byte.
_LANES = np.array([sum((x >> k & 1) << 8 * k for k in range(8)) for x in range(256)], np.uint64)


def _set_in_most(hashes: np.ndarray) -> int:
    """64-bit value with the bits that more than half of the hashes have."""
    n = len(hashes)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8)
    cuts = np.arange(0, n, 255)  # a lane counts to 255
    value = 0
    for k in range(8):
        sums = np.add.reduceat(_LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        value |= int(np.packbits(2 * sums > n, bitorder="little")[0]) << 8 * k
    return value


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's shingles of ``width`` words, repeats included; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    clean = b" ".join(tokens)
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(clean, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - width + 1]
    digest = xxhash.xxh64_intdigest
    return _set_in_most(np.array([digest(clean[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str, schema: str, width: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long, of every row; a null text counts as empty."""
    def work(texts: pa.Array) -> list:
        values = [fingerprint(t, width) for t in pc.cast(texts, pa.binary()).to_pylist()]
        return [np.array(values, np.uint64).view(np.int64)]

    return per_text(docs, keep, column(docs, text_col), schema + ", fp bigint", work)


class BKTree:
    """Distinct fingerprints; a node's children are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        node = np.arange(1, len(values))
        parent = np.zeros(len(node), np.int64)
        edges, children = [np.zeros(0, np.int64)], [node[:0]]
        while len(node):  # all wait at a node; the first at each distance becomes its child, the others move on to that child
            key = parent * (BITS + 1) + np.bitwise_count(values[node] ^ values[parent])
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(node[first])
            moved = node[first][which]
            wait = moved != node
            node, parent = node[wait], moved[wait]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        self.edges, self.children = edge[order], child[order]

    def within(self, queries: np.ndarray, radius: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of (query, node) pairs at most ``radius`` apart, following only edges that can lead there."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries) if len(self.values) else 0, batch):
            query = np.arange(at, min(at + batch, len(queries)))
            node = np.zeros(len(query), np.int64)
            while len(query):
                far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
                near = far <= radius
                found.append((query[near], node[near]))
                low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(far - radius, 0))
                high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(far + radius, BITS), side="right")
                query, node = np.repeat(query, high - low), self.children[ragged(low, high - low)]
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def _routes(n: int, radius: int) -> tuple[int, list[tuple[int, ...]], int]:
    """(blocks, choices of blocks, leading bits) such that close pairs agree on all blocks of a choice.

    Of ``radius + k`` blocks, differing bits spoil at most ``radius``; k blocks agree.  k grows until their
    bits can tell apart as many shards as there are trees.
    """
    wanted = max(0, math.ceil(math.log2(max(1, n) / TREE_SIZE)))
    k = 1
    while k * (BITS // (radius + k)) < wanted and radius + k < 16:
        k += 1
    bits = k * (BITS // (radius + k))
    return radius + k, list(combinations(range(radius + k), k)), min(bits, wanted)


def similar_fingerprints(distinct: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most ``radius`` bits apart, directly or by way of others.

    A query needs only the trees that can hold a neighbour: the bits are cut into blocks, and two fingerprints
    within the radius agree on whole blocks, so each goes to one shard per choice of blocks, named by the
    leading bits there.  The number of shards follows the number of fingerprints, so trees keep their size
    and the work grows with the input.  A shard with many fingerprints is cut into several trees, each
    of which gets the shard's other pieces as queries.  Each tree returns only a spanning forest of its links.
    """
    n = distinct.count()
    blocks, choices, bits = _routes(n, radius)
    width = BITS // blocks

    def key(choice: tuple[int, ...]) -> Column:
        value = F.lit(0).cast("bigint")
        for block in choice:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), block * width).bitwiseAND(F.lit((1 << width) - 1)))
        return F.shiftrightunsigned(value, len(choice) * width - bits)

    routed = (distinct.where(column(distinct, fp).isNotNull()).select(column(distinct, fp).alias("fp"))
              .select("fp", F.posexplode(F.array(*[key(c) for c in choices])).alias("route", "shard")))
    crowded = (routed.groupBy("route", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE_LIMIT)
               .select("route", "shard", F.ceil(F.col("n") / (TREE_LIMIT // 2)).cast("int").alias("trees")))
    crowded = cut_lineage(crowded)
    spread = routed.join(crowded, ["route", "shard"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    spread = (spread.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("trees")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
              .select("fp", "route", "shard", "own", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asks")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy().view(np.uint64)
        inside = np.flatnonzero(group["own"].to_numpy() == group["tree"].iloc[0])
        asking = np.flatnonzero(group["own"].to_numpy() == group["asks"].iloc[0])
        query, node = BKTree(values[inside]).within(values[asking], radius)
        root = forest(len(values), asking[query], inside[node])
        linked = np.flatnonzero(root != np.arange(len(root)))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})

    return spread.groupBy("route", "shard", "tree", "asks").applyInPandas(search, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component_id, the smallest id its links reach.

    Texts are lower-cased (A-Z), cut at white space and hashed as shingles of ``width`` words; a text with
    fewer words is one shingle, one without words has fingerprint zero.  Rows with one fingerprint are one
    node, so copies cost nothing further.  Rows keep null ids and repeated ids; a component of null ids alone
    has a null component_id.  No rows give no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = cut_lineage(fingerprints(docs, [column(docs, id_col)], text_col, f"{id_col} {id_type}", width))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(similar_fingerprints(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut_lineage(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return rows.join(table, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
