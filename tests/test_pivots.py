"""Search over a pivot index against all pairs, and how much of the index it meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskweave.operators import pivots
from deskweave.operators.pivots import PivotIndex


def clustered(n, dim, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((groups, dim))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    own = rng.integers(0, groups, n)
    return heads[own] + spread * rng.standard_normal((n, dim)), own


def frame(spark, vectors, scopes=None, first=0):
    rows = [(first + i, v.tolist(), None if scopes is None else scopes[i]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, scope string").repartition(6)


def brute(queries, corpus, k, allowed=None):
    out = {}
    for i, q in enumerate(queries):
        sims = np.round(corpus @ q, 6)
        ids = np.arange(len(corpus)) if allowed is None or allowed[i] is None else np.flatnonzero(allowed[i])
        order = sorted(ids.tolist(), key=lambda j: (-sims[j], -j))[:k]
        out[i] = [(j, float(sims[j])) for j in order]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["vec_id"], r["similarity"]))
    return out


def same(got, want):
    """Equal but for scores a rounding step apart, whose order may differ."""
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1.1e-6)
        assert len({j for j, _ in got[i]} ^ {j for j, _ in want[i]}) <= 2


@pytest.mark.parametrize("k", [1, 5, 300])
def test_clustered_vectors_meet_few_blocks(spark, tmp_path, k):
    corpus, _ = clustered(12_000, 16, 40, 0.05)
    queries, _ = clustered(150, 16, 40, 0.05, seed=1)
    index = PivotIndex.open(spark, str(tmp_path / "index"), frame(spark, corpus))
    out = index.search(frame(spark, queries).withColumnRenamed("vec_id", "id"), k)
    same(found(out.hits), brute(queries, corpus, k))
    share = out.visited / (len(queries) * out.blocks)
    print(f"k={k}: {out.visited} of {len(queries) * out.blocks} pairs of query and block, {share:.1%}")
    assert share < 0.3


def test_spread_vectors_and_norms_of_all_sizes(spark, tmp_path):
    rng = np.random.default_rng(3)
    corpus = rng.standard_normal((1500, 8)) * rng.choice([0.001, 1, 50], 1500)[:, None]
    corpus[5] = corpus[6] = corpus[7]
    corpus[9] = 0
    queries = np.concatenate([rng.standard_normal((40, 8)), corpus[5:10] * 3])
    index = PivotIndex.open(spark, str(tmp_path / "index"), frame(spark, corpus))
    same(found(index.search(frame(spark, queries).withColumnRenamed("vec_id", "id"), 7).hits), brute(queries, corpus, 7))


def test_scopes_read_only_their_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pivots, "SLICE_ROWS", 16)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 8)
    corpus, own = clustered(3000, 8, 12, 0.1)
    names = np.array([["a", "b", None, "", "1"][g % 5] for g in own], object)
    queries, _ = clustered(60, 8, 12, 0.1, seed=5)
    index = PivotIndex.open(spark, str(tmp_path / "index"), frame(spark, corpus, names), scope=F.col("scope"))
    asked = frame(spark, queries).withColumnRenamed("vec_id", "id")
    # a and 1 are searched by turns; an unknown name, or too few rows, means everything.
    wanted = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("zz"))).when(F.col("id") % 3 == 1, F.array(F.lit("1"), F.lit("a"))).otherwise(F.array(F.lit("zz")))
    out = index.search(asked, 4, scopes=wanted, taxonomy=["a", "b", "1"])
    allowed = [names == "a" if i % 3 == 0 else (names == "a") | (names == "1") if i % 3 == 1 else None for i in range(60)]
    same(found(out.hits), brute(queries, corpus, 4, allowed))
    only = index.search(asked, 4, scopes=F.array(F.lit("b")), taxonomy=["a", "b", "1"])
    same(found(only.hits), brute(queries, corpus, 4, [names == "b"] * 60))
    assert only.visited < out.visited
    few = index.search(asked, 2000, scopes=F.array(F.lit("b")), taxonomy=["a", "b", "1"])
    same(found(few.hits), brute(queries, corpus, 2000))


def test_empty_sides_and_stored_index(spark, tmp_path):
    none = frame(spark, np.zeros((0, 3)))
    index = PivotIndex.open(spark, str(tmp_path / "none"), none)
    some = frame(spark, np.eye(3)).withColumnRenamed("vec_id", "id")
    assert index.search(some, 2).hits.collect() == []
    path = str(tmp_path / "some")
    PivotIndex.open(spark, path, frame(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None, None)], "vec_id long, embedding array<double>, scope string")))
    again = PivotIndex.open(spark, path)
    assert found(again.search(some, 5).hits).keys() == {0, 1, 2} and again.search(some.limit(0), 5).hits.count() == 0
    assert [len(x) for x in found(again.search(some, 5).hits).values()] == [3, 3, 3]
    with pytest.raises(ValueError, match="no index"):
        PivotIndex.open(spark, str(tmp_path / "nowhere"))


def test_a_shelf_ranks_only_what_reaches_the_known_score(monkeypatch):
    """Rows below a query's floor are not ranked or handed on; the others are as without one, whenever the best are taken."""
    rng = np.random.default_rng(8)
    vectors, asked = rng.normal(size=(900, 6)), rng.normal(size=(40, 6))
    held = pa.table([pa.array(range(900)), pa.array(vectors.tolist(), pa.list_(pa.float64())), pa.array(np.repeat(np.arange(9), 100), pa.int32())], ["c_id", "c_vec", "block"])
    sims = np.round(asked @ vectors.T, 6)
    order = [sorted(range(900), key=lambda c, row=row: (-row[c], -c)) for row in sims]

    def visits(floor):
        return pa.table([pa.array(range(40)), pa.array(asked.tolist(), pa.list_(pa.float64())), pa.array(floor, pa.float64()), pa.array([[*range(9)]] * 40, pa.list_(pa.int32()))],
                        ["q_id", "q_vec", "floor", "met"])

    for cut in (100_000, -390):
        monkeypatch.setattr(pivots, "_CUT_ROWS", cut)
        for k, floor in ((5, [None] * 40), (5, [row[order[i][7]] for i, row in enumerate(sims)]), (5, [row[order[i][2]] for i, row in enumerate(sims)]), (5, [-100.0] * 40)):
            got = [(r["q_id"], r["c_id"], r["similarity"]) for r in pivots._shelf_scorer(k)(visits(floor), held).to_pylist()]
            reached = [len(o) if f is None else sum(sims[i][c] >= f - 2.1e-6 for c in o) for i, (o, f) in enumerate(zip(order, floor, strict=True))]
            assert got == [(i, c, sims[i][c]) for i, o in enumerate(order) for c in o[: min(k, reached[i])]]
            assert floor[0] is None or len(got) == sum(min(k, n) for n in reached)
