"""The inverted index against all pairs, and how many pairs its bounds leave."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from deskweave.operators import postings


def rows(n, vocabulary, rng, first=0, common=()):
    out = []
    for i in range(n):
        terms = sorted({*rng.choices(vocabulary, weights=[1 / (t + 1) for t in vocabulary], k=rng.randint(1, 25)), *common})
        raw = [rng.uniform(0.05, 1.0) * (0.05 if t in common else 1.0) for t in terms]
        norm = sum(x * x for x in raw) ** 0.5
        out.append((first + i, terms, [x / norm for x in raw]))
    return out


def brute(asked, held):
    best = {}
    for i, terms, weights in asked:
        q = dict(zip(terms, weights, strict=True))
        scores = [(-round(sum(q[t] * w for t, w in zip(ts, ws, strict=True) if t in q), 6), j) for j, ts, ws in held]
        score, j = min(scores, default=(0, None))
        if score < 0:
            best[i] = (j, -score)
    return best


def frames(spark, asked, held, kind="long"):
    return (spark.createDataFrame(x, f"id {kind}, terms array<bigint>, weights array<double>").repartition(3) for x in (asked, held))


@pytest.mark.parametrize(("size", "common"), [(30, ()), (3000, ()), (3000, (0, 1, 2))])
def test_best_rows_match_all_pairs(spark, size, common):
    rng = random.Random(size)
    vocabulary = list(range(size))
    held, asked = rows(400, vocabulary, rng, common=common), rows(150, vocabulary, rng, first=1000, common=common)
    held += [(401, *held[3][1:]), (402, [10**9], [1.0])]  # equal rows, and a term nobody asks for
    asked += [(2000, *held[3][1:]), (2001, [10**9 + 1], [1.0]), (2002, [], [])]
    got = {r.id: (r.hit_id, r.similarity) for r in postings.sparse_best(*frames(spark, asked, held), query_id="id", corpus_id="id", bounded_terms=size == 30).collect()}
    want = brute(asked, held)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][1] == pytest.approx(want[i][1], abs=1.1e-6) and (got[i][0] == want[i][0] or abs(got[i][1] - want[i][1]) < 1.1e-6)
    assert sum(got[i][0] == want[i][0] for i in want) >= len(want) - 1


def test_common_terms_bring_no_candidates(spark):
    """Every row holds the common terms; the bounds leave a small part of all pairs, which the rare terms decide."""
    rng = random.Random(9)
    held = rows(1500, list(range(4000)), rng, common=(5000, 5001))
    asked = [(10_000 + i, *held[rng.randrange(1500)][1:]) for i in range(200)]
    q, c = postings._sides(*frames(spark, asked, held), "id", "id")
    left = postings.candidates(q, c, False).count()
    print(f"{left} of {len(asked) * len(held)} pairs scored, {left / (len(asked) * len(held)):.2%}")
    assert left < 0.02 * len(asked) * len(held)
    want = brute(asked, held)
    assert {r.q_id: (r.c_id, r.similarity) for r in postings.best_pairs(q, c, False).collect()} == want


def test_empty_sides(spark):
    some, none = [(1, [3], [1.0])], []
    for asked, held in ((some, none), (none, some), (none, none)):
        assert postings.sparse_best(*frames(spark, asked, held), query_id="id", corpus_id="id").collect() == []
    got = postings.sparse_best(*frames(spark, some, some, "int"), query_id="id", corpus_id="id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0)]


def test_a_block_is_scored_in_parts_of_columns_and_postings(monkeypatch):
    """Whatever terms are columns and however many scores are held at a time, the pairs are those of the plain products, ties to the lower id."""
    rng = random.Random(4)
    held, asked = rows(300, list(range(900)), rng, common=(900, 901)), rows(120, list(range(900)), rng, first=1000, common=(901,))
    held += [(500, [2007, 2008], [0.6, 0.8]), (499, [2008, 2009], [0.8, 0.6]), (501, [10**6], [1.0])]
    asked += [(2000, [2008], [1.0]), (2001, [10**7], [1.0]), (2002, [], []), (2003, [10**6], [1e-4])]
    kinds = pa.list_(pa.int64()), pa.list_(pa.float64())

    def table(some, side):
        return pa.table([pa.array([r[0] for r in some]), *(pa.array([r[i + 1] for r in some], kinds[i]) for i in range(2))], [f"{side}_id", f"{side}_terms", f"{side}_weights"])

    want = brute(asked, held)
    assert want[2000][0] == 499 and want[2003] == (501, 1e-4)
    for columns, common, cells, touched in ((512, 512, 8_000_000, 2_000_000), (0, 512, 5_000, 300), (3, 1, 5_000, 2_000_000), (512, 10**9, 1, 1)):
        for name, value in (("COLUMNS", columns), ("COMMON", common), ("CELLS", cells), ("TOUCHED", touched), ("PAIRS", 7)):
            monkeypatch.setattr(postings, name, value)
        got = postings._block_scorer(True)(table(asked, "q"), table(held, "c")).to_pylist()
        assert {r["q_id"]: (r["c_id"], r["similarity"]) for r in got} == want
    assert postings._block_scorer(True)(table(asked[:5], "q"), table(held[-1:], "c")).num_rows == 0


def test_common_terms_take_no_time_for_each_pair_that_shares_them(monkeypatch):
    """Every row holds thirty terms that all share; before, each such posting was met by each query."""
    rng = np.random.default_rng(5)
    shared = np.arange(30)

    def table(n, side):
        terms = [np.concatenate([shared, 30 + np.unique(rng.integers(0, 5000, 5))]) for _ in range(n)]
        weights = [rng.uniform(0.1, 0.2, len(t)) for t in terms]
        return pa.table([pa.array(range(n)), pa.array(terms, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], [f"{side}_id", f"{side}_terms", f"{side}_weights"])

    asked, held = table(6000, "q"), table(6000, "c")
    met = []

    class Counted:
        """numpy, which counts the postings that are added one by one."""

        def __getattr__(self, name):
            return self if name == "add" else getattr(np, name)

        def at(self, scores, where, what):
            met.append(len(where))
            np.add.at(scores, where, what)

    monkeypatch.setattr(postings, "np", Counted())
    got = postings._block_scorer(True)(asked, held)
    assert got.num_rows == 6000 and 0 < sum(met) < 0.02 * 6000 * 6000


@pytest.mark.parametrize("strip", [1, 7, 64, 4096])
def test_strips_of_the_corpus_leave_the_same_pairs(monkeypatch, strip):
    """The best row may stand in any strip, and equal scores in several; the lower id is kept."""
    rng = random.Random(6)
    held = rows(150, list(range(300)), rng, common=(300, 301))
    held += [(900 - i, [2000, 2001 + i], [0.6, 0.8]) for i in range(20)]
    asked = rows(60, list(range(300)), rng, first=1000, common=(301,)) + [(2000, [2000], [1.0])]
    kinds = pa.list_(pa.int64()), pa.list_(pa.float64())

    def table(some, side):
        return pa.table([pa.array([r[0] for r in some]), *(pa.array([r[i + 1] for r in some], kinds[i]) for i in range(2))], [f"{side}_id", f"{side}_terms", f"{side}_weights"])

    monkeypatch.setattr(postings, "STRIP", strip)
    for columns in (512, 0):
        monkeypatch.setattr(postings, "COLUMNS", columns)
        got = postings._block_scorer(True)(table(asked, "q"), table(held, "c")).to_pylist()
        want = brute(asked, held)
        assert {r["q_id"]: (r["c_id"], r["similarity"]) for r in got} == want and want[2000] == (881, 0.6)


def test_scores_that_reach_their_floor():
    rng = np.random.default_rng(8)
    marks = np.ones(80, bool)
    for shape in ((1, 1), (3, 5), (8, 8), (7, 11)):
        scores, floor = rng.random(shape, np.float32), rng.random(shape[0], np.float32)
        assert [x.tolist() for x in postings._reached(scores, floor, marks)] == [x.tolist() for x in np.nonzero(scores >= floor[:, None])]


def test_scores_are_held_a_strip_at_a_time(monkeypatch):
    """Whatever the size of a block, its scores lie in one piece of memory of a fixed size; before, each part made a new one as wide as the block."""
    rng = random.Random(2)
    monkeypatch.setattr(postings, "CELLS", 2_000)
    monkeypatch.setattr(postings, "STRIP", 100)
    held, asked = rows(900, list(range(500)), rng, common=(500,)), rows(90, list(range(500)), rng, first=1000, common=(500,))
    sizes = []

    class Watched:
        def __getattr__(self, name):
            return getattr(np, name)

        def matmul(self, left, right, out):
            sizes.append((out.size, out.base is not None))
            return np.matmul(left, right, out=out)

    monkeypatch.setattr(postings, "np", Watched())
    table = {side: pa.table([pa.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.list_(pa.int64())), pa.array([r[2] for r in some], pa.list_(pa.float64()))],
                            [f"{side}_id", f"{side}_terms", f"{side}_weights"]) for side, some in (("q", asked), ("c", held))}
    got = postings._block_scorer(True)(table["q"], table["c"]).to_pylist()
    assert {r["q_id"]: (r["c_id"], r["similarity"]) for r in got} == brute(asked, held)
    assert len(sizes) >= 9 * 5 and all(size <= 2_000 and shared for size, shared in sizes)
