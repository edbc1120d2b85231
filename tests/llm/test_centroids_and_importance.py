"""Clustering and resampling against plain Python, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskweave.llm import catalog, centroids, importance

RANDOM = random.Random(17)
ODD = [None, "", " ", "one", "Zwei Wörter", "x" * 300 + " y", "a" * 70 + " " + "b" * 5000, "a_b-c 1\x00 2 é", "字 字字", "THE The the " * 40]


def plain_clusters(rows, k, rounds, dim, scale, seed):
    """(id, cluster, distance) of the kept rows, and the final centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    middle = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        middle = [[sum(x) // len(x) for x in zip(*group, strict=True)] if (group := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else middle[c] for c in range(len(middle))]
    return [(i, *reversed(nearest(v))) for i, v in kept], middle


def vectors(n, dim, spread=0.3):
    heads = [[RANDOM.uniform(-2, 2) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + RANDOM.gauss(0, spread) for x in RANDOM.choice(heads)]) for i in range(n)]


AWKWARD = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 2.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]),
           (None, [0.5, 0.5, 0.5, 0.5]), (906, [0.0] * 4), (907, [0.0] * 4), (907, [0.0] * 4), (908, [-0.0001] * 4)]


@pytest.mark.parametrize(("rows", "k", "rounds"), [(vectors(300, 4) + AWKWARD, 8, 10), (vectors(200, 4, 0.0), 30, 3), (vectors(3, 4), 8, 2), (vectors(60, 4), 1, 2),
                                                  (vectors(50, 4) + [(60, [1e7, -1e7, 3e5, 0.0]), (61, [-2e7, 1e6, 0.0, 0.0])], 6, 4)])
def test_clusters_match_plain_ones(spark, rows, k, rounds):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name in ("id", "vector", "cluster", "n", "a.b"):
        frame = frame.withColumn(name, F.lit(1))
    got = centroids.cluster_vectors(frame, k=k, rounds=rounds, dim=4, seed="3:").collect()
    want, middle = plain_clusters(rows, k, rounds, 4, 1024.0, "3:")
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["centroid"] == middle[r["cluster"]]
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_no_vectors_and_very_large_ones(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(none, 8, 10, 4, "3:").collect() == []
    assert centroids.cluster_vectors(none.limit(0), 8, 10, 4, "3:").columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    large = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    got = centroids.cluster_vectors(large, 2, 2, 2, "3:").collect()
    assert len(got) == 3 and all(0 <= r["distance"] < 1 << 63 for r in got)


def test_search_meets_few_and_misses_none():
    rng = np.random.default_rng(4)
    heads = rng.integers(-4000, 4000, (40, 6))
    middle = np.concatenate([heads + rng.integers(-60, 60, heads.shape) for _ in range(5)] + [heads[:3]])
    asked = heads[rng.integers(0, 40, 3000)] + rng.integers(-80, 80, (3000, 6))
    own, distance = centroids.Orchard(middle).nearest(asked)
    every = ((asked[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def plain_features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return found, found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def plain_draw(rows, target, share=(25, 100), least=20, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in plain_features(text)[1])
    whole, other = s.total() + buckets, t.total() + buckets
    out, fit = [], []
    for i, text in rows:
        found, features = plain_features(text)
        gained = [math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * other))) for b in (zlib.crc32(f.encode()) % buckets for f in features)]
        weight = sum(gained) // len(gained) if gained else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(found) >= least:
            fit.append((-score, i if i is not None else 1 << 63, len(out)))
        out.append([i, len(features), weight, score, None])
    for rank, (*_, place) in enumerate(sorted(fit)[: len(fit) * share[0] // share[1]], 1):
        out[place][4] = rank
    return [tuple(r) for r in out]


def texts(n):
    stock = [f"w{i}" for i in range(80)] + ["Ä", "ß", "THE", "of"]
    return [" ".join(RANDOM.choices(stock, k=RANDOM.choice([3, 19, 20, 21, 60, 200]))) for _ in range(n)]


@pytest.mark.parametrize("range_rows", [7, 1024])
def test_draw_matches_a_plain_one(spark, monkeypatch, range_rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", range_rows)
    rows = list(enumerate(texts(400) + ODD)) + [(None, texts(1)[0] + " and more" * 20)] + [(7000, "same words again " * 9)] * 90
    target = texts(30) + ["same words", None, ""]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for name in ("id", "t", "rank", "segment", "place", "run", "score", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    got = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    found = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()]
    assert Counter(found) == Counter(plain_draw(rows, target))


def test_ranges_are_even(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 50)
    rows = spark.range(5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(40))).alias("score")).repartition(13)
    ranked = importance.rank_highest(rows, (1, 2), ["id", "score"]).collect()
    want = sorted(ranked, key=lambda r: (-r["score"], r["id"]))
    assert [r["rank"] for r in want] == [*range(1, 2501), *[None] * 2500]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (2, None), (3, "c d " * 40), (4, "e"), (5, "f g " * 10), (6, "h " * 25)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none.select("text"))
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == Counter(plain_draw([tuple(r) for r in some.collect()], []))


def test_checksums():
    data = [bytes(RANDOM.randrange(256) for _ in range(n)) for n in [*range(1, 60), 63, 64, 65, 128, 1000, 70_000]]
    flat, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])
    got = importance.word_checksums(flat, ends - [len(d) for d in data], ends)
    assert got.tolist() == [zlib.crc32(d) for d in data]
    shifted = importance._shifted(got, np.array([len(d) for d in data]))
    assert (shifted ^ got).tolist() == [zlib.crc32(d + d) for d in data]


def test_long_texts_go_in_chunks(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_WORDS", 3)
    some = ["a b c d e f g", "", "h", "i j k l"]
    got = Counter((int(o), int(b)) for own, bucket in importance.feature_buckets(pa.array(some), 2, 997) for o, b in zip(own, bucket, strict=True))
    assert got == Counter((i, zlib.crc32(f.encode()) % 997) for i, t in enumerate(some) for f in plain_features(t)[1])


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = catalog.op13_importance(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_draw(rows, target))
