"""Neighbour search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskweave.operators.neighbours import _best_columns, knn
from deskweave.operators.scoring import embed, hashed_vectors
from deskweave.operators.tfidf import fit_idf, term_counts, weigh
from deskweave.plans.baselines import tfidf_nearest

INTENTS = ("a", "b", "c")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(300, 8))
    corpus[50:60] = corpus[10:20]  # equal scores
    queries = np.vstack([rng.normal(size=(40, 8)), corpus[10:15]])
    # One scope holds most rows; 'c' holds very few and 'z' is unknown.
    scopes = ["a"] * 250 + ["b"] * 46 + ["c"] * 2 + ["z"] * 2
    return queries, corpus, scopes


def frames(spark, vectors):
    queries, corpus, scopes = vectors
    names = ["a", "b", "c", "z", None]
    q = spark.createDataFrame([(i, x.tolist(), names[i % 5]) for i, x in enumerate(queries)], "id long, embedding array<double>, intent string")
    c = spark.createDataFrame([(i, x.tolist(), s) for i, (x, s) in enumerate(zip(corpus, scopes))], "vec_id long, embedding array<double>, scope string")
    return q, c


def brute(vectors, k, wanted):
    queries, corpus, scopes = vectors
    out = {}
    for i, x in enumerate(queries):
        inside = [s for s in wanted(i) if s in INTENTS]
        rows = [j for j, s in enumerate(scopes) if s in inside]
        if len(rows) < k:
            rows = range(len(corpus))
        best = sorted(((round(float(corpus[j] @ x), 6), j) for j in rows), reverse=True)[:k]
        out[i] = [(j, s) for s, j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.vec_id, r.similarity))
    return out


@pytest.mark.parametrize("k,blocks", [(1, (32768, 32768)), (1, (4, 16)), (3, (4, 16)), (300, (16, 64))])
def test_global(spark, vectors, k, blocks):
    q, c = frames(spark, vectors)
    got = found(knn(q, c, k, query_block=blocks[0], corpus_block=blocks[1]))
    assert got == brute(vectors, k, lambda i: [])


@pytest.mark.parametrize("k", [1, 3, 40, 60])
def test_scoped_with_fallback(spark, vectors, k):
    q, c = frames(spark, vectors)
    names = ["a", "b", "c", "z", None]
    got = found(knn(q, c, k, scopes=F.array("intent"), corpus_scope=F.col("scope"), taxonomy=INTENTS, query_block=4, corpus_block=16))
    assert got == brute(vectors, k, lambda i: [names[i % 5]])


@pytest.mark.parametrize("k", [1, 3, 7, 999, 1000, 2000])
def test_best_columns(k):
    rng = np.random.default_rng(k)
    sims = rng.integers(0, 60, size=(20, 1000)) / 60 + rng.choice([0.0, 4e-7], size=(20, 1000))
    rows, cols, scores = _best_columns(sims, k)
    rounded = np.round(sims, 6)
    for row in range(20):
        best = sorted(range(1000), key=lambda j: (-rounded[row, j], j))[:k]
        assert cols[rows == row].tolist() == best and scores[rows == row].tolist() == rounded[row, best].tolist()


def test_candidate_list(spark, vectors):
    q, c = frames(spark, vectors)
    wanted = F.when(F.col("id") % 3 == 0, F.array(F.lit("b"), F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("zz")))
    got = found(knn(q, c, 47, scopes=wanted, corpus_scope=F.col("scope"), taxonomy=INTENTS, query_block=4, corpus_block=16))
    assert got == brute(vectors, 47, lambda i: ["b", "c"] if i % 3 == 0 else ["c"])


def test_no_corpus_and_null_vectors(spark, vectors):
    q, c = frames(spark, vectors)
    assert knn(q, c.filter("false"), 1).count() == 0
    holes = q.withColumn("embedding", F.when(F.col("id") > 0, F.col("embedding")))
    assert knn(holes, c, 1).count() == q.count() - 1


TEXTS = ["the app will not open today", "open the app and play", "play play play song", "nothing shared here", "the the the the", "song will not play",
         "refund my payment", "a b c", ""]


def tfidf(texts, corpus, n_terms):
    """Plain reading of sublinear tf, smoothed idf and cosine."""
    def grams(t):
        w = re.findall(r"\w{2,}", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    total, df = Counter(), Counter()
    for t in corpus:
        total.update(grams(t))
        df.update(grams(t).keys())
    vocab = {w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:n_terms]}
    idf = {w: math.log((1 + len(corpus)) / (1 + df[w])) + 1 for w in vocab}

    def row(t):
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in grams(t).items() if w in vocab}
        size = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / size for w, x in raw.items()}

    return [row(t) for t in texts]


@pytest.mark.parametrize("n_terms", [5, 5000])
def test_tfidf_weights(spark, n_terms):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    counts = term_counts(docs, "id", "text")
    got = {(r.id, r.term): r.weight for r in weigh(counts, fit_idf(counts, docs, n_terms)).collect()}
    expected = {(i, w): x for i, row in enumerate(tfidf(TEXTS, TEXTS, n_terms)) for w, x in row.items()}
    assert got.keys() == expected.keys()
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in got)


def test_tfidf_nearest(spark):
    corpus, asked = TEXTS[:6], ["will the song open", "unknown words only", "play", "the", ""]
    docs = spark.createDataFrame(list(enumerate(corpus)), "id long, text string")
    queries = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked)], "id long, text string")
    got = {r.id: (r.hit_id, r.similarity) for r in tfidf_nearest(queries, docs).collect()}
    c_rows, q_rows = tfidf(corpus, corpus, 5000), tfidf(asked, corpus, 5000)
    for i, q in enumerate(q_rows):
        scores = [round(sum(x * c.get(w, 0.0) for w, x in q.items()), 6) for c in c_rows]
        best = max(scores)
        assert got[100 + i] == ((scores.index(best), best) if best > 0 else (None, 0.0))


def test_embed(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, "world hello")], "id long, text string")
    out = {r.id: r.embedding for r in embed(docs, "id", "text", lambda texts: [[float(len(x)), 1.0] for x in texts], batch_size=1).collect()}
    assert out == {1: [11.0, 1.0], 3: [11.0, 1.0]}


def test_hashed_vectors(spark):
    texts = {1: "hello world World", 2: "", 3: "world hello world", 4: None, 5: "a b", 6: "other words here, other"}
    out = {r.id: r.embedding for r in hashed_vectors(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", 16).collect()}
    assert set(out) == {1, 3, 6} and out[1] == out[3]
    for i in out:
        want = [0.0] * 16
        for word in re.findall(r"\w{2,}", texts[i].lower()):
            h = hashlib.md5(word.encode()).hexdigest()
            want[int(h[:4], 16) % 16] += 1.0 if h[4] < "8" else -1.0
        norm = math.sqrt(sum(x * x for x in want))
        assert out[i] == pytest.approx([x / norm if norm else 0.0 for x in want])


def test_tfidf_with_the_whole_vocabulary(spark):
    rng = random.Random(4)
    corpus = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=6)) + f" rare{i} rare{i}") for i in range(30)]
    asked = [(100 + i, f"bb cc rare{i}") for i in range(30)] + [(200, "zz yy")]
    got = {r.id: r.hit_id for r in tfidf_nearest(*(spark.createDataFrame(x, "id long, text string") for x in (asked, corpus)), n_terms=None).collect()}
    assert got == {100 + i: i for i in range(30)} | {200: None}


def test_a_query_without_a_shared_term_costs_no_selection():
    sims = np.zeros((3, 4000))
    sims[1, 7] = 0.5
    rows, cols, scores = _best_columns(sims, 2, positive=True)
    assert (rows.tolist(), cols.tolist(), scores.tolist()) == ([1], [7], [0.5])


def test_scopes_that_nobody_searches_are_not_read(spark, tmp_path):
    """Files of other scopes are damaged: a search that prunes does not notice, one that does not prune fails."""
    rng = np.random.default_rng(2)
    path = str(tmp_path / "stored")
    rows = [(i, rng.standard_normal(4).tolist(), f"s{i % 6}" if i % 7 else None) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, scope string").write.partitionBy("scope").parquet(path)
    corpus = spark.read.parquet(path)
    asked = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(9)], "id long, embedding array<double>")
    few = F.when(F.col("id") < 5, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s2"), F.lit("nowhere")))
    names = [f"s{i}" for i in range(6)]

    def search(prune, wanted):
        return knn(asked, corpus, 3, scopes=wanted, corpus_scope=F.col("scope"), taxonomy=names, prune=prune)

    def answers(found):
        return sorted(map(tuple, found.collect()))

    whole = F.when(F.col("id") == 0, F.array(F.lit("nowhere"))).otherwise(few)
    before = answers(search(False, few))
    assert answers(search(True, few)) == before and answers(search(True, whole)) == answers(search(False, whole))
    plan = search(True, few)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    for name in ("s0", "s3", "s4", "s5"):
        for file in (tmp_path / "stored" / f"scope={name}").glob("*.parquet"):
            content = file.read_bytes()
            file.with_name(f".{file.name}.crc").unlink()
            footer = len(content) - 8 - int.from_bytes(content[-8:-4], "little")
            file.write_bytes(content[:4] + bytes(footer - 4) + content[footer:])
    assert answers(search(True, few)) == before
    with pytest.raises(Exception):  # noqa: B017
        answers(search(False, few))
