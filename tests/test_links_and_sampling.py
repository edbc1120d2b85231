"""Reply graph, splits, samples and running sums, with hot groups."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from deskweave.operators import links as k
from deskweave.operators.labelling import ensure_columns, label_progress, normalise_code, running_other_rate
from deskweave.operators.ranks import in_pieces, running_sums, top_n_per_group
from deskweave.operators.sampling import balanced_sample, quota_sample, seeded_head, stratified_split
from deskweave.functions import defaults as d
from deskweave.plans.corpus import CorpusRules, build_corpus, build_pool


@pytest.fixture(scope="module")
def graph():
    """600 messages; a third of all customer messages answer one brand post."""
    rng = random.Random(5)
    rows = [(0, "brand", False, "big post", None)]
    for i in range(1, 600):
        author = rng.choice(["brand", "u1", "u2", "u3"])
        parent = 0 if rng.random() < 0.33 else rng.choice([None, rng.randrange(0, 700), rng.randrange(0, i)])
        rows.append((i, author, author != "brand", f"text {i}", parent))
    return rows


@pytest.fixture(scope="module")
def msgs(spark, graph):
    return spark.createDataFrame(graph, "msg_id long, author string, inbound boolean, text string, parent_id long").repartition(7)


def ids(df):
    return sorted(r.msg_id for r in df.select("msg_id").collect())


def test_reply_graph(graph, msgs):
    brand = {r[0] for r in graph if r[1] == "brand"}
    targets = {r[4] for r in graph if r[1] == "brand" and r[4] is not None}
    direct = [r[0] for r in graph if r[2] and r[4] in brand]
    roots = [r[0] for r in graph if r[2] and r[0] in targets]
    assert ids(k.replies_to_brand(msgs, "brand")) == direct
    assert ids(k.recoverable_roots(msgs, "brand")) == roots
    assert ids(k.minus_by_id(k.recoverable_roots(msgs, "brand"), k.replies_to_brand(msgs, "brand"))) == sorted(set(roots) - set(direct))
    assert ids(k.inbound_union(msgs, "brand")) == sorted(set(roots) | set(direct))


def test_first_reply_wins(graph, msgs):
    first = {}
    for i, author, _, text, parent in graph:
        if author == "brand" and parent is not None:
            first.setdefault(parent, text)
    got = {r.msg_id: r.brand_reply for r in k.attach_first_reply(msgs, msgs, "brand").collect()}
    assert got == {r[0]: first.get(r[0]) for r in graph}


def test_corpus_chain(spark):
    long_reply = "Please restart your phone and reinstall the application, then tell us whether that helped you out."
    rows = [
        ("1", "u", True, "@brand my song keeps skipping all the time,\r\nplease help me", None), ("2", "brand", False, long_reply, "1"),
        ("3", "brand", False, "later " + long_reply, "1"), ("4", "u", True, "@brand my song is on my iphone and it stops again", "2"),
        ("5", "brand", False, long_reply, "4"), ("6", "u", True, "my song keeps skipping, this one is golden", "2"), ("7", "brand", False, long_reply, "6"),
        ("8", "u", True, "short song", "2"), ("9", "brand", False, long_reply, "8"), ("10", "u", True, "the song playback stops and nobody answers me", "2"),
        ("11", "u", True, "the song playback stops, asked to write in private", "2"), ("12", "brand", False, "Please DM us " + "x" * 90, "11"),
        ("13", "u", True, "éééééééééé song ééééééééééééééééééééééééé", "2"), ("14", "brand", False, long_reply, "13"), ("15", "u", True, "unrelated song with nobody around at all", None)]
    frame = spark.createDataFrame(rows, "msg_id string, author string, inbound boolean, text string, parent_id string")
    golden = spark.createDataFrame([("6",)], "msg_id string")
    rules = CorpusRules(brand="brand")
    order = F.col("msg_id").cast("long")
    pool = {r.msg_id: r for r in build_pool(frame, golden, rules, order).collect()}
    assert set(pool) == {"1", "4", "10", "11"}
    assert pool["4"].silver_intent is None and pool["10"].brand_reply is None and not pool["11"].visible
    out = build_corpus(frame, golden, rules, order).collect()
    assert [tuple(r) for r in out] == [("1", "my song keeps skipping all the time,  please help me", long_reply, "playback_issue")]


def md5(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def test_split_is_exact_and_stratified(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "d", None])) for i in range(1511)]
    frame = spark.createDataFrame(rows, "id long, stratum string")
    for size, expected in ((0.5, 756), (38, 38), (5000, 1511)):
        got = {r.id: r.split for r in stratified_split(frame, ["stratum"], "id", size).collect()}
        assert len(got) == 1511 and Counter(got.values())["held_out"] == expected
        per = defaultdict(Counter)
        for i, s in rows:
            per[s][got[i]] += 1
        for counts in per.values():
            share = sum(counts.values()) * expected / 1511
            assert abs(counts["held_out"] - share) <= 1
    again = {r.id: r.split for r in stratified_split(frame.repartition(9), ["stratum"], "id", 0.5).collect()}
    assert again == {r.id: r.split for r in stratified_split(frame, ["stratum"], "id", 0.5).collect()}


def test_samples(spark):
    rows = [(i, "hot" if i % 3 else "b" if i % 2 else "c", "easy" if i % 5 else "hard") for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, c string, t string")
    expected = {c: [i for _, i in sorted((md5(i), i) for i, x, _ in rows if x == c)[:50]] for c in ("hot", "b", "c")}
    got = defaultdict(list)
    for r in balanced_sample(frame, "c", "id", 50).orderBy("rn").collect():
        got[r.c].append(r.id)
    assert got == expected
    quota = {("hot", "easy"): 7, ("hot", "hard"): 1000, ("b", "easy"): 0}
    counts = Counter((r.c, r.t) for r in quota_sample(frame, ["c", "t"], quota, "id").collect())
    assert counts == {("hot", "easy"): 7, ("hot", "hard"): sum(x == "hot" and t == "hard" for _, x, t in rows)}
    assert [r.id for r in seeded_head(frame, "id", 5).collect()] == [i for _, i in sorted((md5(i), i) for i in range(900))[:5]]


def test_top_n_keeps_every_group(spark):
    frame = spark.createDataFrame([(i, i % 2) for i in range(1000)], "id long, g long")
    got = sorted(r.id for r in top_n_per_group(frame, ["g"], [F.col("id").desc()], 3, "id", salts=4).collect())
    assert got == [994, 995, 996, 997, 998, 999]


@pytest.mark.parametrize("pieces", [1, 16, 400])
def test_running_sums_with_hot_key(spark, pieces):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, rng.random() * 50]), i, rng.randrange(9)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, at double, id long, x long").repartition(5)
    got = {r.id: (r.n, r.s) for r in running_sums(frame, ["k"], ["at", "id"], {"n": F.lit(1), "s": F.col("x")}, pieces).collect()}
    n, s = Counter(), Counter()
    for key, _, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        n[key] += 1
        s[key] += x
        assert got[i] == (n[key], s[key])


@pytest.mark.parametrize("values", ["outlier", "equal", "null", "bunched"])
def test_pieces_of_a_hot_key_are_even(spark, values):
    n = 8000
    at = {"outlier": lambda i: 1e12 if i == 0 else float(i % 50), "equal": lambda i: 3.0, "null": lambda i: None, "bunched": lambda i: 1.0 + (i % 100 == 0) * i}[values]
    frame = spark.createDataFrame([("hot" if i % 3 else f"k{i}", at(i), i) for i in range(n)], "k string, at double, id long").repartition(4)
    sizes = [r["count"] for r in in_pieces(frame, ["k"], ["at"], 256, {}).where("k = 'hot'").groupBy("_piece").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 12 * n / 256


def test_thread_starters_are_not_looked_up_by_parent(spark):
    rows = [(i, "user" if i % 2 else "brand", i % 2 == 1, None if i < 500 else i - 500) for i in range(1000)] + [(2000, "user", True, 10)]
    msgs = spark.createDataFrame(rows, "msg_id long, author string, inbound boolean, parent_id long").withColumn("text", F.lit("t"))
    got = sorted(r.msg_id for r in k.inbound_union(msgs, "brand").collect())
    brand, answered = {r[0] for r in rows if r[1] == "brand"}, {r[3] for r in rows if r[1] == "brand" and r[3] is not None}
    assert got == sorted(r[0] for r in rows if r[2] and (r[3] in brand or r[0] in answered))


def test_running_other_rate(spark):
    labels = [False] * 17 + [True] * 4 + [False] * 20 + [True] * 8
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "k string, at long, other boolean")
    got = running_other_rate(frame, ["k"], ["at"], F.col("other")).orderBy("at").collect()
    expected, seen, others = [], 0, 0
    for x in labels:
        before = others / seen if seen else 0.0
        seen, others = seen + 1, others + x
        expected.append(seen > 10 and others / seen > 0.15 and before <= 0.15)
    assert [r.alert for r in got] == expected and sum(expected) == 2


def test_labels(spark):
    frame = spark.createDataFrame([(" P ",), ("other",), ("x",), (None,)], "c string")
    assert [r[0] for r in frame.select(normalise_code(F.col("c"), d.INTENT_CODES)).collect()] == ["playback_issue", "other", None, None]
    full = ensure_columns(spark.createDataFrame([(1, None)], "id int, gold_intent string"))
    assert full.columns == ["id", "gold_intent", "has_visible_resolution", "gold_decision", "gold_decision_reason", "difficulty_tier"]
    assert tuple(full.collect()[0]) == ("1", "", "", "", "", "")
    rows = [(1, "a", "other"), (2, "a", "x"), (3, "b", ""), (4, "b", "other"), (5, "b", "")]
    out = {r.stratum: (r.total, r.labelled, r.other_n, r.other_rate, r.resume_id) for r in
           label_progress(spark.createDataFrame(rows, "id long, stratum string, label string"), "id", "label", "stratum").collect()}
    assert out == {"a": (2, 2, 1, 0.5, None), "b": (3, 1, 1, 1.0, 3), "overall": (5, 3, 2, round(7 / 9, 6), 3)}
