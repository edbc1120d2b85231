"""Rules kept as a table, measures taken while a corpus is written, and sketches kept by day."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deskweave.functions.rules import Rule, gate_array
from deskweave.operators import rule_table, sketches
from deskweave.operators.rule_table import first_rule, required_literals, rules_that_hit, single_words
from deskweave.plans.corpus import CorpusRules, build_corpus, store_corpus

RANDOM = random.Random(6)
SYLLABLES = "ba ke li mo nu ra se ti vo zu pra gle".split()


def word():
    return "".join(RANDOM.choices(SYLLABLES, k=RANDOM.randint(2, 4)))


@pytest.mark.parametrize(("pattern", "literals"), [
    ("refund", ["refund"]), ("refund|money back", ["money back", "refund"]), ("licen[cs]ed?", ["licen"]), ("a|bcd", None), ("(abc|def)ghij", ["ghij"]), ("colou?r", ["colo"]),
    (r"not\s+(die|der)", ["not"]), (r"\bcharge(?:back)?s", ["charge"]), ("abc+d", ["abc"]), ("ab{2}cde", ["cde"]), (r"[0-9]{8,}", None), ("x[]abc]yz", None), (r"\Qabc\E", None),
    ("(?i)abcdef", None), ("abc.def", ["abc"]), ("Straße", ["stra"]), (r"abc\.def", ["abc.def"]), ("abc*defg", ["defg"]), ("^$", None), ("abcdef(?!g)", ["abcdef"]), ("ab|", None)])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_every_match_holds_a_literal():
    pieces = ["ab", "cde", "x?", "y*", "z+", "(fg|h)", "[ij]k", r"\.", "l{2}", "|", "mnop", r"\d"]
    for _ in range(3000):
        pattern = "".join(RANDOM.choices(pieces, k=RANDOM.randint(1, 6)))
        literals = required_literals(pattern)
        if literals is None:
            continue
        for _ in range(20):
            text = "".join(RANDOM.choices("abcdefghijklmnop.xyz123", k=12))
            if re.search(pattern, text):
                assert any(x in text for x in literals), (pattern, literals, text)


def test_twenty_thousand_rules_hit_as_unrolled_ones_do(spark, monkeypatch):
    words = sorted({word() + word() for _ in range(30_000)})[:20_000]
    rules = [(i % 50, w, w if i % 3 else f"{w}s?|{w[:4]}[xyz]{w[4:]}", "r", i % 2 == 0) for i, w in enumerate(words)]
    rules += [(99, "short", "zz", "r", False), (99, "null", None, "r", False), (98, "number", r"[0-9]{3,}", "digits", False)]
    texts = [" ".join(RANDOM.choices(words, k=RANDOM.randint(0, 12)) + [word()] * RANDOM.randint(0, 3)) for _ in range(300)]
    rows = [(i, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "zz top 12345"), (1003, "KELVIN Kelvin"), (3, texts[3])]
    frame = spark.createDataFrame(rows, "id long, text string")
    table = spark.createDataFrame(rules, "rank long, name string, pattern string, reason string, whole_word boolean")
    hits = rules_that_hit(frame, table).collect()
    assert Counter(r.id for r in hits)[1000] == 0 and {r.name for r in hits if r.id == 1002} == {"short", "number"}
    some = [r for i, r in enumerate(rules) if r[2] is not None and (i % 97 == 0 or i >= 20_000)]
    unrolled = [Rule(name, pattern, reason, whole) for _, name, pattern, reason, whole in some]
    want = frame.select("id", F.explode(gate_array(F.col("text"), unrolled)).alias("g")).select("id", "g.gate").collect()
    names = {r[1] for r in some}
    assert Counter((r.id, r.name) for r in hits if r.name in names) == Counter((r.id, r.gate) for r in want)
    monkeypatch.setattr(rule_table, "SHARD_LITERALS", 4_000)  # several passes find the same
    assert Counter(map(tuple, rules_that_hit(frame.dropDuplicates(), table).collect())) == Counter(set(map(tuple, hits)))
    first = {r.id: (r["rank"], r.name) for r in first_rule(rules_that_hit(frame, table)).collect()}
    assert first == {i: min((r["rank"], r.name) for r in hits if r.id == i) for i in {r.id for r in hits}}


@pytest.mark.parametrize(("pattern", "words"), [
    ("refund", ["refund"]), ("Refund|chargeback", ["chargeback", "refund"]), ("licen[CS]ed?", ["licence", "licenced", "license", "licensed"]), ("a?", None), ("ab|", None), ("", None),
    ("abc.", None), (r"a\s", None), ("x[^a]", None), ("x[a-c]", None), ("ab+", None), ("ab??", None), ("ab?+", None), ("(ab)", None), ("^ab", None), ("Straße", None), ("two words", None),
    ("[ab][ab][ab][ab][ab][ab]", None), ("ab]", None)])
def test_single_words(pattern, words):
    assert single_words(pattern) == words


def test_rules_of_single_words_are_joined_and_try_no_pattern(spark, monkeypatch):
    rules = [(1, "a", "licen[cs]ed?", "r", True), (1, "a", "licen[cs]ed?", "r", True), (2, "b", "kiss", "r", True), (3, None, "i", None, True), (4, "d", "kis", "r", True)]
    table = spark.createDataFrame(rules, "rank long, name string, pattern string, reason string, whole_word boolean")
    texts = [(1, "Licence, license and LICENSED"), (1, "Licence, license and LICENSED"), (1, "licensee"), (2, "\u212a\u0130\u017fs x"), (3, "\u0131"), (4, "ékiss kissé kis_s"), (5, "kiss\n"),
             (None, "kiss"), (6, None), (7, "")]
    frame = spark.createDataFrame(texts, "id long, text string")
    monkeypatch.setattr(rule_table, "_found", lambda *_: pytest.fail("no literal has to be searched"))
    want = Counter()
    for rank, name, pattern, reason, _ in rules:
        for r in frame.filter(Rule("x", pattern, "r", True).hits(F.col("text"))).collect():
            want[(r.id, rank, name, reason)] += 1
    hits = rules_that_hit(frame, table)
    assert Counter(map(tuple, hits.collect())) == want and want[(1, 1, "a", "r")] == 4 and want[(2, 2, "b", "r")] == want[(3, 3, None, None)] == want[(5, 2, "b", "r")] == 1
    monkeypatch.setattr(rule_table, "BROADCAST_RULES", 0)
    assert Counter(map(tuple, rules_that_hit(frame, table).collect())) == want


def test_no_rules_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "some text")], "id long, text string")
    table = spark.createDataFrame([(1, "a", "some", "r", True)], "rank long, name string, pattern string, reason string, whole_word boolean")
    assert rules_that_hit(texts, table.limit(0)).collect() == [] and rules_that_hit(texts.limit(0), table).collect() == []
    assert [tuple(r) for r in rules_that_hit(texts, table).collect()] == [(1, 1, "a", "r")]


def test_measures_of_the_pass_that_writes_the_corpus(spark, tmp_path):
    rules = CorpusRules(brand="acme", intents=(Rule("play", "song|music"), Rule("pay", "refund")), exclude=Rule("x", "wish"), redirect=Rule("dm", "dm us"), min_text=5, min_reply=10)
    asks = ["my song stops every minute", "I want a refund now please", "song refund both of them", "nothing of that at all here", "my song is gone, a wish"]
    rows = []
    for i in range(60):
        rows.append((str(i), "u", True, asks[i % 5], None))
        if i % 4:
            rows.append((str(1000 + i), "acme", False, "please dm us now thank you" if i % 4 == 1 else "restart the app and clear the cache", str(i)))
    msgs = spark.createDataFrame(rows, "msg_id string, author string, inbound boolean, text string, parent_id string").repartition(3)
    golden = spark.createDataFrame([("7",)], "msg_id string")
    corpus, measures = store_corpus(spark, str(tmp_path / "corpus"), msgs, golden, rules)
    got = measures.first().asDict()
    want = {r.tweet_id for r in build_corpus(msgs, golden, rules).collect()}
    assert {r.tweet_id for r in corpus.collect()} == want and got["corpus_rows"] == len(want) > 0
    assert got["pool_rows"] == got["corpus_rows"] + got["unanswered"] + got["not_resolving"] + got["unlabelled"]
    assert got["coverage"] == round(len(want) / got["pool_rows"], 6)
    _, none = store_corpus(spark, str(tmp_path / "none"), msgs.limit(0), golden, rules)
    assert none.first().asDict()["pool_rows"] == 0


def test_sketches_of_new_days_join_the_old_ones(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("brand"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"),
                                      (F.xxhash64("id") % 9000).alias("user"))
    path = str(tmp_path / "days")
    for part in ("day < '2024-01-04'", "day >= '2024-01-04'", "day = '2024-01-02'"):  # the last one again
        days = sketches.store_days(spark, path, rows.filter(part), ["brand"], F.col("day"), F.col("user"))
    got = {r.brand: r for r in sketches.merged(days, ["brand"]).collect()}
    for r in rows.groupBy("brand").agg(F.count_distinct("user").alias("users"), F.count(F.lit(1)).alias("n")).collect():
        assert got[r.brand].days == 10 and got[r.brand].n == r.n
        assert abs(got[r.brand].about - r.users) <= 4 * sketches.STANDARD_ERROR * r.users
    one = sketches.read_days(spark, path, days.schema).filter("day = '2024-01-02'")
    assert one.agg(F.sum("n")).first()[0] == rows.filter("day = '2024-01-02'").count()
