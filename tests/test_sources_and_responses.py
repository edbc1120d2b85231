"""Sources, stored results, scorer answers and the incremental run."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskweave.functions import responses as p
from deskweave.functions.vectors import l2_normalise
from deskweave.operators import tfidf
from deskweave.operators.scoring import cache_valid, misses, new_entries
from deskweave.operators.tfidf import fit_idf, sparse_rows, term_counts
from deskweave.plans.baselines import _ml_vectors, _numbered, train_intent_model
from deskweave.plans.corpus import messages_from_dump
from deskweave.plans.spot_check import spot_check
from deskweave.plans.triage import triage_batch
from deskweave.session import checkpoint_dir, cut_lineage
from deskweave.sources import tables as s
from deskweave.streaming.incremental import triage_available
from test_triage import settings, triage_frames


def test_dump_scan(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Tweet ID,author_id, Inbound ,text,in_response_to_tweet_id\n1,u,True,"a ""quoted""\nline, with comma",\n2,brand,False,plain,1\n', encoding="utf-8")
    dump = s.scan_messages(spark, str(tmp_path / "d.csv"))
    assert dump.columns == ["tweet_id", "author_id", "inbound", "text", "in_response_to_tweet_id"]
    rows = messages_from_dump(dump).orderBy("msg_id").collect()
    assert [tuple(r) for r in rows] == [("1", "u", True, 'a "quoted"\nline, with comma', None), ("2", "brand", False, "plain", "1")]


def test_typed_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,gold_intent,difficulty_tier,predicted_intent,confidence,reason\ngs_1,a,easy,b,0.5,\n")
    assert tuple(s.scan_typed(spark, str(tmp_path / "p.csv"), s.PREDICTION_SCHEMA).collect()[0]) == ("gs_1", "a", "easy", "b", 0.5, None)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sink_round_trip(spark, tmp_path, fmt):
    rows = [("1", ' lead "q" \r\n tail '), ("2", "é😡,x")]
    path = str(tmp_path / fmt)
    for _ in range(2):  # overwrite
        s.sink_table(spark.createDataFrame(rows, "id string, text string"), path, fmt)
    assert sorted(tuple(r) for r in s.scan_messages(spark, path, fmt).collect()) == rows


def test_read_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(5).withColumn("part", F.col("id") % 2)

    assert s.read_or_build(spark, path, build, ["part"]).count() == 5
    assert s.read_or_build(spark, path, build, ["part"]).count() == 5 and len(built) == 1


def test_cache_store(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    path = str(tmp_path / "cache")
    assert s.read_cache(spark, path, schema).count() == 0
    for rows in ([("a", 1), ("a", 1)], [("a", 2), ("b", 3)]):
        s.append_new(spark.createDataFrame(rows, schema), path, s.read_cache(spark, path, schema), "k")
    store = s.read_cache(spark, path, schema)
    assert sorted(tuple(r) for r in store.collect()) == [("a", 1), ("b", 3)]
    asked = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [r.k for r in misses(asked, store, "k").collect()] == ["c"] == [r.k for r in s.still_to_do(asked, store, "k").collect()]
    scored = spark.createDataFrame([("a", True), ("x", False), ("y", True)], "k string, cacheable boolean")
    assert [r.k for r in new_entries(scored, store, "k").collect()] == ["y"]


def test_cache_valid(spark):
    full = spark.createDataFrame([(1, "m"), (2, "m")], "id int, judge_model string")
    assert cache_valid(full, full, "m").collect()[0].valid
    assert not cache_valid(full, full, "n").collect()[0].valid
    assert not cache_valid(full.limit(1), full, "m").collect()[0].valid
    assert not cache_valid(full.filter("false"), full.filter("false"), "m").collect()[0].valid


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark, "/unused") == spark.conf.get("spark.checkpoint.dir")
    assert cut_lineage(spark.range(3)).count() == 3


def test_json_report(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.5)], "metric string, value double")
    s.sink_json_report(report, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.schema(report.schema).json(str(tmp_path / "r")).collect()] == [("a", 1.5)]
    assert json.loads(report.select(s.report_json(["metric", "value"])).collect()[0][0]) == {"metric": "a", "value": 1.5}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("g", 2, "b", "y", None), ("g", 1, "a", "x", "why"), ("other", 1, "c", "z", "")],
                                  "rule_set string, rank int, name string, pattern string, reason string")
    assert [(r.name, r.pattern, r.reason) for r in s.read_rules(table, "g")] == [("a", "x", "why"), ("b", "y", "")]
    with pytest.raises(ValueError):
        s.read_rules(table, "g", limit=1)


def test_spot_check(spark):
    golden = spark.createDataFrame([(i, "a" if i % 2 else "zz", "easy", f"@u text {i}", [1.0, float(i)]) for i in range(30)],
                                   "id long, gold_intent string, difficulty_tier string, customer_text string, embedding array<double>")
    cases = spark.createDataFrame([(1, [1.0, 0.0], "a", "old", "reply"), (2, [0.0, 9.0], "b", "x", "y")],
                                  "vec_id long, embedding array<double>, silver_intent string, clean_text string, brand_reply_text string")
    out = spot_check(golden, cases, ["a", "b"], 5).collect()
    assert len(out) == 5 and all((r.gold_intent, r.hit_id, r.similarity, r.retrieved_reply) == ("a", 1, 1.0, "reply") for r in out)
    assert all(r["query"] == f"text {r.id}" for r in out)


def test_intent_answers(column):
    raw = ['{"intent": " Playback_Issue ", "confidence": 0.9, "reason": "r"}', '{"intent": "the account_login one"}', '{"intent": "zz", "confidence": 1}',
           "not json", '["playback_issue"]', '{"intent": "a', None, "{}", '{"intent": "account_login", "confidence": "0.9"}',
           '{"intent": "account_login", "confidence": "high"}', '{"intent": "account_login", "confidence": true}', '{"intent": "account_login", "confidence": "NaN"}']
    got = [(r.intent, r.confidence) for r in column(p.parse_intent, raw)]
    assert got == [("playback_issue", 0.9), ("account_login", 0.0), ("zz", 1.0), ("playback_issue", 0.2), ("playback_issue", 0.2),
                   ("playback_issue", 0.2), ("playback_issue", 0.2), ("", 0.0), ("account_login", 0.9), ("account_login", 0.0), ("account_login", 0.0),
                   ("account_login", 0.0)]


def test_verdict_answers(column):
    raw = ['ok {"resolves_problem": true, "confidence": 0.7, "reason": " r "} bye', "no block", '{"confidence": 1}', '{"a": {"b": 1}}\n{"x"', None, "{broken}"]
    got = [(r.resolves_problem, r.confidence, r.reason, r.cacheable) for r in column(p.parse_verdict, raw)]
    assert got[0] == (True, 0.7, "r", True) and got[1][:2] == (False, 0.5) and got[1][3]
    assert got[2] == (False, 1.0, "", True)
    assert [x[1] for x in got[4:]] == [0.0, 0.0] and not any(x[3] for x in got[4:])
    raw = ['{"resolves_problem": true, "confidence": "0.7"}', '{"resolves_problem": "True", "confidence": "sure"}', '{"resolves_problem": 1}', '{"resolves_problem": "no"}']
    got = [(r.resolves_problem, r.confidence, r.cacheable) for r in column(p.parse_verdict, raw)]
    assert got == [(True, 0.7, True), (True, 0.8, True), (True, 0.8, True), (False, 0.8, True)]


def test_judge_answers_and_guardrails(spark, column):
    raw = ['{"groundedness_score": 5, "tone_score": "4", "judge_decision": " PASS "}', "nothing", '{"groundedness_score": "x", "judge_decision": "pass"}', "{}"]
    got = [(r.groundedness_score, r.tone_score, r.judge_decision) for r in column(p.parse_judge, raw)]
    assert got == [(5, 4, "pass"), (3, 3, "fail"), (3, 3, "fail"), (3, 3, "fail")]
    rows = [(5, "pass", False, 100), (5, "pass", True, 100), (5, "pass", False, 281), (5, "fail", False, 281), (2, "pass", False, 100)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, d string, u boolean, n int").orderBy("i")
    judged = F.struct(F.col("s").alias("groundedness_score"), F.lit(4).alias("tone_score"), F.col("d").alias("judge_decision"), F.lit("").alias("judge_notes"))
    out = frame.select(p.judge_guardrails(judged, F.col("u"), F.col("n")).alias("r")).select("r.*").collect()
    assert [(r.groundedness_score, r.judge_decision) for r in out] == [(5, "pass"), (1, "fail"), (5, "fail"), (5, "fail"), (2, "pass")]


def test_fewshot_messages(column):
    out = column(lambda c: p.fewshot_messages(c, "system text", [("q", "{}")]), ["hi", None])
    assert [(m.role, m.content) for m in out[0]] == [
        ("system", "system text"), ("user", 'Customer tweet: "q"'), ("assistant", "{}"), ("user", 'Customer tweet: "hi"')]
    assert out[1][-1].content == 'Customer tweet: ""'


def test_l2_normalise(column):
    out = column(l2_normalise, [[3.0, 4.0], [0.0, 0.0], []], "v array<double>")
    assert out == [[0.6, 0.8], [0.0, 0.0], []]


def test_intent_model_learns(spark):
    rows = [(i, w + f" extra{i % 5}", label) for i in range(60) for label, w in (("a", "alpha apple"), ("b", "beta bird"))]
    train = spark.createDataFrame([(j, t, y) for j, (_, t, y) in enumerate(rows)], "id long, text string, label string")
    predict = train_intent_model(train, n_terms=50, max_iter=30)
    out = {r.id: r.predicted for r in predict(spark.createDataFrame([(1, "alpha"), (2, "bird bird"), (3, "unknown")], "id long, text string")).collect()}
    assert out[1] == "a" and out[2] == "b" and out[3] in ("a", "b")


def test_incremental_run_equals_batch(spark, tmp_path):
    messages, corpus, empty = triage_frames(spark)
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    messages.filter("id <= 'm3'").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
        triage_available(stream, corpus, settings(), empty, out, marks).awaitTermination()
        return sorted((r.id, r.decision, r.gate_triggered) for r in spark.read.parquet(out).collect())

    batch = sorted((r.id, r.decision, r.gate_triggered) for r in triage_batch(messages, corpus, settings(), empty)[0].collect())
    assert run() == batch[:3]
    messages.filter("id > 'm3'").coalesce(1).write.mode("append").parquet(source)
    assert run() == batch  # the second run saw only the new file
    assert run() == batch


def test_a_damaged_file_costs_only_its_entries(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", True), ("b", False)], "verdict_key string, resolves_problem boolean")
    rows.coalesce(1).write.parquet(path)
    (tmp_path / "cache" / "part-damaged.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    assert sorted(r.verdict_key for r in s.read_cache(spark, path, rows.schema).collect()) == ["a", "b"]
    assert s.read_cache(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_a_model_of_the_whole_vocabulary_stays_sparse(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([f"word{i}", *rng.choices(["common", "some", "other"], k=rng.randint(1, 9)), *(["playing", "song"] if i % 3 else ["paying", "bill"]), f"tail{i}"]),
             "play" if i % 3 else "pay") for i in range(120)]
    train = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    counts = term_counts(train, "id", "text")
    idf = _numbered(fit_idf(counts, train, None)).cache()
    numbers = sorted(r.term_ix for r in idf.collect())
    assert numbers == list(range(len(numbers))) and len(numbers) > 240
    vectors = [r.features for r in _ml_vectors(sparse_rows(counts, idf, None), len(numbers)).collect()]
    assert len(vectors) == 120 and all(type(v).__name__ == "SparseVector" and v.size == len(numbers) and len(v.indices) < 40 for v in vectors)
    idf.unpersist()
    predict = train_intent_model(train, n_terms=None, max_iter=50)
    asked = spark.createDataFrame([(1, "a new song is playing"), (2, "the bill, paying again"), (3, "unheard"), (4, None)], "id long, text string")
    got = {r.id: r.predicted for r in predict(asked).collect()}
    assert got[1] == "play" and got[2] == "pay" and set(got) == {1, 2, 3, 4}


def test_known_terms_are_counted_where_a_text_is_read(spark, monkeypatch):
    """The counts are those of all terms, less the unknown ones; rows of one id are one document, and no text or unknown term is shuffled."""
    texts = [(1, "play my song, play my SONG"), (1, "my song again"), (2, "nothing known"), (3, None), (3, "song"), (4, ""), (None, "été my song"), (5, "song " * 50 + "my"), (6, "my")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    terms = pa.array(["my song", "song", "my", "song song", "été", "again my"])
    want = {(r.id, r.term): r.tf for r in tfidf.term_counts(docs, "id", "text").collect() if r.term in terms.to_pylist()}
    for at_once in (2_000_000, 3):
        monkeypatch.setattr(tfidf, "_WORDS_AT_ONCE", at_once)
        counted = tfidf.known_counts(docs, "id", "text", terms)
        got = Counter()
        for r in counted.collect():
            for e in r.entries:
                got[(r.id, terms[e.terms].as_py())] += e.counts
        assert got == want and got[(1, "my song")] == 3 and got[(5, "song song")] == 49
    assert tfidf.known_counts(docs.limit(0), "id", "text", terms).collect() == []
    assert "explode" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_known_terms_equal_the_joined_ones(spark):
    """Equal ids are one document; a text without a known term has no row, and a null id keeps one."""
    texts = [(1, "open the app and open the door"), (2, None), (3, "zz yy"), (4, "the door"), (1, "the app"), (None, "app app"), (5, "The APP the app"), (6, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    counts = term_counts(docs, "id", "text")
    idf = fit_idf(counts, docs, 9)
    want = {r.id: (r.terms, r.weights) for r in sparse_rows(counts, idf, 9).collect()}
    found = tfidf.known_rows(docs, "id", "text", idf.toArrow().sort_by("term_ix").combine_chunks())
    assert dict(found.dtypes) == dict(sparse_rows(counts, idf, 9).dtypes)
    got = {r.id: (r.terms, r.weights) for r in found.collect()}
    assert got.keys() == want.keys() and None in got
    for i, (terms, weights) in want.items():
        assert got[i][0] == terms and got[i][1] == pytest.approx(weights, abs=1e-12)
    none = docs.filter("id = 3")
    assert tfidf.known_rows(none, "id", "text", idf.toArrow().sort_by("term_ix").combine_chunks()).collect() == []
    assert tfidf.known_rows(docs, "id", "text", idf.toArrow().slice(0, 0)).collect() == []


def test_turns_are_labelled_once_for_both_sides(spark, tmp_path, monkeypatch):
    """Neither side reads the table again, and only terms of the corpus are spread row by row."""
    from deskweave import catalog
    from deskweave.catalog import compositions
    from deskweave.plans import baselines

    words = ["the app is open", "der app und nicht", "nothing here", "les that"]
    turns = [(i, 0, "user", f"{words[i % 4]} word{i % 5}") for i in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sides, spread = [], []
    report, counts = compositions.retrieval_policy_report, baselines.term_counts
    monkeypatch.setattr(compositions, "retrieval_policy_report", lambda golden, corpus, *a: sides.extend((golden, corpus)) or report(golden, corpus, *a))
    monkeypatch.setattr(baselines, "term_counts", lambda docs, *a: spread.append(docs) or counts(docs, *a))
    assert len(catalog.queries()["baseline3_report"](spark, str(tmp_path)).collect()) == 6
    assert len(sides) == 2 and not any("parquet" in x._jdf.queryExecution().toString() for x in sides)
    assert len(spread) == 1
