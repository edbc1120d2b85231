"""The support-domain views over the test tables, in Spark and as SQL.

The test texts are invented words, so the rules here are word rules of the same
shape as the domain defaults.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.defaults import AUTO_HANDLE, ESCALATE, Sop
from ..functions.rules import Rule, first_gate
from ..functions.text import HANDLE, SPACE
from ..operators.neighbours import knn
from ..operators.sampling import stratified_split
from ..operators.triage import decide
from ..session import cut_lineage
from ..sources.tables import spread

BRAND = "assistant"
LABELS = tuple(f"c{i}" for i in range(10))
TAXONOMY = LABELS[:9]  # c9 plays the out-of-taxonomy label
OTHER = "c9"
TAU_LOW, TAU_HIGH = 0.22, 0.27
TAUS = (0.15, 0.20, 0.22, 0.25, 0.27, 0.30, 0.35, 0.40)
GRID_LOWS = (0.15, 0.20, 0.22, 0.25)
GRID_HIGHS = (0.22, 0.27, 0.30, 0.35)
SEED = 42

INTENT_WORDS = (
    Rule("en_the", "the|that"), Rule("en_of", "of|from"), Rule("de", "der|die|und"),
    Rule("fr", "les|des|que"), Rule("es", "los|las|para"),
)
EXCLUDE_WORDS = Rule("exclude", "with|von")
REDIRECT_WORDS = Rule("redirect", "this|nicht")
ANY_DM_WORDS = Rule("any_dm", "this|nicht|para")
ACTION_WORDS = Rule("action", "was|zu|en|le|is")
QUESTION_WORDS = Rule("question", "by|von")
GATES = (
    Rule("billing_dispute", r"licen[cs]ed?|copyright", "licence wording"),
    Rule("account_security", r"[A-Za-z0-9._]@[A-Za-z0-9]", "contact data", whole_word=False),
    Rule("legal_safety", r"[0-9]{8,}", "long number", whole_word=False),
    Rule("exhausted_troubleshooting", r"worthless|nicht\s+(die|der)", "junk wording"),
)
CATCH_ALL = Rule("out_of_taxonomy", "", "outside the taxonomy")
LANG_SOPS = (
    Sop("en", "EN_1", "English first", ("worthless", "retion"), ("1. one", "2. two")),
    Sop("en", "EN_2", "English second", ("thtion", "onble"), ("1. uno", "2. due", "3. tre")),
    Sop("en", "EN_3", "English third", ("erble",), ("1. last",)),
    Sop("fr", "FR_1", "French first", ("étion",), ("1. un", "2. deux")),
    Sop("fr", "FR_2", "French second", ("ément", "èment"), ("1. trois",)),
    Sop("de", "DE_1", "German first", ("nicht",), ("1. eins",)),
    Sop("de", "DE_2", "German second", ("ensch", "enlich"), ("1. zwei", "2. drei")),
)
LABEL_SOPS = tuple(
    Sop(f"c{i}", f"C{i}_{rank}", f"Procedure {rank} of c{i}", triggers, (f"1. start {i}", f"2. end {rank}"))
    for i in range(6) for rank, triggers in ((1, ("étion", "worthless")), (2, ("ing", "ung")), (3, ("ment",)))
)


SCHEMAS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


class Tables:
    """Lazy access to the parquet tables of one folder; known schemas spare a look at the files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.views: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        frame = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)
        return frame

    def texts(self) -> DataFrame:
        """Documents for pattern work, which is bound by CPU, not by reading."""
        return spread(self.documents)


# --- SQL text helpers ------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(rule: Rule, col: str) -> str:
    return f"coalesce(regexp_matches({col}, {lit('(?i)' + rule.regex)}), false)"


def trim(col: str) -> str:
    return f"regexp_replace({col}, {lit(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def view(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Build a view once per query; the frame is then shared by its uses."""

    @functools.wraps(build)
    def once(t: Tables) -> DataFrame:
        if build.__name__ not in t.views:
            t.views[build.__name__] = build(t)
        return t.views[build.__name__]

    return once


def strip(col: str) -> str:
    """SQL twin of strip_handles."""
    return trim(f"regexp_replace(coalesce({col}, ''), {lit(f'^({HANDLE}{SPACE}*)+')}, '')")


def hits_list(rules, col: str) -> str:
    items = ", ".join(f"CASE WHEN {hit(r, col)} THEN {lit(r.name)} END" for r in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def first_gate_sql(rules, text: str, intent: str | None = None, what: str = "name") -> str:
    whens = " ".join(f"WHEN {hit(r, text)} THEN {lit(getattr(r, what))}" for r in rules)
    if intent:
        whens += f" WHEN {intent} = {lit(OTHER)} THEN {lit(getattr(CATCH_ALL, what))}"
    return f"CASE {whens} END"


def sop_sql(sops, intent: str, text: str, what) -> str:
    """CASE picking ``what(sop)`` (an SQL expression) of the matching procedure."""
    whens = []
    for name in dict.fromkeys(s.intent for s in sops):
        group = [s for s in sops if s.intent == name]
        for s in group:
            trig = " OR ".join(f"contains(lower({text}), {lit(t)})" for t in s.triggers)
            whens.append(f"WHEN {intent} = {lit(name)} AND ({trig}) THEN {what(s)}")
        whens.append(f"WHEN {intent} = {lit(name)} THEN {what(group[0])}")
    return "CASE " + " ".join(whens) + " END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- views -----------------------------------------------------------------


@view
def msgs(t: Tables) -> DataFrame:
    """Messages with the reply edge to the previous turn."""
    msg_id = F.col("conv_id") * 1000000 + F.col("turn")
    return t.conversations.select(
        msg_id.alias("msg_id"), F.col("role").alias("author"), (F.col("role") == "user").alias("inbound"), "text",
        F.when(F.col("turn") > 0, msg_id - 1).alias("parent_id"), "conv_id", "turn")


MSGS = """msgs AS (
  SELECT conv_id*1000000 + turn AS msg_id, role AS author, role = 'user' AS inbound, text,
         CASE WHEN turn > 0 THEN conv_id*1000000 + turn - 1 END AS parent_id, conv_id, turn
  FROM conversations)"""


@view
def user_turns(t: Tables) -> DataFrame:
    return msgs(t).filter("inbound").select("msg_id", "text")


USERS = "users AS (SELECT conv_id*1000000 + turn AS msg_id, text FROM conversations WHERE role = 'user')"


@view
def replies(t: Tables) -> DataFrame:
    return msgs(t).filter(F.col("author") == BRAND).select("msg_id", "text")


REPLIES = "replies AS (SELECT conv_id*1000000 + turn AS msg_id, text FROM conversations WHERE role = 'assistant')"


@view
def evalf(t: Tables) -> DataFrame:
    """Labelled rows that have a vector: the golden set."""
    gold = t.labels.select(
        F.col("doc_id").alias("id"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), ESCALATE).otherwise(AUTO_HANDLE).alias("gold_decision"))
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("customer_text"), "lang",
        F.when(F.col("n_chars") < 1500, "easy").otherwise("hard").alias("difficulty_tier"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.concat(F.lit("c"), F.col("label")).alias("gold_intent"), "embedding")
    return vectors.join(gold, "id").join(docs, "id")


EVALF = """evalf AS (
  SELECT e.vec_id AS id, e.label, 'c' || e.label AS gold_intent, e.embedding::DOUBLE[] AS embedding,
         CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'escalate' ELSE 'auto_handle' END AS gold_decision,
         d.text AS customer_text, d.lang, CASE WHEN d.n_chars < 1500 THEN 'easy' ELSE 'hard' END AS difficulty_tier
  FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id JOIN documents d ON d.doc_id = e.vec_id)"""


@view
def golden_ids(t: Tables) -> DataFrame:
    """Ids of the golden set alone (no texts or vectors are read), written down once for all that need them."""
    return cut_lineage(t.embeddings.select(F.col("vec_id").alias("id")).join(
        t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi").join(
        t.documents.select(F.col("doc_id").alias("id")), "id", "left_semi"))


@view
def corpus(t: Tables) -> DataFrame:
    """Past cases: vectors outside the golden set."""
    rows = t.embeddings.select("vec_id", "embedding", "label", F.concat(F.lit("c"), F.col("label")).alias("silver_intent"))
    return rows.join(golden_ids(t).withColumnRenamed("id", "vec_id"), "vec_id", "left_anti")


CORPUS = """corpus AS (
  SELECT e.vec_id, e.embedding::DOUBLE[] AS embedding, e.label, 'c' || e.label AS silver_intent
  FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id = e.vec_id))"""


def predicted_intent() -> Column:
    """Stand-in for a stored classifier answer, right for about four rows in five."""
    return F.when(F.col("id") % 5 != 0, F.concat(F.lit("c"), F.col("label"))).otherwise(
        F.concat(F.lit("c"), (F.col("label") + 1) % 10))


PREDICTED = "CASE WHEN id % 5 <> 0 THEN 'c' || label ELSE 'c' || ((label + 1) % 10) END"


def verdict() -> Column:
    """Stand-in for a stored verifier verdict; some rows have none."""
    return F.when(F.col("id") % 7 != 0, F.col("id") % 3 != 0)


VERDICT = "CASE WHEN id % 7 <> 0 THEN id % 3 <> 0 END"


@view
def classified(t: Tables) -> DataFrame:
    """Golden rows with the stored intent and confidence."""
    return evalf(t).withColumn("predicted_intent", predicted_intent()).withColumn(
        "confidence", F.lit(0.5) + (F.col("id") % 50) / 100)


CLASSIFIED = f"classified AS (SELECT *, {PREDICTED} AS predicted_intent, 0.5 + (id % 50) / 100.0 AS confidence FROM evalf)"


@view
def top1(t: Tables) -> DataFrame:
    """(id, hit_id, similarity): best past case within the predicted intent."""
    found = knn(judged(t).select("id", "embedding", "predicted_intent"), corpus(t), 1,
                scopes=F.array("predicted_intent"), corpus_scope=F.col("silver_intent"), taxonomy=TAXONOMY)
    return found.select("id", F.col("vec_id").alias("hit_id"), "similarity")


SCOPES = """scope_n AS (SELECT silver_intent, count(*) AS n FROM corpus GROUP BY 1)"""
IN_TAXONOMY = "(" + ", ".join(lit(x) for x in TAXONOMY) + ")"


def top1_sql(k: int = 1) -> str:
    return f"""sims AS (
  SELECT q.id, c.vec_id AS hit_id, round(list_dot_product(q.embedding, c.embedding), 6) AS similarity
  FROM (SELECT x.id, x.embedding, CASE WHEN x.predicted_intent IN {IN_TAXONOMY} AND s.n >= {k} THEN x.predicted_intent END AS scope
        FROM classified x LEFT JOIN scope_n s ON s.silver_intent = x.predicted_intent) q
  JOIN corpus c ON q.scope IS NULL OR q.scope = c.silver_intent),
top1 AS (
  SELECT id, hit_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, hit_id DESC) AS rn FROM sims) WHERE rn <= {k})"""


@view
def judged(t: Tables) -> DataFrame:
    """Golden rows with their first gate and verdict instead of the text; written down, since search, gates and splits all start here."""
    gate = first_gate(F.col("customer_text"), GATES, F.col("predicted_intent"), OTHER, CATCH_ALL)
    return cut_lineage(classified(t).select("id", "gold_intent", "predicted_intent", "confidence", "difficulty_tier", "gold_decision", "embedding",
                                            gate.alias("gate"), verdict().alias("resolves")))


@view
def gated_rows(t: Tables) -> DataFrame:
    """Stored intents plus best case, first gate and verdict, without texts and vectors."""
    return judged(t).drop("embedding").join(top1(t), "id", "left")


def preds(t: Tables, tau_low: float = TAU_LOW, tau_high: float = TAU_HIGH) -> DataFrame:
    """Decided golden rows."""
    rows = gated_rows(t).withColumn("r", decide(F.col("gate"), F.col("similarity"), F.col("resolves"), None, tau_low, tau_high))
    return rows.select(
        "id", "gold_intent", "predicted_intent", "confidence", "difficulty_tier", "gold_decision", "hit_id", "similarity",
        "resolves", F.col("gate").isNotNull().alias("gated"), "r.decision", "r.decision_layer", "r.gate_triggered",
        "r.threshold_used", "r.calibrated_confidence",
        F.when(F.col("r.decision") == ESCALATE, "none")
        .when(F.col("hit_id") % 2 == 0, "retrieved_case").otherwise("curated_sop").alias("grounding_source"))


def decided_sql(low: float = TAU_LOW, high: float = TAU_HIGH, use_verdict: bool = True) -> str:
    v = "resolves" if use_verdict else "NULL::BOOLEAN"
    calibrated = "layer_2_calibrated_confidence"
    return f"""gated_rows AS (
  SELECT c.id, c.gold_intent, c.predicted_intent, c.confidence, c.difficulty_tier, c.gold_decision,
         {first_gate_sql(GATES, 'c.customer_text', 'c.predicted_intent')} AS gate,
         {VERDICT.replace('id', 'c.id')} AS resolves, t.hit_id, t.similarity
  FROM classified c LEFT JOIN top1 t ON t.id = c.id),
ruled AS (
  SELECT *, coalesce(similarity, 0.0) AS s,
    CASE WHEN gate IS NOT NULL THEN 1 WHEN coalesce(similarity, 0.0) < {low} THEN 2 WHEN {v} = false THEN 3
         WHEN similarity >= {high} THEN 4 WHEN {v} = true THEN 5 ELSE 6 END AS rule FROM gated_rows),
preds AS (
  SELECT id, gold_intent, predicted_intent, confidence, difficulty_tier, gold_decision, hit_id, similarity, resolves,
    gate IS NOT NULL AS gated,
    CASE WHEN rule IN (4, 5) THEN 'auto_handle' ELSE 'escalate' END AS decision,
    CASE rule WHEN 1 THEN 'layer_1_hard_gate' WHEN 3 THEN 'layer_2_resolution_check_veto'
              WHEN 5 THEN 'layer_2_resolution_check_verified' ELSE '{calibrated}' END AS decision_layer,
    CASE rule WHEN 1 THEN gate WHEN 3 THEN 'resolution_check_veto' END AS gate_triggered,
    CASE WHEN rule IN (4, 6) THEN {high}::DOUBLE ELSE {low}::DOUBLE END AS threshold_used,
    s AS calibrated_confidence,
    CASE WHEN rule NOT IN (4, 5) THEN 'none' WHEN hit_id % 2 = 0 THEN 'retrieved_case' ELSE 'curated_sop' END AS grounding_source
  FROM ruled)"""


PREDS_CTES = (EVALF, CORPUS, CLASSIFIED, SCOPES, top1_sql(), decided_sql())
PREDS = with_(*PREDS_CTES)


def split_preds(t: Tables) -> DataFrame:
    """Decided rows with their half of an exact stratified split.

    The split needs ids and strata only, so it is made before the scoring.
    """
    halves = with_split(judged(t).select("id", "gold_intent", "difficulty_tier")).select("id", "split")
    return preds(t).join(halves, "id")


def with_split(rows: DataFrame, size: int | float = 0.5) -> DataFrame:
    stratum = F.concat_ws("_", "gold_intent", "difficulty_tier")
    return stratified_split(rows.withColumn("stratum", stratum), ["stratum"], "id", size, SEED)


def split_sql(source: str, name: str = "split_rows", size: str = "(total + 1) // 2", extra: str = "*") -> str:
    return f"""numbered AS (
  SELECT *, concat_ws('_', gold_intent, difficulty_tier) AS stratum,
    row_number() OVER (ORDER BY concat_ws('_', gold_intent, difficulty_tier), md5(id || '|{SEED}'), id) AS r,
    count(*) OVER () AS total FROM {source}),
{name} AS (
  SELECT * EXCLUDE (r, total), CASE WHEN (r * ({size}) + total - 1) // total > ((r - 1) * ({size}) + total - 1) // total
    THEN 'held_out' ELSE 'calibration' END AS split FROM numbered)"""


def ratings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(human, judge) ratings of the labelled documents."""
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") < 1500, "easy").otherwise("hard").alias("difficulty_tier"))
    rows = t.labels.join(docs, "doc_id")

    def side(score: Column, prefix: str, tone: Column) -> DataFrame:
        return rows.select(
            F.col("doc_id").alias("id"), "difficulty_tier", score.alias(f"{prefix}_score"), tone.alias(f"{prefix}_tone"),
            F.when(score >= 4, "pass").otherwise("fail").alias(f"{prefix}_decision"))

    doc, good = F.col("doc_id"), F.col("quality")
    return side(1 + doc % 5, "human", 1 + doc % 3), side(1 + (doc + good) % 5, "judge", 1 + (doc + F.col("toxic")) % 4)


RATINGS = """ratings AS (
  SELECT l.doc_id AS id, CASE WHEN d.n_chars < 1500 THEN 'easy' ELSE 'hard' END AS difficulty_tier,
    1 + l.doc_id % 5 AS human_score, 1 + l.doc_id % 3 AS human_tone,
    CASE WHEN 1 + l.doc_id % 5 >= 4 THEN 'pass' ELSE 'fail' END AS human_decision,
    1 + (l.doc_id + l.quality) % 5 AS judge_score, 1 + (l.doc_id + l.toxic) % 4 AS judge_tone,
    CASE WHEN 1 + (l.doc_id + l.quality) % 5 >= 4 THEN 'pass' ELSE 'fail' END AS judge_decision
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def rate(part: str, whole: str) -> str:
    return f"round(coalesce(({part})::DOUBLE / nullif({whole}, 0), 0), 6)"
