"""Vector and TF-IDF retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WORD, ngrams_of, tokens
from ..functions.vectors import l2_normalise, norm
from ..operators import metrics as m
from ..operators.neighbours import knn
from ..operators.pivots import PivotIndex
from ..operators.sampling import balanced_sample
from ..operators.scoring import hashed_vectors
from ..operators.tfidf import fit_idf, term_counts, top_terms, weigh
from ..plans.baselines import tfidf_nearest, train_intent_model
from ..plans.runs import search_texts, store_vectors
from ..session import cut_lineage
from ..sources.tables import read_or_build
from . import views as v
from .registry import query
from .sources import scratch
from .text import SILVER, labelled_turns, silver
from .views import lit, with_

K = 3
DEEP_K = 40  # more than some scopes hold, to reach the global fallback
N_TERMS = 200


def sims(scope: str, k: int) -> str:
    """Top-k SQL; ``scope`` is a condition on (q, c)."""
    return f"""SELECT id, vec_id, similarity, rank FROM (
  SELECT q.id, c.vec_id, round(list_dot_product(q.embedding, c.embedding), 6) AS similarity,
    row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.embedding, c.embedding), 6) DESC, c.vec_id DESC) AS rank
  FROM q JOIN corpus c ON {scope}) WHERE rank <= {k}"""


@query("knn_global", with_(v.EVALF, v.CORPUS, "q AS (SELECT id, embedding FROM evalf)") + sims("true", 1))
def _(t):
    return knn(v.evalf(t), v.corpus(t), 1)


@query("topk_hits", with_(v.EVALF, v.CORPUS, "q AS (SELECT id, embedding FROM evalf)") + sims("true", K))
def _(t):
    return knn(v.evalf(t), v.corpus(t), K)


SCOPED_Q = """q AS (SELECT x.id, x.embedding, CASE WHEN x.predicted_intent IN {taxonomy} AND s.n >= {k} THEN x.predicted_intent END AS scope
  FROM classified x LEFT JOIN scope_n s ON s.silver_intent = x.predicted_intent)"""


@query("knn_scoped", with_(v.EVALF, v.CORPUS, v.CLASSIFIED, v.SCOPES, SCOPED_Q.format(taxonomy=v.IN_TAXONOMY, k=DEEP_K))
       + sims("q.scope IS NULL OR q.scope = c.silver_intent", DEEP_K))
def _(t):
    return knn(v.classified(t), v.corpus(t), DEEP_K, scopes=F.array("predicted_intent"), corpus_scope=F.col("silver_intent"), taxonomy=v.TAXONOMY)


CAND_Q = f"""cand AS (SELECT id, embedding, list_filter(list_distinct(['c' || label, 'c' || ((label + 1) % 10), 'zz']), lambda x: x IN {v.IN_TAXONOMY}) AS wanted FROM evalf),
cand_n AS (SELECT x.id, sum(s.n) AS n FROM cand x, scope_n s WHERE list_contains(x.wanted, s.silver_intent) GROUP BY 1),
q AS (SELECT x.id, x.embedding, CASE WHEN n.n >= 60 THEN x.wanted END AS scope FROM cand x LEFT JOIN cand_n n ON n.id = x.id)"""


@query("knn_candidates", with_(v.EVALF, v.CORPUS, v.SCOPES, CAND_Q)
       + sims("q.scope IS NULL OR list_contains(q.scope, c.silver_intent)", 60))
def _(t):
    wanted = F.array(F.concat(F.lit("c"), "label"), F.concat(F.lit("c"), (F.col("label") + 1) % 10), F.lit("zz"))
    return knn(v.evalf(t), v.corpus(t), 60, scopes=wanted, corpus_scope=F.col("silver_intent"), taxonomy=v.TAXONOMY)


FEW = "('c1', 'c2', 'c9')"


@query("knn_pruned", with_(v.EVALF, v.CORPUS, v.CLASSIFIED, v.SCOPES, SCOPED_Q.format(taxonomy=v.IN_TAXONOMY, k=K), f"few AS (SELECT * FROM q WHERE scope IN {FEW})")
       + sims("q.scope = c.silver_intent", K).replace("FROM q JOIN", "FROM few q JOIN"))
def _(t):
    """The corpus is stored by intent; queries of a few intents read the folders of these only."""
    path = scratch(t)
    stored = read_or_build(t.spark, path, lambda: v.corpus(t).select("vec_id", "embedding", "silver_intent"), ["silver_intent"])
    asked = v.classified(t).filter(f"predicted_intent IN {FEW} AND predicted_intent IN {v.IN_TAXONOMY}")
    enough = stored.groupBy("silver_intent").count().filter(F.col("count") >= K).select(F.col("silver_intent").alias("predicted_intent"))
    asked = asked.join(F.broadcast(enough), "predicted_intent", "left_semi")  # the others would search everything
    return knn(asked, stored, K, scopes=F.array("predicted_intent"), corpus_scope=F.col("silver_intent"), taxonomy=v.TAXONOMY, prune=True)


@query("knn_pivots", with_(v.EVALF, v.CORPUS, "q AS (SELECT id, embedding FROM evalf)") + sims("true", K))
def _(t):
    """The corpus becomes a stored index of blocks around pivots; every query then skips the blocks that cannot hold a better row."""
    index = PivotIndex.open(t.spark, scratch(t), v.corpus(t), scope=F.col("silver_intent"))
    return index.search(v.evalf(t), K).hits


@query("knn_pivots_scoped", with_(v.EVALF, v.CORPUS, v.SCOPES, CAND_Q) + sims("q.scope IS NULL OR list_contains(q.scope, c.silver_intent)", 60))
def _(t):
    """The index is opened twice: it is built, then read; only folders of the wanted intents are searched."""
    path = scratch(t)
    PivotIndex.open(t.spark, path, v.corpus(t), scope=F.col("silver_intent"))
    wanted = F.array(F.concat(F.lit("c"), "label"), F.concat(F.lit("c"), (F.col("label") + 1) % 10), F.lit("zz"))
    return PivotIndex.open(t.spark, path).search(v.evalf(t), 60, scopes=wanted, taxonomy=v.TAXONOMY).hits


@query("retrieval_intent_match", with_(v.EVALF, v.CORPUS, "q AS (SELECT id, embedding FROM evalf)", f"best AS ({sims('true', 1)})") + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE e.gold_intent = c.silver_intent) AS matched,
  {v.rate('count(*) FILTER (WHERE e.gold_intent = c.silver_intent)', 'count(*)')} AS match_rate
FROM evalf e LEFT JOIN best b ON b.id = e.id LEFT JOIN corpus c ON c.vec_id = b.vec_id WHERE e.gold_intent IN {v.IN_TAXONOMY}""")
def _(t):
    golden = v.evalf(t).filter(F.col("gold_intent").isin(*v.TAXONOMY))
    past = v.corpus(t)
    hits = knn(golden, past, 1).join(past.select("vec_id", "silver_intent"), "vec_id")
    rows = golden.select("id", "gold_intent").join(hits.select("id", "silver_intent"), "id", "left")
    return m.match_rate(rows, "gold_intent", "silver_intent")


@query("l2_normalise", """SELECT vec_id, round(norm, 6) AS norm, round(list_dot_product(u, u), 6) AS unit, round(u[1], 6) AS first, round(u[64], 6) AS last
FROM (SELECT vec_id, norm, list_transform(e, lambda x: x / norm) AS u FROM (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 4)) AS e FROM embeddings)))""")
def _(t):
    scale = 1 + F.col("vec_id") % 4
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda e: e.cast("double") * scale).alias("e")).select(
        "vec_id", norm(F.col("e")).alias("norm"), l2_normalise(F.col("e")).alias("u"))
    unit = norm(F.col("u"))
    return rows.select("vec_id", F.round("norm", 6).alias("norm"), F.round(unit * unit, 6).alias("unit"),
                       F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))




# --- TF-IDF over the customer turns ---------------------------------------

TOKENS = f"""toks AS (SELECT msg_id, regexp_extract_all(lower(text), {lit(WORD + '{2,}')}) AS w FROM users)"""
GRAMS = """grams AS (
  SELECT msg_id, unnest(w) AS term FROM toks
  UNION ALL SELECT msg_id, w[i] || ' ' || w[i + 1] FROM (SELECT msg_id, w, unnest(range(1, len(w))) AS i FROM toks)),
counts AS (SELECT msg_id AS id, term, count(*) AS tf FROM grams GROUP BY 1, 2)"""
USER_GRAMS = (v.USERS, TOKENS, GRAMS)


def vocab_sql(n: int | None, counts: str = "counts", docs: str = "users") -> str:
    return f"""vocab AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + df)) + 1.0 AS idf FROM (
  SELECT term, sum(tf) AS total, count(*) AS df FROM {counts} GROUP BY 1 ORDER BY total DESC, term {f"LIMIT {n}" if n else ""}))"""


def weights_sql(name: str, counts: str) -> str:
    return f"""{name} AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight
  FROM (SELECT c.id, c.term, (1.0 + ln(c.tf)) * o.idf AS raw FROM {counts} c JOIN vocab o ON o.term = c.term))"""


@query("ngrams", with_(v.USERS, TOKENS) + """SELECT msg_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS grams,
  greatest(2 * len(w) - 1, 0) AS n_grams FROM toks""")
def _(t):
    rows = v.user_turns(t).select("msg_id", tokens(F.col("text")).alias("w")).select("msg_id", ngrams_of(F.col("w")).alias("g"))
    return rows.select("msg_id", F.array_join("g", "|").alias("grams"), F.size("g").alias("n_grams"))


@query("vocab_topn", with_(*USER_GRAMS) + f"SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM counts GROUP BY 1 ORDER BY total DESC, term LIMIT {N_TERMS}")
def _(t):
    return top_terms(term_counts(v.user_turns(t), "msg_id", "text"), N_TERMS)


@query("tfidf_weights", with_(*USER_GRAMS, vocab_sql(None), weights_sql("w", "counts")) + "SELECT id, term, round(weight, 6) AS weight FROM w")
def _(t):
    users = v.user_turns(t)
    counts = term_counts(users, "msg_id", "text")
    return weigh(counts, fit_idf(counts, users, None)).select("id", "term", F.round("weight", 6).alias("weight"))


def digit(n: int) -> str:
    """Value of the n-th hexadecimal digit of a word's hash."""
    return f"(strpos('0123456789abcdef', substr(md5(term), {n}, 1)) - 1)"


VECTORS = f"""places AS (SELECT id, ({digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)}) % 64 AS place,
  sum(CASE WHEN {digit(5)} < 8 THEN tf ELSE -tf END)::DOUBLE AS w FROM counts WHERE NOT contains(term, ' ') GROUP BY 1, 2),
vectors AS (SELECT id, place, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0), 0.0) AS w FROM places)"""


@query("embed_batch", with_(*USER_GRAMS, VECTORS) + "SELECT id AS msg_id, place::BIGINT AS place, round(w, 6) AS weight FROM vectors WHERE w <> 0")
def _(t):
    rows = hashed_vectors(v.user_turns(t).select("msg_id", "text"), "msg_id", "text")
    return rows.select("msg_id", F.posexplode("embedding").alias("place", "weight")).filter("weight <> 0").withColumn("weight", F.round("weight", 6))


# Weakly labelled turns form the corpus, all other turns ask.
TFIDF_SIDES = """cdocs AS (SELECT msg_id FROM silver WHERE silver_intent IS NOT NULL),
qdocs AS (SELECT msg_id FROM silver WHERE silver_intent IS NULL),
ccounts AS (SELECT * FROM counts WHERE id IN (SELECT msg_id FROM cdocs)),
qcounts AS (SELECT * FROM counts WHERE id IN (SELECT msg_id FROM qdocs))"""
TFIDF_NN = f"""{vocab_sql(5000, 'ccounts', 'cdocs')}, {weights_sql('cw', 'ccounts')}, {weights_sql('qw', 'qcounts')},
nn AS (SELECT id, hit_id, similarity FROM (
  SELECT id, hit_id, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, hit_id) AS rn
  FROM (SELECT q.id, c.id AS hit_id, round(sum(q.weight * c.weight), 6) AS similarity FROM qw q JOIN cw c ON c.term = q.term GROUP BY 1, 2))
  WHERE rn = 1 AND similarity > 0)"""
TFIDF_CTES = (*USER_GRAMS, SILVER, TFIDF_SIDES, TFIDF_NN)


@query("tfidf_nn", with_(*TFIDF_CTES) + "SELECT d.msg_id AS id, n.hit_id, coalesce(n.similarity, 0.0) AS similarity FROM qdocs d LEFT JOIN nn n ON n.id = d.msg_id")
def _(t):
    rows = labelled_turns(t)
    asked = rows.filter(F.col("silver_intent").isNull()).select("id", "text")
    return tfidf_nearest(asked, rows.filter(F.col("silver_intent").isNotNull()).select("id", "text"))


# The floor is far above the share of the commonest label; the fit itself has no SQL.
TRAIN_PER_LABEL, ACCURACY_FLOOR = 60, 0.9


LOGREG = f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|{v.SEED}'), doc_id) AS rn FROM documents)
SELECT count(*) FILTER (WHERE rn <= {TRAIN_PER_LABEL}) AS train_rows, count(*) FILTER (WHERE rn > {TRAIN_PER_LABEL}) AS test_rows, true AS above_floor FROM r"""


def rated_model(t, n_terms):
    """Fitted on a balanced sample, scored on all other rows."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    # The rows are drawn without their texts; then only texts of drawn ids are ranked again, since ids may repeat.
    drawn = cut_lineage(balanced_sample(docs.select("id", "label"), "label", "id", TRAIN_PER_LABEL, v.SEED).select(F.col("id").alias("drawn")).distinct())
    held = docs.join(F.broadcast(drawn), F.col("id").eqNullSafe(F.col("drawn")), "left_semi")
    train = cut_lineage(balanced_sample(held, "label", "id", TRAIN_PER_LABEL, v.SEED).select("id", "text", "label"))
    others = docs.join(F.broadcast(train.select("id")), "id", "left_anti")
    scored = train_intent_model(train, n_terms)(others.select("id", "text"))
    rated = m.accuracy(others.select("id", "label").join(scored.select("id", "predicted"), "id"), "label", "predicted")
    return rated.select(train.agg(F.count(F.lit(1))).scalar().alias("train_rows"), F.col("total").alias("test_rows"),
                        (F.col("accuracy") >= ACCURACY_FLOOR).alias("above_floor"))


@query("logreg_baseline", LOGREG)
def _(t):
    return rated_model(t, 5000)


@query("logreg_whole_vocabulary", LOGREG)
def _(t):
    """Every term of the sample is a feature."""
    return rated_model(t, None)


SEARCH = """hits AS (SELECT id, hit_id, similarity FROM (
  SELECT q.id, c.id AS hit_id, round(sum(q.w * c.w), 6) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(sum(q.w * c.w), 6) DESC, c.id DESC) AS rn
  FROM (SELECT * FROM vectors WHERE id IN (SELECT msg_id FROM qdocs)) q JOIN (SELECT * FROM vectors WHERE id IN (SELECT msg_id FROM cdocs)) c ON c.place = q.place GROUP BY 1, 2) WHERE rn = 1 AND similarity > 0)"""


@query("text_search", with_(*USER_GRAMS, SILVER, TFIDF_SIDES, VECTORS, SEARCH) + "SELECT h.id, h.hit_id, h.similarity, s.silver_intent FROM hits h JOIN silver s ON s.msg_id = h.hit_id")
def _(t):
    """Labelled turns become a stored table of vectors, which all other turns search."""
    rows = silver(t).select("msg_id", "text", "silver_intent")
    path = scratch(t)
    for _ in range(2):  # the second time it is read
        index = store_vectors(t.spark, path, lambda: rows.filter(F.col("silver_intent").isNotNull()), "msg_id", "text")
    asked = rows.filter(F.col("silver_intent").isNull()).select(F.col("msg_id").alias("id"), "text")
    hits = search_texts(asked, index, index_id="msg_id").filter("similarity > 0")
    return hits.join(index.select("msg_id", "silver_intent"), "msg_id").select("id", F.col("msg_id").alias("hit_id"), "similarity", "silver_intent")
