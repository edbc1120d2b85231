"""The pipeline's stages on planted documents, and the registered queries on the given tables."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest
import tiktoken

from deskweave.llm import byte_bpe, catalog

RANDOM = random.Random(9)
SMALL = "/root/testdata/sf0.001"


def prose(n: int) -> str:
    parts = ["the", "an", "re", "ing", "tion", "and", "of", "to", "er", "on", "at", "en"]
    return " ".join(" ".join("".join(RANDOM.choices(parts, k=RANDOM.randint(1, 3))) for _ in range(RANDOM.randint(6, 14))).capitalize() + "." for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    item, passage = prose(3), prose(9)
    rows = [(i, prose(12)) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " x"), (102, f"{prose(3)}\n{item}\n{prose(3)}"), (103, f"{prose(6)}\n{passage}\n{prose(6)}"), (104, f"{prose(6)}\n{passage}\n{prose(6)}")]
    rows += [(105, "123 456"), (106, None), (107, ""), (3, rows[3][1]), (None, rows[4][1]), (None, prose(9))]
    frame = spark.createDataFrame([(i, t, "en" if t else None, None, len(t or "")) for i, t in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict(rows), passage


def test_planted_documents(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), SCHEMA)
        assert docs.columns == before
    left = {r["doc_id"]: r for r in docs.collect()}
    assert docs.count() == len(left) and set(left) == {*range(40), 103, 104, None}
    assert passage in left[103]["text"] and passage not in left[104]["text"] and left[104]["n_chars"] == len(left[104]["text"])
    assert all(left[i]["text"] == texts[i] for i in [*range(40), 103])
    ranks = byte_bpe.load_ranks(catalog.tokenizer_file("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=catalog.RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(left)
    for i, r in left.items():
        ids = library.encode_ordinary(r["text"])
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CONTRACTS = {
    "op1_quality": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op2_licences": ("documents", {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}),
    "op3_sharding": ("documents", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
    "op4_vectors": ("embeddings", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op5_token_counts": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op6_simhash": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op8_byte_bpe": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op9_language": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_a_row_for_each_row_of_the_table(spark, name):
    table, columns = CONTRACTS[name]
    out = catalog.queries()[name](spark, SMALL)
    assert dict(out.dtypes) == columns
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").select(out.columns[0])
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in rows.collect())


def test_vectors_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(catalog.oracle_sql()["op4_vectors"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["op4_vectors"](spark, SMALL).collect())) == sorted(want)
