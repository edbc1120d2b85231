"""SentencePiece encoding and decoding against the vocabulary's own library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from deskweave.llm import catalog, pieces

RANDOM = random.Random(3)
ODD = ["", None, " ", "  a  b ", "a\tb\r\nc", "\x00 \x01a", "▁x ▁▁", "<s> <0x0A> </s>", "😀 é é ﬁ Ａ", "=" * 77, " " * 9000, "x y" * 3000, "*-" * 4000, "字" * 5000]


@pytest.fixture(scope="module")
def path():
    return catalog.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def mixtures(library, n):
    """Pieces in a row, and words of few characters, in which many merges compete."""
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    joined = ["".join(RANDOM.choices(names, k=RANDOM.randint(1, 12))) for _ in range(n)]
    few = ["".join(RANDOM.choices("abeinstr _*-=/#", k=RANDOM.randint(1, 60))) for _ in range(n)]
    return joined + few + ["".join(RANDOM.choices("abeinst* -=", k=9000))]


def test_rounds_merge_as_the_library_does(library, path):
    lexicon = pieces._Lexicon(open(path, "rb").read())
    texts = [t or "" for t in ODD] + mixtures(library, 6000)
    assert lexicon.encode(texts).to_pylist() == library.encode(texts)


def test_long_segments_merge_alike(library, path, monkeypatch):
    texts = mixtures(library, 800)
    monkeypatch.setattr(pieces, "ALONE", 3)
    assert pieces._Lexicon(open(path, "rb").read()).encode(texts).to_pylist() == library.encode(texts)


def test_forgotten_words_and_parts_of_long_texts(library, path, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "_LONG", 50)
    lexicon, texts = pieces._Lexicon(open(path, "rb").read()), mixtures(library, 40)
    assert [lexicon.encode([t]).to_pylist()[0] for t in texts] == library.encode(texts)


def test_decode_any_ids(library, path):
    rows = [[RANDOM.randrange(32000) if RANDOM.random() < 0.3 else RANDOM.randrange(262) for _ in range(RANDOM.randint(0, 30))] for _ in range(4000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = pieces._Surfaces(open(path, "rb").read()).texts(np.array([i for r in rows for i in r], np.int64), offsets)
    assert got == [library.decode(r) for r in rows]


def test_encode_and_decode_rows(spark, library, path):
    rows = [(i, t) for i, t in enumerate(ODD + mixtures(library, 30))] + [(None, "a null id"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("ids", "decoded", "k0", "t", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    encoded = pieces.encode(frame, path, [frame["doc_id"]], "doc_id bigint")
    got = pieces.decode(encoded, path).collect()
    want = [(i, tuple(library.encode(t or ""))) for i, t in rows]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter(want)
    assert Counter((r["doc_id"], r["decoded"]) for r in got) == Counter((i, library.decode(list(x))) for i, x in want)
    assert pieces.encode(frame.limit(0), path, [frame["doc_id"]], "doc_id bigint").count() == 0
    nulls = pieces.decode(spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>"), path)
    assert [r["decoded"] for r in nulls.collect()] == ["", "", ""]


def test_query_digests(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in table.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = catalog.op11_pieces(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want


def test_offsets_of_sliced_batches(library, path):
    surfaces = pieces._Surfaces(open(path, "rb").read())
    ids = pa.array([library.encode("left out"), library.encode("ein Satz"), []], pa.list_(pa.int32())).slice(1)
    flat = ids.flatten().to_numpy().astype(np.int64)
    assert surfaces.texts(flat, np.array([0, len(flat), len(flat)])) == ["ein Satz", ""]
