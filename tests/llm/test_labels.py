"""Labels of licences and languages: whole identifiers, and every language that has a text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deskweave.llm import language, licences


@pytest.mark.parametrize(("name", "permissive"), [
    ("MIT", True), ("MIT-0", True), ("Mitre-internal", False), ("mitx", False), ("BSD-3-Clause", True), ("BSD-4-Clause", True), ("BSD-Protection", False),
    ("Apache-2.0", True), ("Apache-2.0+", True), ("Apachelike-2.0", False), ("CC0-1.0", True), ("CC-BY-4.0", True), ("CC-BY-NC-4.0", False), ("CC-BY-SA-3.0", False),
    ("BSL-1.0", True), ("BUSL-1.1", False), ("Python-2.0.1", True), ("PSF-2.0", True), ("Zlib", True), ("zlib-acknowledgement", False), ("GPL-3.0-only", False)])
def test_only_whole_identifiers_are_permissive(name, permissive):
    assert licences.parse_expression(name).permissive == permissive


def test_licences_of_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan_licences(frame, [frame["doc_id"]], "doc_id long").count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """More labels than the sample has texts for: one text of each is learned all the same."""
    monkeypatch.setattr(language, "TEXTS_IN_ALL", 500)
    rows = [(f"l{i}", f"{chr(0x4E00 + i) * 12} {n}") for i in range(450) for n in range(4)] + [("many", f"so many words {i}") for i in range(900)] + [(None, "no label"), ("blank", " ")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    drawn = language.training_windows(docs, "text", F.col("lang")).groupBy("lang").count().collect()
    assert {r["lang"] for r in drawn} == {*(f"l{i}" for i in range(450)), "many"}
    assert sum(r["count"] for r in drawn) < 1500


def test_rare_languages_are_named(spark):
    rows = [("en", f"the quick brown fox and the lazy dog {i}") for i in range(60)] + [("ja", "こんにちは世界"), ("ru", "привет мир и война")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = language.fit(docs, "text", F.col("lang"))
    assert model.names == ["en", "ja", "ru"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model, [docs["doc_id"]], "doc_id long").collect()}
    assert got[60] == "ja" and got[61] == "ru" and got[0] == "en"
