"""Passages made of sentences that also occur singly, against plain search for the longest runs."""

from __future__ import annotations

import random

from deskweave.llm import passages

RANDOM = random.Random(23)
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in range(90)]


def sentence(n=12):
    return " ".join(RANDOM.choices(WORDS, k=n)) + "."


def cut_words(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.remove_repeats(frame, [frame["doc_id"]], "doc_id long").collect()
    return {r["doc_id"]: [(c["n_words"], c["kept_id"]) for c in r["cuts"]] for r in got}, {r["doc_id"]: r["clean"] for r in got}


def test_a_passage_of_sentences_that_occur_singly_is_cut_from_its_copies(spark):
    own = [sentence() for _ in range(6)]
    rows = [(i + 1, f"{sentence()} {own[i]} {sentence()}") for i in range(6)]
    passage = " ".join(own)
    rows += [(10, f"{sentence()} {passage} {sentence()}"), (11, f"{sentence()} {passage} {sentence()}"), (12, f"{passage} {sentence(20)}")]
    cuts, clean = cut_words(spark, rows)
    for i in (11, 12):
        assert sum(n for n, _ in cuts[i]) >= 72 and {k for _, k in cuts[i]} == {10}, cuts[i]
        assert not any(s in clean[i] for s in own)
    assert all(not cuts[i] for i in [*range(1, 7), 10])


def test_no_repeated_run_stays(spark):
    """Whole sentences of passages that two texts share go from the later one, however often each occurs alone elsewhere."""
    stock = [sentence(RANDOM.randint(8, 16)) for _ in range(60)]
    rows, planted = [], {}
    for i in range(40):  # single stock sentences in between
        rows.append((i, " ".join(x for _ in range(3) for x in (sentence(), RANDOM.choice(stock), sentence()))))
    for i in range(30):
        at = RANDOM.randrange(0, 50)
        run = stock[at : at + RANDOM.randint(4, 8)]
        for copy in (100 + 2 * i, 101 + 2 * i):
            rows.append((copy, " ".join([sentence(), *run, sentence()])))
        planted[101 + 2 * i] = run
    _, clean = cut_words(spark, rows)
    left = sum(s in clean[i] for i, run in planted.items() for s in run)
    whole = sum(map(len, planted.values()))
    assert left <= 0.02 * whole, (left, whole)
    texts = dict(rows)
    for i in range(40):  # a sentence alone is no passage
        assert clean[i] == texts[i]


def test_short_rows_and_null_ids(spark):
    own = " ".join(sentence() for _ in range(4))
    cuts, clean = cut_words(spark, [(1, own), (None, own), (2, None), (3, ""), (4, own), (4, own)])
    assert not cuts[1] and sum(n for n, _ in cuts[4]) == 48 and clean[2] is None and clean[3] == ""
