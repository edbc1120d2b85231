"""Each operator against brute force, an exact round trip, or held-out accuracy, with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from deskweave.llm import benchmark_leaks, byte_bpe, catalog, language, licences, passages, quality, sharding, simhash, texts, token_counts, vectors
from deskweave.llm.components import connected_components

RANDOM = random.Random(5)
SYLLABLES = "the an re ing tion and of to er on at en ha sh ly ble ou st ed nd".split()
ODD = ["", None, " ", "\n\n", "a", "Ä é ß", "x" * 5000, "  z", "\x00 \x01 a\x00b", "😀 😀", "é é", "ΣΑΣ İ", "don't WE'LL 1234"]


def word() -> str:
    return "".join(RANDOM.choices(SYLLABLES, k=RANDOM.randint(1, 3)))


def sentence(n: int) -> str:
    return " ".join(word() for _ in range(n)).capitalize() + "."


def prose(n: int) -> str:
    return " ".join(sentence(RANDOM.randint(6, 14)) for _ in range(n))


def documents(spark, rows, extra=True):
    """doc_id, text and columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("id", "t", "row", "score", "size", "fp", "component_id", "block", "ids", "label", "k0", "a.b"):
            frame = frame.withColumn(name, F.lit(None).cast("string") if name != "score" else F.lit(1))
    return frame


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    n = 150
    links = {"chain": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)], "none": [(3, 3), (None, 1)],
             "random": [(RANDOM.randrange(n), RANDOM.randrange(n)) for _ in range(n // 2)]}[shape]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = least_reachable({x for pair in real for x in pair}, real)
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    expected = {}
    for node, least in want.items():
        expected.setdefault(least, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_word_and_shingle_hashes():
    data, starts = texts.joined(__import__("pyarrow").array(["a bb  ccc", "", "bb CCC a bb ccc"]))
    begin, end, owner = texts.words(data, starts, texts.SOLID)
    hashes = texts.word_hashes(data, begin, end, texts.LOWER)
    assert owner.tolist() == [0, 0, 0, 2, 2, 2, 2, 2]
    assert hashes[1] == hashes[3] == hashes[6] and hashes[2] == hashes[4] == hashes[7] and len(set(hashes.tolist())) == 3
    grams = texts.shingles(hashes, 2)
    assert grams[0] == grams[5] and grams[1] == grams[3] == grams[6]


# --- SimHash ---------------------------------------------------------------------------------------------


def plain_fingerprint(text: str) -> int:
    tokens = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_SIZE", 8)
    monkeypatch.setattr(simhash, "TREE_LIMIT", 12)
    rows = [(i, prose(12)) for i in range(40)]
    base = prose(60).split(" ")
    for i in range(40, 90):  # near copies: many fingerprints close together
        copy = list(base)
        copy[RANDOM.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    rows += [(90 + i, t) for i, t in enumerate(ODD)] + [(200, base[0]), (201, base[0]), (None, " ".join(base)), (5, rows[5][1])]
    rows += [(300, " ".join(["same"] * 900))]
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{prints[t]:016x}") for i, t in rows)
    distinct = sorted(set(prints.values()))
    root = least_reachable(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    for r in got:
        assert r["component_id"] == least[root[int(r["fingerprint"], 16)]]
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 60, 200, dtype=np.uint64))]))
    asked = np.concatenate([values[::3], rng.integers(0, 2**63, 20, dtype=np.uint64)])
    rng.shuffle(values)
    query, node = simhash.BKTree(values).within(asked, 3)
    want = {(i, j) for i, a in enumerate(asked.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= 3}
    assert set(zip(query.tolist(), node.tolist(), strict=True)) == want


@pytest.mark.parametrize("n", [1, 10**6, 10**9, 10**11])
def test_routes_meet_all_close_pairs(n):
    blocks, choices, bits = simhash._routes(n, 3)
    width = 64 // blocks
    assert bits <= len(choices[0]) * width and n / 2**bits <= 4 * simhash.TREE_SIZE
    for _ in range(200):
        flipped = {RANDOM.randrange(64) // width for _ in range(3)}
        assert any(not flipped & set(c) for c in choices)


# --- vectors ---------------------------------------------------------------------------------------------


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    for i in range(300, 420):  # a dense group, larger than a window of the test
        rows.append((i, (np.ones(16) + 0.12 * rng.standard_normal(16)).tolist()))
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(600, [2 * x for x in rows[1][1]]), (2, rows[2][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [None] + [1.0] * 15), (705, [float("inf")] * 16), (706, [1.0] * 3), (707, [2.0] * 3), (708, [1e-30] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("hash", F.lit(None))
    got = vectors.near_vectors(frame, window=32).collect()
    fine = [(k, np.array(v, float) / np.max(np.abs(v))) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, unit = Counter(), [v / np.linalg.norm(v) for _, v in fine]
    pairs = []
    for i in range(len(fine)):
        for j in range(len(fine)):
            if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links[i] += 1
                pairs.append((fine[i][0], fine[j][0]))
    root = least_reachable({k for k, _ in rows}, pairs)
    want = Counter((k, links[i], root[k], k == root[k]) for i, (k, _) in enumerate(fine))
    want += Counter((k, 0, k, True) for k, _ in rows if k >= 700 and k not in {f for f, _ in fine})
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_projection_passes_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 32))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    angle = math.acos(0.955)  # pairs just above the threshold
    other = math.cos(angle) * base + math.sin(angle) * off
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=16)
    assert got.where("n_links > 0").count() >= 0.97 * len(rows)


# --- sharding --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["mixed", "one text", "tiny", "empty"])
def test_sharding_law(spark, monkeypatch, case):
    monkeypatch.setattr(sharding, "LEAST_ROWS", 5)
    rows = {"mixed": [(i, prose(RANDOM.randint(0, 6))) for i in range(400)] + [(i, "same text") for i in range(400, 700)] + [(None, None), (None, None), (3, "x")] + [(900 + i, t) for i, t in enumerate(ODD)],
            "one text": [(1, "the same")] * 500, "tiny": [(1, "a"), (2, None)], "empty": []}[case]
    got = sharding.shard_by_bytes(documents(spark, rows), 8).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(((crc(t), -(2**63) if i is None else i, i, size(t)) for i, t in rows), key=lambda x: x[:2])
    total, run, slots, want = sum(x[3] for x in order), 0, Counter(), []
    for c, _, i, s in order:
        shard = min(7, (2 * run + s) * 8 // (2 * total))
        want.append((i, s, c, shard, slots[shard]))
        slots[shard] += 1
        run += s
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == Counter(want)


# --- tokens ----------------------------------------------------------------------------------------------

AWKWARD = [t or "" for t in ODD] + ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "'S it'LL ''s", "...!?# #a1b2", "é́ ẛ̣", "ﬁ Ⅳ ½ ² ٣", "a b\x85c᠎d", "日本語テキスト", "  lead", "trail  \n\n x", "\t\tx", "ΑΣ. ΑΣ"]


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_file("word_bpe_49k.json")
    rows = list(enumerate([*AWKWARD, *(prose(8) for _ in range(30)), *(prose(8).upper() for _ in range(5))])) + [(999, None), (1, "again")]
    frame = documents(spark, rows)
    got = token_counts.count_tokens(frame, path, [frame["doc_id"]], "doc_id long").collect()
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 20000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::50])


def test_byte_bpe_round_trip(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 3000)  # several blocks
    monkeypatch.setattr(byte_bpe, "_LONG", 4000)
    path = catalog.tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    rows = list(enumerate([*AWKWARD, *(prose(8) for _ in range(60)), prose(200)])) + [(None, "null id"), (None, None), (1, "a"), (1, "a")]
    encoded = byte_bpe.encode(documents(spark, rows), ranks, catalog.RANKS_PATTERN)
    got = byte_bpe.decode(encoded, ranks).collect()
    library = tiktoken.Encoding("own", pat_str=catalog.RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    digests = {r["doc_id"]: r for r in catalog.encoding_digests(byte_bpe.decode(byte_bpe.encode(documents(spark, [(1, "a b"), (2, "")]), ranks, catalog.RANKS_PATTERN), ranks)).collect()}
    ids = " ".join(map(str, library.encode_ordinary("a b")))
    assert digests[1]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and digests[1]["n_tokens"] == 2
    assert digests[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and digests[2]["n_tokens"] == 0
    assert byte_bpe.encode(documents(spark, []), ranks, catalog.RANKS_PATTERN).count() == 0


# --- learned scores --------------------------------------------------------------------------------------


def junk(kind: int) -> str:
    if kind == 0:
        return " ".join(w for _ in range(6) for w in [word()] * 20)
    if kind == 1:
        return " ".join(RANDOM.choice(["###", "%%%"]).join([w, ""]) for w in prose(8).split())
    return prose(8).upper() + "!!"


def test_quality_on_held_out_rows(spark):
    rows = [(i, prose(RANDOM.randint(4, 10)) if i % 4 else junk(RANDOM.randrange(3))) for i in range(600)]
    frame = documents(spark, rows + [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "x y")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(4, 0), (9001, None), (None, 1), (77777, 1)], "doc_id long, quality int")
    seen = frame.where("doc_id % 3 <> 1")
    model = quality.fit(seen, labels)
    got = quality.score(frame, model, [frame["doc_id"]], "doc_id long").collect()
    held = [(r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 3 == 1]
    assert sum(held) >= 0.97 * len(held) and len(got) == 600 + len(ODD) + 1
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (9000, 9001, 9002, 9003)}) == 1  # nothing to see
    assert quality.fit(seen, labels.limit(0)) == 0.5 and quality.fit(seen, labels.where("quality = 1")) == 1.0
    assert {r["score"] for r in quality.score(frame, 0.5, [frame["doc_id"]], "doc_id long").collect()} == {0.5}


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(80)]
    labels = np.array([1 if 3 in r or 5 in r else -1 for r in rows])
    ratios = np.where(np.isin(np.arange(12), (3, 5)), 2.0, 0.5)
    weights, bias = quality.hinge_fit(rows, labels, ratios, epochs=400)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = quality._unit(ratios[r])
        x[i, 12] = 1

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - labels * (x @ w)).sum()

    best = loss(np.append(weights, bias))
    for _ in range(300):
        assert loss(np.append(weights, bias) + 0.01 * rng.standard_normal(13)) >= best - 1e-3


def test_language_on_held_out_rows(spark):
    alphabets = {"xx": "the and of ing tion".split(), "yy": "ció ñas mente los que".split(), "zz": "ßung ich über zu der".split()}
    rows = []
    for i in range(360):
        lang = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(RANDOM.choices(alphabets[lang], k=RANDOM.randint(1, 3))) for _ in range(RANDOM.randint(3, 300))), lang))
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD + ["12 34 !?", "  ", "das " * 30000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = language.fit(frame.where("doc_id % 4 <> 2"), "text", F.col("lang"))
    got = {r["doc_id"]: r for r in language.predict(frame, model, [frame["doc_id"]], "doc_id long").collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows[:360] if i % 4 == 2]
    assert sum(held) >= 0.97 * len(held)
    for i, t, _ in rows[360:]:
        lettered = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not lettered) and 0 <= got[i]["score"] <= 1
    assert language.fit(frame.limit(0), "text", F.col("lang")) is None
    assert {r["lang_pred"] for r in language.predict(frame, None, [frame["doc_id"]], "doc_id long").collect()} == {"und"}


def test_network_tables_match_the_plain_convolution():
    rng = np.random.default_rng(3)
    views = rng.integers(0, 256, (70, language.WINDOW)).astype(np.uint8)
    net = language.train(views, np.arange(70) % 3, ["a", "b", "c"], epochs=1)
    pooled = []
    for kernel, offset in zip(net.filters, net.offsets, strict=True):
        x = net.embedding[views]
        y = sum(x[:, j : language.WINDOW - len(kernel) + 1 + j] @ kernel[j] for j in range(len(kernel)))
        pooled.append(np.maximum(y.max(axis=1) + offset, 0))
    z = np.exp(np.concatenate(pooled, axis=1) @ net.out + net.bias)
    assert np.allclose(net.probabilities(views, net.tables()), z / z.sum(axis=1, keepdims=True), atol=1e-4)


# --- licences --------------------------------------------------------------------------------------------


def plain_licences(text: str | None):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    tokens = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(tokens)) if tokens[i : i + len(phrase.split())] == phrase.split()]
    return len(tokens), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licence_scan(spark):
    rows = list(enumerate([*ODD, "MIT License", "mit. LICENSE; mit license mit\nlicense", "the Apache—License apache  license", "xmit license", "GNU General Public License, v3",
                           "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nrest", "General Public", "All rights reserved."])) + [(1, "general public"), (2, "license")]
    frame = documents(spark, rows)
    got = licences.scan_licences(frame, [frame["doc_id"]], "doc_id long").collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter((i, *plain_licences(t)) for i, t in rows)
    tagged = next(r for r in got if r["labels"].startswith("apache-2.0"))
    assert tagged["labels"] == "apache-2.0,gpl-2.0-only,mit,permissive,with:classpath-exception-2.0" and tagged["score"] == 1.0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_long_licence_expressions_are_parsed_whole(spark):
    names = [f"lib-{i}-1.0" for i in range(400)]
    rows = [(0, "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 500 + ["GPL-3.0-only"]) + "\nMIT"), (1, "# SPDX-License-Identifier: " + " AND ".join(names)),
            (2, "SPDX-License-Identifier: MIT\nAND ISC")]
    frame = documents(spark, rows)
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licences.scan_licences(frame, [frame["doc_id"]], "doc_id long").collect()}
    assert got == {0: {"mit", "gpl-3.0-only", "conditional"}, 1: {*names, "conditional"}, 2: {"mit", "permissive"}}


@pytest.mark.parametrize(("text", "permissive"), [
    ("MIT", True), ("GPL-3.0", False), ("MIT OR GPL-3.0", True), ("MIT AND GPL-3.0", False), ("GPL-2.0 OR MIT AND GPL-3.0", False),
    ("(GPL-2.0 OR MIT) AND BSD-3-Clause", True), ("GPL-2.0 WITH Classpath-exception-2.0 OR ISC", True), ("MIT WITH", None), ("(MIT", None), ("MIT)", None),
    ("AND MIT", None), ("MIT Apache-2.0", None), ("", None), ("()", None), ("(MIT OR ISC) WITH x", None), ("mit or isc", True)])
def test_licence_expressions(text, permissive):
    parsed = licences.parse_expression(text)
    assert (parsed and parsed.permissive) == permissive


# --- benchmark leaks -------------------------------------------------------------------------------------


def test_leaks_match_all_windows(spark):
    items = [(k, prose(2)) for k in range(12)] + [(50, prose(40)), (60, "too short here"), (61, None), (62, ""), (63, prose(2))]
    items.append((64, items[0][1].upper()))
    rows = [(i, prose(RANDOM.randint(1, 12))) for i in range(40)]
    for i, (_, text) in enumerate(items[:13]):
        rows.append((100 + i, f"{prose(3)[:-1]} {text} {prose(2)}"))
        tokens = text.split()
        tokens[len(tokens) // 2 if len(tokens) < 30 else -1] = "changed"
        rows += [(200 + i, f"{word()} {' '.join(tokens)}"), (300 + i, text), (400 + i, text.replace(" ", "\n -- "))]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(None, items[1][1]), (100, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in benchmark_leaks.find_leaks(documents(spark, rows), bench).collect())

    def tokens(t):
        return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    own = {k: tokens(t) for k, t in items}
    df = Counter(g for w in own.values() for g in grams(w))
    share = Counter()
    for w in own.values():
        share.update(set(grams(w)))
    del df
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        for k, item in own.items():
            its, best = grams(item), 0.0
            if len(item) < 5:
                continue
            for a in range(max(1, len(w) - len(item) + 1)):
                mine = grams(w[a : a + len(item)])
                if not mine.keys() & its.keys():
                    continue
                both = sum(min(mine[g], its[g]) / share.get(g, 1) for g in mine.keys() | its.keys())
                best = max(best, both / sum(max(mine[g], its[g]) / share.get(g, 1) for g in mine.keys() | its.keys()))
            if best >= 0.8:
                want[i, k, round(best, 9)] += 1
    assert got == want and len(want) > 40
    assert benchmark_leaks.find_leaks(documents(spark, rows), bench.limit(0)).count() == 0
    assert benchmark_leaks.find_leaks(documents(spark, []), bench).count() == 0


def test_leak_passes_agree(spark, monkeypatch):
    items = [(k, prose(3)) for k in range(10)]
    rows = [(i, f"{prose(3)} {items[i][1]} {prose(3)}") for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(benchmark_leaks, "PASS_WORDS", 60)
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks.find_leaks(documents(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(10)}


def test_leak_passes_weigh_by_the_whole_benchmark(spark, monkeypatch):
    template = prose(2)
    items = [(k, f"{template} {prose(2)}") for k in range(12)]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        for at in range(0, len(w), 2):  # one word changed, in the shared or in the own part
            rows.append((100 * i + at, " ".join([prose(1), *w[:at], "changed", *w[at + 1 :], prose(1)])))
        rows.append((5000 + i, f"{template} {prose(2)}"))
        rows.append((6000 + i, f"{prose(1)} {' '.join(items[i][1].split()[-10:])} {items[i - 1][1]}"))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return Counter((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], round(r["similarity"], 9)) for r in benchmark_leaks.find_leaks(docs, bench).collect())

    want = found()
    monkeypatch.setattr(benchmark_leaks, "PASS_WORDS", 60)
    assert found() == want and len(want) > 40


def test_leaks_of_long_items_at_any_offset():
    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(4000)]

    def text(n):
        return rng.choices(vocabulary, k=n)

    item = text(3000)
    edited = text(150) + item[150:]  # the edits lie together in the beginning
    leaks = benchmark_leaks.Leaks([(0, " ".join(item)), (1, " ".join(text(20)))])
    for turn in range(12):
        for body, least in ((item, 1.0), (edited, 0.85)):
            before = text(rng.randrange(2000))
            found = leaks.find(pa.array([" ".join(before + body + text(rng.randrange(2000)))], pa.string()))
            assert [(f[0], f[1], f[3]) for f in found] == [(0, 0, 3000)] and found[0][4] >= least, turn
            assert body is edited or found[0][2] == len(before)


# --- passages --------------------------------------------------------------------------------------------


def test_repeated_passages_are_cut(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 4000)
    passage, line = prose(8), "This work is licensed under some licence or other."
    clean = [(i, prose(6) + "\n" + line) for i in range(30)]
    copies = [(100 + i, f"{prose(2)}\n{passage}\n{prose(2)}") for i in range(20)]
    tokens = passage.split(". ")
    near = [(200, prose(2) + "\n" + ". ".join([*tokens[:3], "Quite another sentence stands in the middle here", *tokens[4:]]))]
    whole = [(300, copies[0][1]), (301, passage), (None, passage), (100, copies[0][1])]
    rows = clean + copies + near + whole + [(900 + i, t) for i, t in enumerate(ODD)] + [(950, " ".join(["the"] * 3000)), (951, " ".join(["the"] * 300))]
    frame = documents(spark, rows).withColumn("numbers", F.lit(3))
    got = passages.remove_repeats(frame, [frame["doc_id"], frame["numbers"]], "doc_id long, numbers int").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    texts_by_id = dict(rows)
    for i, t in clean + [(900 + i, t) for i, t in enumerate(ODD)]:
        assert by_id[i]["clean"] == t and not by_id[i]["cuts"]
    assert passage in by_id[100]["clean"]
    for i, t in copies[1:]:
        assert by_id[i]["clean"] == t.replace(passage, "").replace("\n\n", "\n\n") and [c["kept_id"] for c in by_id[i]["cuts"]] == [100]
        cut = by_id[i]["cuts"][0]
        assert t.encode()[cut["start"] : cut["end"]].decode() == passage and cut["n_words"] == len(passage.split())
    assert by_id[301]["clean"] == "" and by_id[None]["clean"] == "" and by_id[300]["clean"] == "" and len(by_id[200]["cuts"]) in (1, 2)
    assert texts_by_id[950] == by_id[950]["clean"]
    empty = documents(spark, [])
    assert passages.remove_repeats(empty, [empty["doc_id"]], "doc_id long").count() == 0


def test_alike_sentences_match_all_pairs(spark):
    long = [sentence(passages.LONG_SENTENCE - 2).lower().capitalize() for _ in range(12)]  # whole paragraphs
    rows = []
    for i, s in enumerate(long):
        rows.append((i, s))
        w = s.split()
        w[-1] = "End."
        rows.append((50 + i, " ".join(w)))  # alike: one shingle differs
        w[10] = "middle"
        rows.append((100 + i, " ".join(w)))  # 6 of 18 shingles differ
    got = {r["doc_id"]: r["cuts"] for r in passages.remove_repeats(documents(spark, rows, extra=False), [F.col("doc_id")], "doc_id long").collect()}

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    links = [(a, b) for a, t in rows for b, u in rows if a < b and len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u))]
    root = least_reachable([i for i, _ in rows], links)
    found = sum([c["kept_id"] for c in got[i]] == ([root[i]] if root[i] < i else []) for i, _ in rows)
    assert found >= 0.95 * len(rows) and len(links) >= 12
    assert passages.bands_for() == 5 and 1 - (1 - 0.8**passages.ROWS) ** 5 >= passages.RECALL


def test_alike_sentences_of_a_crowded_key_all_meet(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 64)
    # Most shingles are those of a template, so most keys hold hundreds of sentences that are not alike, and one copy of each.
    template, rows = " ".join(word() for _ in range(18)), []
    for i in range(300):
        w = [template, *(f"{word()}{i}" for _ in range(4))]
        rows += [(i, " ".join([*w, "one."])), (1000 + i, " ".join([*w, "end."]))]
    got = passages.remove_repeats(documents(spark, rows, extra=False), [F.col("doc_id")], "doc_id long").collect()
    cuts = {r["doc_id"]: [c["kept_id"] for c in r["cuts"]] for r in got}
    assert not any(cuts[i] for i in range(300)) and sum(cuts[1000 + i] == [i] for i in range(300)) >= 295


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 40, 12)) for _ in range(40)]
    sets += [np.append(s[1:], rng.integers(1 << 41, 1 << 42)) for s in sets[:25]] + [np.append(s[2:], [5, 6]) for s in sets[:10]]
    a, b = passages._forest(sets, 0.8)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert least_reachable(range(len(sets)), zip(a.tolist(), b.tolist(), strict=True)) == least_reachable(range(len(sets)), links) and len(links) > 20


def test_words_that_occur_nowhere_else_stay(spark):
    lines, own = [sentence(6) for _ in range(2)], sentence(10)
    tens = [sentence(12) for _ in range(2)]
    passage = [sentence(12) for _ in range(6)]
    changed = [*passage[:3], sentence(8), *passage[4:]]
    rows = [(0, f"{prose(2)} {lines[0]} {prose(3)}"), (1, f"{lines[1]} {prose(2)}"), (2, f"{prose(1)} {lines[0]} {own} {lines[1]} {prose(1)}"),
            (10, f"{tens[1]} {prose(3)} {tens[0]}"), (11, f"{tens[0]} {sentence(9)} {tens[1]}"),  # one keeper, not side by side there
            (20, f"{prose(2)} {' '.join(passage)}"), (21, f"{' '.join(changed)} {prose(1)}"),
            (15, f"{passage[1]} {prose(1)}")]  # a line of the passage has an earlier keeper
    got = {r["doc_id"]: r for r in passages.remove_repeats(documents(spark, rows, extra=False), [F.col("doc_id")], "doc_id long").collect()}
    texts_by_id = dict(rows)
    for i in (0, 1, 2, 10, 11, 15, 20):
        assert got[i]["clean"] == texts_by_id[i] and not got[i]["cuts"], i
    assert [got[21]["clean"].count(s) for s in changed] == [0, 0, 0, 1, 0, 0] and {c["kept_id"] for c in got[21]["cuts"]} == {20}
    assert sum(c["n_words"] for c in got[21]["cuts"]) == 60


def test_passages_in_running_text_and_short_lines_are_cut(spark):
    def run(n, line=None):
        w = [f"{word()}{RANDOM.randrange(50)}" for _ in range(n)]
        return " ".join(w) if line is None else "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))

    rows = []
    for i in range(60):
        passage, verse = run(60), run(60, 3)
        rows += [(i, f"{run(70)} {passage} {run(90)}"), (1000 + i, f"{run(40)} {passage} {run(80)}"),
                 (2000 + i, f"{run(45, 3)}\n{verse}\n{run(30, 3)}"), (3000 + i, f"{run(33, 3)}\n{verse}\n{run(60, 3)}")]
    got = {r["doc_id"]: sum(c["n_words"] for c in r["cuts"]) for r in passages.remove_repeats(documents(spark, rows, extra=False), [F.col("doc_id")], "doc_id long").collect()}
    for base in (1000, 3000):
        assert sum(20 <= got[base + i] <= 60 for i in range(60)) >= 57 and not any(got[base - 1000 + i] for i in range(60))
