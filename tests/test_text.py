"""Text functions against plain Python on awkward inputs."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from deskweave.functions import defaults as d
from deskweave.functions import replies as r
from deskweave.functions import text as x
from deskweave.functions.rules import hit_names, only_hit, weak_label
from pyspark.sql import functions as F

SAMPLES = [
    "@a @b_1  hello there", "@only", "  @a hi", "hi @a", "", " \t ", "@é @ü1 text", "é charge", "écharge", "charge_x", "x\r\ncharge\n",
    "emoji 😡 here", "@a@b c", "@ a", "I won't open", "won\nt open", "LOGIN please", "log   in", "ſkip", " wide ", "a\x85b\x85", None,
]


def test_strip_handles(column):
    expected = ["" if s is None else re.sub(r"^(@\w+\s*)+", "", s).strip() for s in SAMPLES]
    assert column(x.strip_handles, SAMPLES) == expected


def test_long_handle_run(column):
    assert column(x.strip_handles, ["@abc " * 20000 + "end"]) == ["end"]


def test_drop_all_handles(column):
    expected = ["" if s is None else re.sub(r"@\w+", "", s).strip() for s in SAMPLES]
    assert column(x.drop_all_handles, SAMPLES) == expected


def test_language_guess(column):
    def guess(s):
        t = s.strip()
        return "und" if not t else "en_likely" if sum(ord(c) < 128 for c in t) / len(t) >= 0.85 else "non_en"

    texts = [s for s in SAMPLES if s is not None] + ["ééééé", "abcdefghé", "😡" * 3 + "a" * 17]
    assert column(x.language_guess, texts) == [guess(s) for s in texts]
    assert column(x.language_guess, [None]) == ["und"]


def test_length_and_flags(column):
    assert column(x.long_enough, ["a" * 29, "a" * 30, "😡" * 30, None]) == [False, True, True, False]
    assert column(x.is_inbound, ["True", " true\n", "FALSE", "", None]) == [True, True, False, False, False]
    assert column(x.sanitize_newlines, ["a\r\nb\nc", None]) == ["a  b c", None]


def test_urls(column):
    texts = ["see https://a.b/c). now", "HTTPS://x T.co/abc", "none", None, "http://a b"]
    assert column(x.extract_urls, texts) == [["https://a.b/c)."], ["HTTPS://x", "T.co/abc"], [], [], ["http://a"]]
    assert column(x.strip_urls, ["go https://a.b now", "http://only "]) == ["go  now", ""]


def test_tokens_and_ngrams(column):
    assert column(lambda c: x.ngrams_of(x.tokens(c)), ["One two, a three", "x", "Über_2 ok", None]) == [
        ["one", "two", "three", "one two", "two three"], [], ["über_2", "ok", "über_2 ok"], []]


INTENTS = {r_.name: r_ for r_ in d.INTENT_RULES}


def test_default_rules_match_like_python(column):
    texts = [s or "" for s in SAMPLES] + [
        "my iPhone crashed", "app crash on ios", "won’t open at all", "smart tv", "TVs", "family  plan", "any plans to support this",
        "I was charged twice", "song keeps skipping", "can't log in, forgot password", "why can\nt we"]
    for rule in (*d.INTENT_RULES, d.FEATURE_REQUEST, d.DM_REDIRECT, *d.GATES):
        python = re.compile(r"\b(" + rule.pattern + r")\b", re.IGNORECASE)
        assert column(rule.hits, texts) == [bool(python.search(s)) for s in texts], rule.name


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAéß_ \t\n @1😡.'chargeskip", max_size=30), min_size=1, max_size=40))
def test_random_texts(column, texts):
    python = re.compile(r"\b(" + d.GATES[0].pattern + r")\b", re.IGNORECASE)
    assert column(d.GATES[0].hits, texts) == [bool(python.search(s)) for s in texts]
    assert column(x.strip_handles, texts) == [re.sub(r"^(@\w+\s*)+", "", s).strip() for s in texts]


def test_weak_labels(column):
    texts = ["my song skips", "song on my iphone", "nothing here", "add a button to shuffle", None]
    hits = column(lambda c: hit_names(c, d.INTENT_RULES), texts)
    assert hits == [["playback_issue"], ["device_platform", "playback_issue"], [], ["playback_issue"], []]
    assert column(lambda c: only_hit(hit_names(c, d.INTENT_RULES)), texts) == ["playback_issue", None, None, "playback_issue", None]
    assert column(lambda c: weak_label(c, d.INTENT_RULES, d.FEATURE_REQUEST), texts) == ["playback_issue", None, None, None, None]


def test_reply_kinds(column):
    texts = ["Please DM us your email", "Try to restart the app", "Did you restart it?", "Does restarting help? try to reset?", "What device?",
             "We're on it", None, "settings update " + "x" * 80]
    assert column(r.concrete_resolution, texts) == [False, True, False, True, False, False, False, True]
    assert column(r.reply_category, texts) == [
        "DM-redirect", "concrete-resolution", "diagnostic-only", "concrete-resolution", "diagnostic-only", "generic-status", "generic-status", "concrete-resolution"]
    assert column(r.visible_resolution, ["x" * 79, "x" * 80, "please dm " + "x" * 80, None]) == [False, True, False, False]
    assert column(r.is_degenerate, ["@a ok", "@a yes", "", None, "@a", "   "]) == [True, False, True, True, True, True]


def test_synthetic_url(spark):
    rows = [("see https://a.b/c.", "from https://a.b/c"), ("https://a.b/c/d", "https://a.b/c!"), ("https://new.x", "https://a.b"), ("none", None),
            ("https://x.y", None), ("t.co/1 https://q.z", "t.co/1")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, reply string, evidence string").orderBy("i")
    flags = [row[0] for row in frame.select(r.synthetic_url(F.col("reply"), F.col("evidence"))).collect()]
    assert flags == [False, False, True, False, True, True]


def test_clean_draft(spark):
    frame = spark.createDataFrame([(0, ' "go" https://x.y ', "auto_handle"), (1, 'say "hi" https://x.y', "escalate"), (2, None, "escalate")],
                                  "i int, t string, d string").orderBy("i")
    assert [row[0] for row in frame.select(r.clean_draft(F.col("t"), F.col("d"))).collect()] == ["go", "say hi https://x.y", d.FALLBACK_REPLY]
