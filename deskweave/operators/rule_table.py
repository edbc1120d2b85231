"""Rules kept in a table of any size, joined with texts through the literals that their patterns require.

A pattern can only match a text that holds one of its literals: for each of its alternatives, the longest run of
plain characters that every match of that alternative contains.  One pass over the texts finds all literals of
all rules at once; only the rules that it finds are tried as patterns.

A rule of whole words that stands for a few single words needs no trial: it hits where one of them is among the
words of the text, which is a join of words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, WORD, whole_words
from ..session import cut_lineage

#: Literals of an automaton; more are searched in further passes.
SHARD_LITERALS = 200_000
#: A literal has so many characters at least; a rule with a shorter one is tried on every text.
LEAST_LITERAL = 3
#: Rules, or words that rules stand for, up to which they are broadcast.
BROADCAST_RULES = 500_000
#: Words that a rule stands for at most, if it is to be joined with the words of the texts; each is a bit of a number.
MOST_FORMS = 32
_QUANTIFIERS = "*?{"
_made: dict[str, ahocorasick.Automaton] = {}


def _alternatives(pattern: str) -> list[str] | None:
    """The parts of a pattern between its outermost bars; None if it is not understood."""
    parts, depth, at, begin, inside = [], 0, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] == "Q":
                return None
            at += 1
        elif inside:
            if c == "[":
                return None
            inside = c != "]"
        elif c == "[":
            if pattern.startswith(("]", "^]"), at + 1):
                return None
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return None if depth or inside else [*parts, pattern[begin:]]


def _longest_run(part: str) -> str:
    """The longest run of plain characters, outside groups and classes, that every match of ``part`` holds."""
    best, run, at, depth = "", "", 0, 0

    def ended() -> str:
        return max(best, run, key=len)

    while at < len(part):
        c, literal = part[at], None
        if c == "\\":
            following = part[at + 1 : at + 2]
            literal = following if following and not following.isalnum() else None
            at += 1
        elif c == "[":
            at += 1
            while at < len(part) and part[at] != "]":
                at += 2 if part[at] == "\\" else 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c not in ".^$+*?{}|":
            literal = c
        if c == "{":
            at = part.find("}", at)
            if at < 0:
                return ""
        at += 1
        if depth or literal is None or not literal.isascii():
            best, run = ended(), ""
        elif at < len(part) and part[at] in _QUANTIFIERS:
            best, run = ended(), ""  # it may be absent
        elif at < len(part) and part[at] == "+":
            run += literal
            best, run = ended(), literal
        else:
            run += literal
    return ended().lower()


def required_literals(pattern: str) -> list[str] | None:
    """Literals in lower case of which every match of the pattern holds one; None if some alternative has no long enough one.

    Groups, classes and characters beyond ASCII (whose lower case may differ between libraries) count for
    nothing, which can only make a rule be tried too often.  Patterns with inline flags or quoting are tried always.
    """
    if "(?" in pattern and not all(pattern.startswith(("(?:", "(?=", "(?!", "(?<"), i) for i in range(len(pattern)) if pattern.startswith("(?", i)):
        return None
    parts = _alternatives(pattern)
    if parts is None:
        return None
    found = [_longest_run(p) for p in parts]
    return sorted(set(found)) if all(len(x) >= LEAST_LITERAL for x in found) else None


def single_words(pattern: str) -> list[str] | None:
    """All words in lower case that a pattern stands for; None if it is more than a few words spelled with letters and digits of ASCII.

    Besides plain characters only alternatives, classes that name their characters, and ``?`` are understood.
    """
    parts, found = _alternatives(pattern), set()
    for part in parts or [""]:
        if not re.fullmatch(r"(?:(?:[A-Za-z0-9_]|\[[A-Za-z0-9_]+\])(?:\?(?![?+*{]))?)+", part):
            return None
        words = [""]
        for named, plain, absent in re.findall(r"(?:\[(\w+)\]|(\w))(\??)", part):
            words = [w + c for w in words for c in sorted({*(named or plain).lower()}) + [""] * bool(absent)]
            if len(words) > MOST_FORMS:
                return None
        found.update(words)
    return sorted(found) if parts and len(found) <= MOST_FORMS and "" not in found else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: single_words(p) if p is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: required_literals(p) if p is not None else [])


def rules_that_hit(texts: DataFrame, rules: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, rank, name, reason): every rule of a table that matches a text, letters of either case being alike.

    ``rules``: rank, name, pattern, reason and whole_word (whether the pattern is a list of alternatives that
    have to stand as words).  A null pattern matches nothing, nor does any pattern match a null text.  Rules
    may repeat and share ranks; each hits by itself.  Rules whose literal is too short or missing are tried on
    every text, so a table should hold few of these.
    """
    portable = F.replace(F.replace(F.col("pattern"), F.lit(r"\s"), F.lit(SPACE)), F.lit(".?"), F.lit(r"[^\n]?"))
    whole = F.coalesce("whole_word", F.lit(False))
    regex = F.when(whole, F.concat(F.lit(_HEAD), portable, F.lit(_TAIL))).otherwise(F.col("pattern"))
    numbered = rules.select("rank", "name", "reason", F.concat(F.lit("(?iu)"), regex).alias("regex"), _literals("pattern").alias("literals"),
                            F.when(whole, _words("pattern")).alias("forms"))
    numbered = cut_lineage(numbered.filter("regex IS NOT NULL").withColumn("rule", F.monotonically_increasing_id()))
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    found = _by_word(rows, numbered.filter("forms IS NOT NULL")).unionByName(_by_pattern(rows, numbered.filter("forms IS NULL")))
    return found.select(F.col("id").alias(id_col), "rank", "name", "reason")


def _by_word(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, rank, name, reason): rules that stand for single words, one of which is among the words of the text."""
    forms = cut_lineage(numbered.select("rule", F.posexplode("forms").alias("form", "word")))
    folded = F.col("text")
    for other, letter in _LIKE.items():
        folded = F.replace(folded, F.lit(other), F.lit(letter))
    words = F.array_distinct(F.regexp_extract_all(F.lower(folded), F.lit(WORD + "+"), F.lit(0)))
    held = rows.select("id", F.xxhash64("text").alias("text"), F.explode(words).alias("word"))
    met = held.join(F.broadcast(forms) if forms.count() <= BROADCAST_RULES else forms, "word")
    # A text may hold several words of a rule, and rows may come twice: each row holds every one of these words once.
    hits = met.groupBy("id", "text", "rule").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, form)")).alias("seen"))
    hits = hits.select("id", "rule", F.explode(F.array_repeat(F.lit(1), (F.col("n") / F.bit_count("seen")).cast("int"))))
    return hits.join(_described(numbered), "rule").select("id", "rank", "name", "reason")


def _by_pattern(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, rank, name, reason): rules that are tried as patterns on the texts that hold one of their literals."""
    literals = numbered.select("rule", F.explode("literals").alias("literal")).groupBy("literal").agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    literals = cut_lineage(literals)
    always = [r["rule"] for r in numbered.filter("literals IS NULL").select("rule").collect()]
    n = literals.count()
    shards = -(-n // SHARD_LITERALS)
    # Without such rules no text has to be read.
    candidates = (rows if always else rows.limit(0)).select("id", "text", F.array(*[F.lit(x) for x in always]).cast("array<bigint>").alias("rules"))
    for shard in range(shards):
        held = literals if shards == 1 else literals.filter(F.pmod(F.xxhash64("literal"), F.lit(shards)) == shard)
        candidates = candidates.unionByName(_found(rows, held.toArrow()))
    candidates = candidates.select("id", "text", F.explode("rules").alias("rule"))
    # Two shards may find a rule of several literals for one text.
    several = numbered.filter(F.size("literals") > 1).isEmpty() if shards > 1 else True
    if not several:
        candidates = candidates.dropDuplicates(["id", "text", "rule"])
    return candidates.join(_described(numbered, "regex"), "rule").filter(F.expr("text RLIKE regex")).select("id", "rank", "name", "reason")


def _described(numbered: DataFrame, *others: str) -> DataFrame:
    known = numbered.select("rule", "rank", "name", "reason", *others)
    return F.broadcast(known) if known.count() <= BROADCAST_RULES else known


def first_rule(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Of each text's hits, the one of the lowest rank, then name."""
    order = Window.partitionBy(id_col).orderBy("rank", "name", "reason")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


_HEAD, _TAIL = whole_words("\0").split("\0")


def _found(rows: DataFrame, literals: pa.Table) -> DataFrame:
    """(id, text, rules): the rules one of whose literals stands in the text, each once; texts with none are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(literals)
    kind, key = dict(rows.dtypes)["id"], uuid.uuid4().hex

    def automaton() -> ahocorasick.Automaton:
        if key not in _made:
            _made.clear()
            made = ahocorasick.Automaton()
            for literal, numbers in zip(*(shared.value.column(c).to_pylist() for c in ("literal", "rules")), strict=True):
                made.add_word(literal, numbers)
            made.make_automaton()
            _made[key] = made
        return _made[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            found = [sorted({r for _, numbers in search.iter(_ascii_lower(text)) for r in numbers}) for text in batch.column(1).to_pylist()]
            some = pa.array([i for i, rules in enumerate(found) if rules], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array([r for r in found if r], pa.list_(pa.int64()))],
                                             ["id", "text", "rules"])

    return rows.mapInArrow(run, f"id {kind}, text string, rules array<bigint>")


# A to Z, and the other characters that patterns without regard to case take for one of a to z.
_LIKE = {"\u212a": "k", "\u017f": "s", "\u0130": "i", "\u0131": "i"}
_FOLD = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {ord(c): ord(like) for c, like in _LIKE.items()}


def _ascii_lower(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() else text.lower()
