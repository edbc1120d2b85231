"""Licence scans: phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .texts import ALNUM, LOWER, column, joined, once, per_text, words

# Phrases of the base scan and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "all rights reserved": "all-rights-reserved",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this work is licensed under": "notice",
    "released under the": "notice",
    "licensed under the": "notice",
    "proprietary and confidential": "proprietary",
}
# Words of the tags that a licence expression follows.
TAGS = ("spdx license identifier", "license expression")
# Identifiers, without versions and numbers of clauses, whose use is free of conditions on derived works.
PERMISSIVE = frozenset(("mit", "mit-0", "apache", "bsd", "isc", "0bsd", "unlicense", "cc0", "cc-by", "zlib", "bsl", "wtfpl", "python", "psf"))

_LEAF = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_VERSION = re.compile(r"(-\d+-clause)?(-?v?\d+(\.\d+)+|-v?\d+)?(\+|-only|-or-later)?")
_BINDING = {"or": 1, "and": 2, "with": 3}


def is_permissive(identifier: str) -> bool:
    """Whether a whole identifier in lower case, its version split off, is known to be permissive; an unknown one is not."""
    return any(identifier.startswith(name) and _VERSION.fullmatch(identifier, len(name)) for name in PERMISSIVE)


@dataclass(frozen=True)
class Expression:
    """A parsed licence expression: its identifiers, its exceptions, and whether it can be met with permissive ones alone."""

    licences: tuple[str, ...]
    exceptions: tuple[str, ...]
    permissive: bool


def parse_expression(text: str) -> Expression | None:
    """Shunting-yard parse of ``and``, ``or``, ``with`` and brackets; None if the text is no expression.

    ``with`` binds tightest and takes one identifier on either side, then ``and``, then ``or``.  An ``or`` is
    permissive if one side is, an ``and`` if both are; an exception leaves its licence as it is.
    """
    values: list[tuple[frozenset, frozenset, bool, bool]] = []
    waiting: list[str] = []
    operand = True

    def apply() -> bool:
        operator = waiting.pop()
        if operator == "(" or len(values) < 2:
            return False
        (rl, re_, rp, r1), (ll, le, lp, l1) = values.pop(), values.pop()
        if operator == "with":
            if not (l1 and r1):
                return False
            values.append((ll, le | rl, lp, False))
        else:
            values.append((ll | rl, le | re_, lp or rp if operator == "or" else lp and rp, False))
        return True

    at = 0
    tokens = []
    for m in _TOKEN.finditer(text):
        if text[at : m.start()].strip():
            return None
        tokens.append(m.group(0))
        at = m.end()
    if text[at:].strip():
        return None
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand:
                return None
            waiting.append(word)
        elif word == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif word in _BINDING:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[word]:
                if not apply():
                    return None
            waiting.append(word)
            operand = True
        else:
            if not operand:
                return None
            values.append((frozenset([word]), frozenset(), is_permissive(word), True))
            operand = False
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(" or not apply():
            return None
    licences, exceptions, permissive, _ = values[0]
    return Expression(tuple(sorted(licences)), tuple(sorted(exceptions)), permissive)


def tagged_expression(rest: str) -> Expression | None:
    """The longest expression at the start of what follows a tag on its line."""
    line = rest.lstrip(" \t:=\"'").split("\n", 1)[0]
    ends, depth, operand = [], 0, True
    for m in _TOKEN.finditer(line):
        token = m.group(0).lower()
        if line[ends[-1][0] if ends else 0 : m.start()].strip():
            break
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif token in _BINDING and not operand:
            operand = True
        elif _LEAF.fullmatch(token) and token not in _BINDING and operand:
            operand = False
        else:
            break
        ends.append((m.end(), depth == 0 and not operand))
    for end, whole in reversed(ends):
        if whole:
            return parse_expression(line[:end].rstrip(".")) or parse_expression(line[:end])
    return None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    meanings: dict[str, list[tuple[str, str]]] = {}
    for kind, table in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in table.items():
            meanings.setdefault(phrase, []).append((kind, label))
    for phrase, what in meanings.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), what))
    found.make_automaton()
    return found


def _scan(texts: pa.Array, automaton: ahocorasick.Automaton) -> list:
    data, starts = joined(texts)
    begin, end, owner = words(data, starts, ALNUM)
    n = len(texts)
    n_words = np.bincount(owner, minlength=n)
    # Words in lower case with one space between them and around them all; a character per byte.
    solid = ALNUM[data]
    keep = solid.copy()
    keep[end] = True  # the byte behind a word; every text ends with a newline
    flat = np.where(solid, LOWER[data], 32)[keep]
    first = 1 + np.concatenate([[0], np.cumsum(keep)])[begin]
    base: dict[int, list[tuple[int, str]]] = {}
    labels: dict[int, set[str]] = {}
    tags: dict[int, list[int]] = {}
    for at, (size, count, what) in automaton.iter(" " + flat.tobytes().decode("latin-1")):
        word = int(np.searchsorted(first, at - size + 2))
        text = int(owner[word])
        if owner[word + count - 1] != text:
            continue
        for kind, label in what:
            if kind == "base":
                base.setdefault(text, []).append((word, label))
            elif kind == "notice":
                labels.setdefault(text, set()).add(label)
            else:
                tags.setdefault(text, []).append(int(end[word + count - 1]))
    offset = np.concatenate([[0], np.cumsum(n_words)])
    newlines = np.flatnonzero(data == 10) if tags else starts
    out: list[tuple] = []
    for i in range(n):
        places, own = base.get(i, []), set(labels.get(i, ()))
        expressions = []
        if i in tags:
            stop = starts[i + 1] if i + 1 < n else len(data)
            for past in tags[i]:
                line = int(newlines[np.searchsorted(newlines, past)])  # every text ends with one
                parsed = tagged_expression(data[past : min(stop, line)].tobytes().decode("utf-8", "replace"))
                if parsed:
                    expressions.append(parsed)
                    own |= {*parsed.licences, *(f"with:{x}" for x in parsed.exceptions), "permissive" if parsed.permissive else "conditional"}
        names = {label for _, label in places}
        # A valid tag settles it; a named licence nearly does, the more so if it stands out from the text; other notices hint.
        score = 1.0 if expressions else 0.7 + 0.2 * min(1.0, 50 * len(places) / max(1, n_words[i])) if places else 0.4 if own else 0.0
        spots = [w - int(offset[i]) for w, _ in places]
        out.append((len(places), min(spots, default=None), max(spots, default=None), ",".join(sorted(names)), ",".join(sorted(names | own)), score))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    return [pa.array(n_words, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]


def scan_licences(docs: DataFrame, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns and what each whole text says of licences.

    n_words; n_base, the places where the words of a base phrase stand one after the other; first_word and
    last_word, the smallest and largest start of those places (null without any); base_labels; labels, with
    those of further phrases and tagged expressions; score, 0 without any sign to 1 with a valid tag.  Labels
    are distinct, sorted and comma-joined; none give an empty string.  A null text counts as empty.  Phrases
    that overlap count each, at every place where one starts.  A tagged expression is permissive or, if it
    needs a licence that is not known to be, conditional.  Rows may repeat; an empty table gives no rows.
    """
    def work(texts: pa.Array) -> list:
        return _scan(texts, once("licence phrases", _automaton))

    return per_text(docs, keep, column(docs, text_col),
                    schema + ", n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", work)
