"""Token counts with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import os
import unicodedata
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame

from .texts import column, once, per_text

#: Pre-tokens merged in a task that are remembered.
REMEMBERED = 400_000
# The vocabulary's special strings and its split pattern; white space is Unicode's.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_MARKS = regex.compile("|".join(map(regex.escape, SPECIAL)))


def normal(text: str) -> str:
    """Composed and in lower case, each character by itself."""
    if text.isascii():
        return text.lower()
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def pieces(text: str) -> tuple[list[str], int]:
    """Pre-tokens of a whole text, and its special strings, each of which is one token."""
    if "<|" not in text:
        return _PIECES.findall(normal(text)), 0
    parts = _MARKS.split(text)
    return [p for part in parts for p in _PIECES.findall(normal(part))], len(parts) - 1


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary string stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to be one token: as a text of their own they are one pre-token, and merging it ends in that token alone.

    Done once on the driver; the size is that of the vocabulary.
    """
    tokenizer = _tokenizer(Path(path).read_text(encoding="utf-8"))
    to_byte, end = _byte_of(), "</w>"
    surfaces = {}
    for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if name.endswith(end) and all(c in to_byte for c in name[: -len(end)]):
            raw = bytes(to_byte[c] for c in name[: -len(end)])
            try:
                surfaces[raw.decode("utf-8")] = number
            except UnicodeDecodeError:
                continue
    candidates = [s for s in surfaces if pieces(s) == ([s], 0)]
    encoded = tokenizer.encode_batch(candidates, add_special_tokens=False)
    return frozenset(s for s, e in zip(candidates, encoded, strict=True) if e.ids == [surfaces[s]])


def _tokenizer(definition: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Counts(dict):
    """Tokens of each pre-token seen so far."""

    def __init__(self, whole: frozenset[str], merge: Callable[[list[str]], list[int]]):
        super().__init__()
        self.whole, self.merge = whole, merge

    def of(self, texts: list[str]) -> np.ndarray:
        split = [pieces(t) for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        new = set().union(*(p for p, _ in split)).difference(self)
        single = new & self.whole
        self.update(dict.fromkeys(single, 1))
        rest = list(new - single)
        self.update(zip(rest, self.merge(rest), strict=True))
        return np.array([sum(map(self.__getitem__, p)) + marks for p, marks in split], np.int64)


def count_tokens(docs: DataFrame, path: str, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8) and n_tokens of every whole text, as the vocabulary's own library counts them.

    Special strings inside a text are one token each; none are added.  Null and empty texts have no tokens.
    Pre-tokens in the proven set count one at once; the others are merged, each different one once per
    slice of texts at most.  The driver reads the file at ``path`` and hands its content to the tasks.
    """
    context = docs.sparkSession.sparkContext
    whole, definition = context.broadcast(whole_tokens(path)), context.broadcast(Path(path).read_text(encoding="utf-8"))
    key = str(uuid.uuid4())

    def counts() -> _Counts:
        tokenizer = _tokenizer(definition.value)
        return _Counts(whole.value, lambda rest: [len(e.ids) for e in tokenizer.encode_batch(rest, add_special_tokens=False)])

    def work(texts: pa.Array) -> list:
        return [pc.binary_length(texts).cast(pa.int64()), once(key, counts).of(texts.to_pylist())]

    return per_text(docs, keep, column(docs, text_col), schema + ", n_bytes bigint, n_tokens bigint", work)
