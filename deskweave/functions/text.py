"""Text columns that give the same answer on every regex engine.

Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII-only or treat accents differently
from Python's, so the classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"

# Every character Python's str.strip removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

HANDLE = "@" + WORD + "+"
URL = "https?://" + NOT_SPACE + "+"


def whole_words(alternatives: str) -> str:
    """Pattern for ``alternatives`` standing as whole words (Unicode aware).

    ``\\s`` and ``.`` are written out, since engines disagree on them too.
    """
    portable = alternatives.replace(r"\s", SPACE).replace(".?", r"[^\n]?")
    return rf"(^|{NOT_WORD})(?:{portable})($|{NOT_WORD})"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    Filters are pushed below projections by repeating their expressions; a
    lambda variable cannot be repeated.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive search; null text never matches."""
    return F.coalesce(col.rlike("(?iu)" + pattern), F.lit(False))


def trim_all(col: Column) -> Column:
    """Trim every kind of white space, not only blanks; looks at the ends of the text only."""
    return F.trim(col, F.lit(WHITESPACE))


def sanitize_newlines(col: Column) -> Column:
    return F.translate(col, "\r\n", "  ")


def strip_handles(col: Column) -> Column:
    """Drop the run of @handles the text starts with; null becomes ''.

    ``\\G`` chains the matches from the start of the text, so a long run of
    handles needs no nested repetition.
    """
    return trim_all(F.regexp_replace(F.coalesce(col, F.lit("")), rf"\G{HANDLE}{SPACE}*", ""))


def drop_all_handles(col: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(col, F.lit("")), HANDLE, ""))


def ascii_ratio(col: Column) -> Column:
    """Share of ASCII code points in the trimmed text; null when it is empty."""
    trimmed = trim_all(col)
    n = F.length(trimmed)
    n_ascii = F.length(F.regexp_replace(trimmed, r"[^\x00-\x7F]", ""))
    # As many bytes as characters: nothing to count.
    return F.when((n > 0) & (F.octet_length(trimmed) == n), F.lit(1.0)).otherwise(
        F.try_divide(n_ascii.cast("double"), n.cast("double")))


def language_guess(col: Column, min_ascii: float = 0.85) -> Column:
    """``und`` for blank text, else ``en_likely`` or ``non_en`` by ASCII share."""
    return bind(ascii_ratio(col), lambda share: F.when(share.isNull(), "und")
                .when(share >= min_ascii, "en_likely").otherwise("non_en"))


def long_enough(col: Column, min_chars: int = 30) -> Column:
    return F.coalesce(F.length(col) >= min_chars, F.lit(False))


def is_inbound(col: Column) -> Column:
    """The dump stores the flag as text in varying case."""
    return F.coalesce(F.lower(trim_all(col.cast("string"))) == "true", F.lit(False))


def strip_urls(col: Column) -> Column:
    return trim_all(F.regexp_replace(col, URL, ""))


def extract_urls(col: Column) -> Column:
    """All full or shortened URLs, in order of appearance."""
    pattern = f"(?iu)https?://{NOT_SPACE}+|t\\.co/{NOT_SPACE}+"
    return F.coalesce(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def tokens(col: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD + "{2,}"), F.lit(0))


def ngrams_of(toks: Column) -> Column:
    """Unigrams followed by blank-joined bigrams of neighbouring tokens."""
    n_pairs = F.greatest(F.size(toks) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(toks, F.lit(1), n_pairs),
        F.slice(toks, F.lit(2), n_pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(toks, bigrams)
