"""Ordered keyword rules compiled into plain column expressions.

A rule list is short and known when the plan is built, so it is unrolled into
one projection: no join, no shuffle, and each literal pattern compiles once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, matches, whole_words


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a list of alternatives, or a full regex if not ``whole_word``."""

    name: str
    pattern: str
    reason: str = ""
    whole_word: bool = True

    @property
    def regex(self) -> str:
        return whole_words(self.pattern) if self.whole_word else self.pattern

    def hits(self, text: Column) -> Column:
        return matches(text, self.regex)


def hit_names(text: Column, rules: Sequence[Rule]) -> Column:
    """Names of every rule that matches, in rule order."""
    return F.array_compact(F.array(*[F.when(r.hits(text), F.lit(r.name)) for r in rules]))


def only_hit(hits: Column) -> Column:
    """The single name in ``hits``; null when none or several matched."""
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def weak_label(text: Column, rules: Sequence[Rule], exclude: Rule | None) -> Column:
    """Weak label: exactly one rule matched and the exclusion rule did not."""

    def label(bound: Column) -> Column:
        one = bind(hit_names(bound, rules), only_hit)
        return one if exclude is None else F.when(~exclude.hits(bound), one)

    return bind(text, label)


def gate_array(text: Column, rules: Sequence[Rule], intent: Column | None = None,
               catch_all_intent: str | None = None, catch_all: Rule | None = None) -> Column:
    """Every gate that fires, in order, as structs of (rank, gate, reason).

    ``catch_all`` fires on ``intent == catch_all_intent`` and ranks last.
    """
    fired = [F.when(r.hits(text), _gate(i, r)) for i, r in enumerate(rules)]
    if catch_all is not None and intent is not None:
        fired.append(F.when(F.coalesce(intent == catch_all_intent, F.lit(False)), _gate(len(rules), catch_all)))
    return F.array_compact(F.array(*fired))


def first_gate(text: Column, rules: Sequence[Rule], intent: Column | None = None,
               catch_all_intent: str | None = None, catch_all: Rule | None = None) -> Column:
    """First gate that fires as a struct, or null; later patterns are not evaluated."""
    fired = [F.when(r.hits(text), _gate(i, r)) for i, r in enumerate(rules)]
    if catch_all is not None and intent is not None:
        fired.append(F.when(F.coalesce(intent == catch_all_intent, F.lit(False)), _gate(len(rules), catch_all)))
    return F.coalesce(*fired)


def _gate(rank: int, rule: Rule) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(rule.name).alias("gate"), F.lit(rule.reason).alias("reason"))
