"""Joins with a side whose size is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

#: Numbers, of all rows together, up to which a side of a join is broadcast.
BROADCAST_NUMBERS = 2_000_000


def small_side(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """``df``, computed once, and marked for broadcast if it holds few numbers; a larger one is joined by a shuffle.

    ``numbers`` is how many a row holds, by default one for each column.
    """
    held = cut_lineage(df)
    total = held.agg(F.sum(numbers if numbers is not None else F.lit(len(df.columns)))).first()[0] or 0
    return F.broadcast(held) if total <= BROADCAST_NUMBERS else held
