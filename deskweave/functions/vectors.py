"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(vec: Column) -> Column:
    """Unit-length copy of ``vec``; a zero vector stays zero."""
    return bind(norm(vec), lambda length: F.transform(
        vec, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))))
