"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage



def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; nodes of a component share one root.

    Each round points every node at the neighbour that comes first in hash order, follows the pointers once
    more, and contracts the links to what is left; hash order makes long chains shrink as fast as stars, so
    the rounds grow with the logarithm of the longest path.  All steps are minima that combine before the
    shuffle and joins of checkpointed tables, whose hot keys Spark splits.  Links with a null end and links
    of a node to itself count for nothing; no links give an empty table.
    """

    def clean(x: DataFrame) -> DataFrame:
        return cut_lineage(x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def first(x: str) -> F.Column:
        return F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("v"))

    left = clean(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    roots = None
    while roots is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min(first("b")).alias("near"))
        point = cut_lineage(near.select(F.col("a").alias("node"), F.least(first("a"), "near")["v"].alias("to")))
        then = point.select(F.col("node").alias("to"), F.col("to").alias("root"))
        point = cut_lineage(point.join(then, "to").select("node", "root"))
        if roots is None:
            roots = point
        else:
            further = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        for end in ("a", "b"):
            left = left.join(point.select(F.col("node").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
        left = clean(left.select("a", "b"))
    return roots
