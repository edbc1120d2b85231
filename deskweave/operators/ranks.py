"""Ranks and running sums that never put one group into one task.

A plain window sends all rows of a partition key to a single task.  Here a
group is first split into order-preserving pieces; pieces are ranked in
parallel and shifted by the (tiny) prefix sums of the piece totals.

Keys are packed into one struct: unlike bare nulls, structs of nulls are equal to
each other, so rows with a null key stay in every join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def seeded_hash(id_col: Column, seed: object) -> Column:
    """Reproducible shuffle order: md5 of 'id|seed'."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"|{seed}")))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    salt_on: str, rank_col: str = "rn", salts: int = 64) -> DataFrame:
    """First ``n`` rows of every group under ``order`` (a total order).

    Two rounds: the first keeps ``n`` rows of each salted piece, the second ranks
    only those.  ``row_number() <= n`` also lets Spark cut rows before the
    shuffle.
    """
    salt = F.pmod(F.xxhash64(salt_on), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    pieces = df.withColumn("_salt", salt).withColumn("_local", F.row_number().over(first)).filter(F.col("_local") <= n)
    return (
        pieces.drop("_salt", "_local").withColumn(rank_col, F.row_number().over(second)).filter(F.col(rank_col) <= n)
    )


#: Strata up to which their sizes are summed in one task, and rows up to which the offsets of pieces are broadcast.
FEW_STRATA, BROADCAST_PIECES = 100_000, 500_000


def hash_ranks(df: DataFrame, strata: Sequence[str], id_col: str, seed: object, prefix_chars: int = 3) -> DataFrame:
    """Add ``rank`` (1.. within the stratum by seeded hash), ``stratum_n``, ``stratum_before`` and ``all_n``.

    ``stratum_before`` is the number of rows in the strata sorting earlier, so
    ``stratum_before + rank`` numbers all ``all_n`` rows.  ``df`` is read once and written down with its hashes,
    so pass narrow rows and join the result by id.  Pieces are leading hash digits: equally large whatever
    the data, and already in order; their counts are written down as well, and everything else follows from them.
    """
    hashed = cut_lineage(df.withColumn("_key", F.struct(*strata)).withColumn("_hash", seeded_hash(F.col(id_col), seed)).withColumn(
        "_piece", F.substring("_hash", 1, prefix_chars)))
    local = Window.partitionBy("_key", "_piece").orderBy("_hash", id_col)
    ranked = hashed.withColumn("_local", F.row_number().over(local))
    pieces = cut_lineage(hashed.groupBy("_key", "_piece").agg(F.count(F.lit(1)).alias("_n")))
    within = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(pieces.groupBy("_key").agg(F.sum("_n").alias("stratum_n")))
    n_strata, all_n = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("stratum_n"), F.lit(0))).first()
    if n_strata <= FEW_STRATA:
        earlier = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        totals = sizes.withColumn("stratum_before", F.coalesce(F.sum("stratum_n").over(earlier), F.lit(0)))
    else:  # then their own order is cut into pieces like any other
        named = sizes.select(F.col("_key").alias("_stratum"), "stratum_n", F.lit(0).alias("_all"))
        totals = running_sums(named, ["_all"], ["_stratum"], {"_upto": F.col("stratum_n")}).select(
            F.col("_stratum").alias("_key"), "stratum_n", (F.col("_upto") - F.col("stratum_n")).alias("stratum_before"))
    offsets = pieces.select("_key", "_piece", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_before")).join(totals, "_key")
    offsets = cut_lineage(offsets.withColumn("all_n", F.lit(all_n).cast("long")))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_PIECES else offsets
    return (
        ranked.join(offsets, ["_key", "_piece"])
        .withColumn("rank", F.col("_before") + F.col("_local"))
        .drop("_key", "_hash", "_piece", "_local", "_before")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
                 pieces: int = 2048) -> DataFrame:
    """Running sums per key, current row included, along ``order``; rows equal there follow a hash of the row.

    ``pieces`` sampled rows, of all keys together, are splitters: a key with a share of the rows gets that
    share of them and is cut into ranges of the order columns, so that pieces have about equal rows
    however the values bunch.  A row's place in the order ends with a hash of all its columns, so rows that are
    equal in ``order`` are cut as well; only rows that are equal in every column stay together.  The
    sample, and with it the broadcast, is bounded by ``pieces``, not by the data.
    """
    named = in_pieces(df, keys, order, pieces, {f"_v_{name}": c for name, c in sums.items()})
    local = Window.partitionBy("_key", "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    totals = named.groupBy("_key", "_piece").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    # A key has no more pieces than splitters.
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_key", "_piece", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums]
    )
    summed = named.select("*", *[F.sum(f"_v_{name}").over(local).alias(f"_l_{name}") for name in sums])
    joined = summed.join(offsets, ["_key", "_piece"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{name}") + F.col(f"_b_{name}")).alias(name) for name in sums]
    )


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int, extra: Mapping[str, Column]) -> DataFrame:
    """``df`` and ``extra`` with ``_key``, the place ``_at`` in the order, and ``_piece``, the range of ``_at`` it falls into."""
    rows = df.select("*", F.struct(*keys).alias("_key"), F.struct(*order, F.xxhash64(*df.columns).alias("_tie")).alias("_at"),
                     *[c.alias(name) for name, c in extra.items()])
    # The rows with the smallest hashes are an even sample of exactly this size.
    drawn = rows.select("_key", "_at").orderBy(F.xxhash64("_key", "_at", F.lit("splitter"))).limit(pieces)
    cuts = drawn.groupBy("_key").agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    # Looked up in two steps: blocks of splitters by their first one, then within the block.
    width = max(2, int(pieces**0.5))
    heads = F.transform(F.sequence(F.lit(1), F.size("_cuts"), F.lit(width)), lambda i: F.element_at("_cuts", i))
    cuts = cuts.withColumn("_heads", heads)
    block = F.size(F.filter("_heads", lambda c: c <= F.col("_at")))
    inside = F.slice("_cuts", (F.greatest(F.col("_block"), F.lit(1)) - 1) * width + 1, width)
    return (
        rows.join(F.broadcast(cuts), "_key", "left").withColumn("_block", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(block))
        .withColumn("_piece", F.when(F.col("_block") == 0, F.lit(0)).otherwise(
            (F.col("_block") - 1) * width + F.size(F.filter(inside, lambda c: c <= F.col("_at")))))
        .drop("_cuts", "_heads", "_block")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str, carried: Sequence[str] = ()) -> DataFrame:
    """Pre-counted rows (keys, value, weight, and ``carried`` columns that tell them apart) with the mean rank of their value.

    Rows of equal value share a rank: the middle between the weights before the first and those up to the last of them.
    """
    summed = running_sums(df.select(*keys, value, weight, *carried), keys, [value, *carried], {"_upto": F.col(weight)})
    # Ties lie side by side; their span reaches from the least sum before to the largest sum after.
    spans = summed.groupBy(*keys, value).agg((F.min(F.col("_upto") - F.col(weight)) + 1).alias("_low"), F.max("_upto").alias("_high"))
    named = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"), ((F.col("_low") + F.col("_high")) / 2).alias("avg_rank"))
    same = F.col(value) == F.col("_value")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return summed.join(named, same).select(*keys, value, weight, *carried, "avg_rank")
