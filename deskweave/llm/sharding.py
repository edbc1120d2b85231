"""Shards of near equal bytes by sampled splitters; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskweave.session import cut_lineage


#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Sampled keys for each range, of which quantiles become splitters.
SAMPLES_PER_PIECE = 8
#: Ranges for each shard.
RANGES_PER_SHARD = 8
#: A range of more than this many times the mean is subdivided.
OVERFULL = 2.0
#: A range of so few rows is left as it is.
LEAST_ROWS = 1000


def _position(cuts: list[tuple]) -> Column:
    """Number of splitters that are not above the row's key, found in two steps over at most sqrt(n) splitters each."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))

    def quoted(value: int | str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"{value}L" if value > -(2**63) else "-9223372036854775808L"

    def written(rows: list[tuple]) -> str:
        return "array(" + ", ".join(f"struct({c}L AS text_crc32, {quoted(s)} AS sort_id, {r}L AS row)" for c, s, r in rows) + ")"

    key = "struct(text_crc32, sort_id, row)"
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    block = f"size(filter({written([b[0] for b in blocks])}, c -> c <= {key}))"
    inside = f"element_at(array({', '.join(map(written, blocks))}), greatest({block}, 1))"
    return F.expr(f"CASE WHEN {block} = 0 THEN 0 ELSE ({block} - 1) * {width} + size(filter({inside}, c -> c <= {key})) END")


def _splitters(ranged: DataFrame, wanted: dict[int, tuple[int, int, bool]]) -> set[tuple]:
    """New splitters inside some ranges, from one sample of them all.

    ``wanted``: for a range its total, the pieces it shall have, and whether rows count rather than bytes.  A
    row's chance is its share of the total, so about SAMPLES_PER_PIECE rows for each piece reach the driver,
    and splitters are quantiles of the sample.
    """
    last = max(wanted)
    rate = F.expr("array(" + ", ".join(f"{wanted[k][1] * SAMPLES_PER_PIECE / wanted[k][0]!r}D" if k in wanted else "0D" for k in range(last + 1)) + ")")
    alike = F.expr("array(" + ", ".join(str(k in wanted and wanted[k][2]) for k in range(last + 1)) + ")")
    inside = ranged.where(F.col("range") <= last)
    weight = F.when(F.element_at(alike, F.col("range") + 1), F.lit(1)).otherwise(F.col("size"))
    inside = inside.withColumn("chance", F.least(F.lit(1.0), weight * F.element_at(rate, F.col("range") + 1))).withColumn("weight", weight / F.col("chance"))
    unit = F.pmod(F.xxhash64("text_crc32", "row", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn: dict[int, list] = {}
    for r in inside.where(unit < F.col("chance")).select("range", "text_crc32", "sort_id", "row", "weight").collect():
        drawn.setdefault(r[0], []).append(((r[1], r[2], r[3]), r[4]))
    cuts: set[tuple] = set()
    for k, keys in drawn.items():
        whole, run, made, pieces = sum(w for _, w in keys), 0.0, 0, wanted[k][1]
        for key, share in sorted(keys):
            if made + 1 < pieces and run + share >= whole * (made + 1) / pieces:
                cuts.add(key)
                made += 1
            run += share
    return cuts


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its shard 0..n_shards-1, all shards of nearly the same bytes.

    Columns: the id, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32 (unsigned; a
    null text counts as empty), shard, slot (0, 1, ... within the shard).  Rows are in the order of
    (text_crc32, id), so equal texts lie side by side and share a shard unless a boundary falls among them.

    1. Draw keys with a chance in proportion to the row's size; quantiles of the sample are the splitters.
    2. Count the exact bytes and rows of each range and subdivide those that are overfull, by a new sample of
       their own.  A key ends with a row number fixed in a checkpoint, so copies of one row split as well.
    3. Range-partition by the splitters, add up sizes within each range, and start each range at the exact
       total of those before it.  A row belongs to the shard in which the middle of its bytes lies.

    The result depends on the sample only in how the work is spread, not in the shards.  Null ids come first;
    an empty table gives no rows; fewer bytes than shards leave shards empty.
    """
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    ident = docs[f"`{id_col}`"]
    rows = docs.select(ident.alias("id"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"))
    # The id twice: as it is, and as a key that has no null.
    zero = F.lit("") if dict(rows.dtypes)["id"] == "string" else F.lit(-(2**63)).cast("bigint")
    rows = rows.withColumn("sort_id", F.coalesce(F.col("id") if dict(rows.dtypes)["id"] == "string" else F.col("id").cast("bigint"), zero))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))

    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = whole["bytes"] or 0, whole["n"]
    parts = n_shards * RANGES_PER_SHARD
    cuts = sorted(_splitters(rows.withColumn("range", F.lit(0)), {0: (total, parts, False)})) if total else []
    while True:
        ranged = rows.withColumn("range", _position(cuts))
        counts = {r["range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        wanted = {}
        for k, (size, rows_in) in counts.items():
            if rows_in > LEAST_ROWS and (size > OVERFULL * total / parts or rows_in > OVERFULL * n / parts):
                by_rows = rows_in / n > size / total
                wanted[k] = (rows_in if by_rows else size, 2 + int(max(size * parts / total, rows_in * parts / n)), by_rows)
        extra = _splitters(ranged, wanted) - set(cuts) if wanted else set()
        if not extra:
            break
        cuts = sorted({*cuts, *extra})

    # Exact totals before each range; there are as many ranges as splitters.
    before, at = [], [0, 0]
    for k in range(len(cuts) + 1):
        before.append(tuple(at))
        size, rows_in = counts.get(k, (0, 0))
        at = [at[0] + size, at[1] + rows_in]
    start = F.expr("array(" + ", ".join(f"struct({b}L AS bytes, {r}L AS rows)" for b, r in before) + ")")
    order = Window.partitionBy("range").orderBy("text_crc32", "sort_id", "row")
    placed = (ranged.withColumn("begin", F.element_at(start, F.col("range") + 1))
              .withColumn("past", F.col("begin.bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("place", F.col("begin.rows") + F.row_number().over(order) - 1))
    middle = 2 * F.col("past") + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * max(total, 1)))).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))

