"""Resampling towards a target's distribution of hashed n-grams, ranked by parallel sorting by regular sampling."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskweave.session import cut_lineage

from .texts import ALNUM, LOWER, column, joined, per_text, slices, small_batches, tidy, words

#: Rows for each sorted run and each range of the ranking, and the most there are of either: their square reaches the driver.
RANGE_ROWS = 1024
MOST_RANGES = 1024
#: Words hashed at a time.
CHUNK_WORDS = 1 << 17
#: Bytes of a word hashed by steps over all words; longer words are hashed singly.
STEP_BYTES = 48

# The table of CRC-32 with the reversed polynomial 0xEDB88320.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, np.uint32(0xEDB88320) ^ (_STEP >> 1), _STEP >> 1).astype(np.uint32)


def _zeros_after(x: np.ndarray) -> np.ndarray:
    """What becomes of a checksum's bits by one zero byte more."""
    return _STEP[x & 0xFF] ^ (x >> np.uint32(8))


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """By number of zero bytes 0 to 63, and for 64, 128, ... : the effect of each byte of a checksum at each of its four places."""
    octets = np.arange(256, dtype=np.uint32)
    tables = [np.stack([octets << np.uint32(8 * j) for j in range(4)])]
    for _ in range(64):
        tables.append(_zeros_after(tables[-1]))
    doubled = [tables.pop()]
    for _ in range(34):
        doubled.append(_shifted_by(doubled[-1], doubled[-1]))
    return np.stack(tables), doubled


def _shifted_by(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][x >> 8 & 0xFF] ^ table[2][x >> 16 & 0xFF] ^ table[3][x >> 24]


_SHIFT, _DOUBLED = _shift_tables()


def _shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums' bits after n zero bytes; crc(a + b) is crc(a) shifted by the bytes of b, xor crc(b)."""
    few = n & 63
    out = _SHIFT[few, 0, x & 0xFF] ^ _SHIFT[few, 1, x >> 8 & 0xFF] ^ _SHIFT[few, 2, x >> 16 & 0xFF] ^ _SHIFT[few, 3, x >> 24]
    for i, table in enumerate(_DOUBLED):
        more = np.flatnonzero(n >> (6 + i) & 1)
        if len(more):
            out[more] = _shifted_by(table, out[more])
        elif not (n >> (6 + i)).any():
            break
    return out


def word_checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each word."""
    sizes = end - begin
    short = np.flatnonzero(sizes <= STEP_BYTES)
    by = short[np.argsort(-sizes[short].astype(np.int8), kind="stable")]
    starts, falling = begin[by], -sizes[by]
    state = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for at in range(int(sizes[by[0]]) if len(by) else 0):
        n = int(np.searchsorted(falling, -at))  # words of more than ``at`` bytes
        state[:n] = _STEP[(state[:n] ^ data[starts[:n] + at]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(begin), np.uint32)
    out[by] = ~state
    for i in np.flatnonzero(sizes > STEP_BYTES).tolist():
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes())
    return out


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all runs of 1 to ``longest`` words, some words at a time."""
    raw, starts = joined(texts)
    data = LOWER[raw]
    begin, end, owner = words(data, starts, ALNUM)
    for at in range(0, len(begin), CHUNK_WORDS):
        part = slice(at, at + CHUNK_WORDS + longest - 1)  # runs may end in the next chunk
        first = min(CHUNK_WORDS, len(begin) - at)
        sizes, own, single = (end - begin)[part], owner[part], word_checksums(data, begin[part], end[part])
        run = single
        for k in range(longest):
            if k:  # a space and one word more
                n = len(run) - 1
                run = _shifted(_zeros_after(run[:n]) ^ np.uint32(zlib.crc32(b" ")), sizes[k:]) ^ single[k:]
            n = min(first, len(run))
            inside = own[:n] == own[k : k + n]
            yield own[:n][inside], (run[:n][inside] % np.uint32(buckets)).astype(np.int64)


def count_features(table: DataFrame, longest: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all whole texts fall in each bucket that has any; a task adds up its own first."""
    chosen = table.select(F.coalesce(column(table, text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, bucket in feature_buckets(part.column(0), longest, buckets):
                    counts += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return small_batches(chosen).mapInArrow(tidy(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's share in the target and in the source), from two tables of counts.

    As many numbers as buckets come to the driver.
    """
    held = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for counts, table in zip(held, (source, target), strict=True):
        for r in table.collect():
            counts[r["bucket"]] = r["n"]
    s, t = held[0].tolist(), held[1].tolist()
    whole, other = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * whole / ((a + 1) * other))) for a, b in zip(s, t, strict=True)], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(texts: pa.Array) -> list[np.ndarray]:
        table, n = shared.value, len(texts)
        count, total, single = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (owner, bucket) in enumerate(feature_buckets(texts, longest, len(table))):
            held = np.bincount(owner, minlength=n)
            count += held
            single += held if i % longest == 0 else 0
            bounds = np.concatenate([[0], np.cumsum(held)])  # owners rise
            sums = np.concatenate([[0], np.cumsum(table[bucket])])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
        return [single, count, np.where(count > 0, total // np.maximum(count, 1), 0)]

    return per_text(docs, [column(docs, id_col).cast("bigint")], column(docs, text_col), "id bigint, n_words bigint, n_features bigint, weight bigint", work)


def _noise(seed: str) -> Column:
    """floor of a thousand times a standard Gumbel number that seed and id decide."""
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(unit))).cast("bigint")


_KEY = ["falling", "sort_id", "place"]


def _segments(runs: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows with ``segment``, the number of splitters not above a row's key."""
    n = len(cuts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.concatenate([c, batch.column(name).to_numpy(zero_copy_only=False)]) for c, name in zip(cuts, _KEY, strict=True)]
            own = np.concatenate([np.zeros(n, bool), np.ones(batch.num_rows, bool)])
            order = np.lexsort((own, *reversed(keys)))
            segment = np.empty(len(own), np.int32)
            segment[order] = np.cumsum(~own[order])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[n:])], [*batch.schema.names, "segment"])

    return runs.mapInArrow(run, f"{', '.join(f'{name} {kind}' for name, kind in runs.dtypes)}, segment int")


def _numbers(values: list[int]) -> Column:
    """An array of constants; never an empty one."""
    return F.array(*[F.lit(x).cast("bigint") for x in values or [0]])


def _splitters(runs: DataFrame, sizes: dict[int, int], ranges: int) -> list[np.ndarray]:
    """Keys that part all rows evenly, from regular samples: the middles of ``ranges`` equal stretches of every run."""
    length = F.element_at(_numbers([sizes.get(r, 0) for r in range(max(sizes, default=0) + 1)]), F.col("run") + 1)
    at = F.col("place") % (1 << 33)
    stretch, earlier = F.floor(at * ranges / length + 0.5), F.floor((at - 1) * ranges / length + 0.5)
    drawn = runs.where(stretch > earlier).select(*_KEY, "run", (stretch - earlier).alias("stretches")).toArrow()
    keys = [drawn.column(name).to_numpy() for name in _KEY]
    held = np.array([sizes[r] for r in drawn.column("run").to_pylist()], np.float64) * drawn.column("stretches").to_numpy() / ranges
    order = np.lexsort(tuple(reversed(keys)))
    up_to = np.cumsum(held[order])
    at = np.searchsorted(up_to, up_to[-1] * np.arange(1, ranges) / ranges) if len(up_to) else np.zeros(0, np.int64)
    chosen = order[np.unique(np.minimum(at, len(order) - 1))] if len(up_to) else order
    return [k[chosen] for k in keys]


def rank_highest(rows: DataFrame, share: tuple[int, int], kept: list[str]) -> DataFrame:
    """``kept`` columns of all rows and rank, 1 for the highest ``score`` and so on, for share[0] of share[1] of them; else null.

    Equal scores go by smaller ``id``, null ids last, rows equal in both in any fixed order.  ``rows`` is
    read more than once: write it down before.

    1. Runs of rows are sorted where they are and written down with their places.
    2. Regular samples of all runs give splitters, by which each range holds at most about twice its even share.
    3. Exact counts of the ranges tell which of them the draw reaches; only those are exchanged and merged.
    4. A rank is a row's place in its range after the counts of all ranges before.
    """
    n = rows.count()
    drawn = n * share[0] // share[1]
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    keyed = rows.withColumn("falling", -F.col("score")).withColumn("sort_id", F.coalesce("id", F.lit((1 << 63) - 1)))
    runs = keyed.coalesce(ranges).sortWithinPartitions("falling", "sort_id")
    runs = cut_lineage(runs.withColumn("place", F.monotonically_increasing_id()).withColumn("run", F.shiftright("place", 33).cast("int")))
    sizes = {r["run"]: r["count"] for r in runs.groupBy("run").count().collect()}
    parted = _segments(runs, _splitters(runs, sizes, ranges))
    counts = {r["segment"]: r["count"] for r in parted.groupBy("segment").count().collect()}
    starts, past = [], 0
    for segment in range(max(counts, default=-1) + 1):
        starts.append(past)
        past += counts.get(segment, 0)
    reached = sum(s < drawn for s in starts)
    order = Window.partitionBy("segment").orderBy(*_KEY)
    place = F.row_number().over(order) + F.element_at(_numbers(starts[:reached]), F.col("segment") + 1)
    ranked = parted.where(F.col("segment") < reached).select(*kept, place.cast("bigint").alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(parted.where(F.col("segment") >= reached).select(*kept, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, longest: int = 2, buckets: int = 10_000,
             seed: str = "7:", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """The id, n_words, n_features, weight, score and rank of every row of ``docs``.

    Features are runs of 1 to ``longest`` words - letters, digits and non-ASCII, A-Z in lower case - of the
    whole text, put into buckets by CRC-32.  A bucket's gain compares its smoothed shares in all texts of
    the target and of ``docs``; weight is the floored mean of gains over a row's features (0 without any),
    and score adds a Gumbel number decided by seed and id.  Of the rows with ``least_words`` words,
    floor(share) with the highest scores are drawn and ranked 1, 2, ... (see ``rank_highest``); rank is
    null for all others.

    Ids are whole numbers; a null id counts as empty text in the seed and comes last among equals.  Null
    and empty texts have no features.  Repeated rows are ranked each.  An empty target gives every bucket an
    empty share; an empty table gives no rows.  Extra columns are ignored.
    """
    gain = gains(count_features(docs, longest, buckets, text_col), count_features(target, longest, buckets, target_text_col), buckets)
    scored = cut_lineage(_weighed(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + _noise(seed)))
    kept = ["id", "n_words", "n_features", "weight", "score"]
    ranked = rank_highest(scored.where(F.col("n_words") >= least_words), share, kept)
    short = scored.where(F.col("n_words") < least_words).select(*kept, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(short).withColumnRenamed("id", id_col)
