"""Array work on batches of texts, used inside Spark tasks.

A slice of a batch is one byte buffer with a newline after every text, so that words, their hashes and
their shingles come from a few array operations instead of a loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time; one longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch at most; JVM and Python hold a few batches each.
BATCH_ROWS = 1000
#: Bytes hashed at a time.
_HASH_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEPS = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of words: all but white space; letters, digits and non-ASCII.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_kept: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept for later tasks in the same worker under a key of the job's own; only the latest few are."""
    if key not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return df[f"`{name}`"]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most BATCH_ROWS rows from now on in its session, since texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives freed memory back at its end; Spark keeps a worker for the tasks of later stages."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose last column, a text, holds about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def per_text(df: DataFrame, keep: Sequence[Column], text: Column, schema: str, work: Callable[[pa.Array], Sequence]) -> DataFrame:
    """``keep`` columns of every row beside what ``work`` makes of a slice of texts (null counts as empty).

    ``schema`` names the kept columns first; ``work`` returns one array per further column.
    """
    chosen = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(text.cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in work(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays(kept + made, names)

    names = [x.split(" ")[0] for x in _split_schema(schema)]
    return small_batches(chosen).mapInArrow(tidy(run), schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(word.strip())
            word = ""
        else:
            word += c
    return [*parts, word.strip()]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, a newline after each, and where each text starts."""
    parts = pc.cast(texts, pa.binary()).to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]


def words(data: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that are ``solid``."""
    mask = solid[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, _HASH_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each word; ``fold`` maps bytes first (lower case)."""
    out = np.empty(len(begin), np.uint64)
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + _HASH_BYTES, side="right")))
        low, high = begin[at], end[to - 1]
        up, down = _power(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        out[at:to] = mixed((sums[end[at:to] - low] - sums[begin[at:to] - low]) * down[begin[at:to] - low])
        at = to
    return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word; runs over the end of a text are the caller's to drop."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _STEPS[j]
    return mixed(out)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1 as compressed byte planes."""
    octets = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(octets.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    """What ``packed`` made, as 64-bit numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(total) + np.repeat(starts - skip, counts)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links a[i]-b[i] connect it with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root
