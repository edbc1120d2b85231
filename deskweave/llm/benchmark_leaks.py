"""Benchmark decontamination: item-sized SimHash windows, a multi-index over blocks of bits, exact verification."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .sides import small_side
from .texts import ALNUM, LOWER, column, joined, mixed, once, shingles, slices, small_batches, tidy, word_hashes, words

#: Words of a shingle in the exact comparison, and in the fingerprints.
SHINGLE, FEATURE = 5, 2
#: Least weighted similarity of a window and an item.
SIMILARITY = 0.8
#: Windows start every so many parts of an item's length.
STEPS = 8
#: Bits in which the fingerprint of a window that overlaps a leak may differ from the item's.
RADIUS = 20
#: Blocks of bits; of BLOCKS blocks one differs in at most RADIUS // BLOCKS bits.
BLOCKS = 4
#: Benchmark words held by tasks at a time; a larger benchmark is scanned in several passes.
PASS_WORDS = 400_000
_LANES = np.array([sum((x >> k & 1) << 8 * k for k in range(8)) for x in range(256)], np.uint64)
_HIGH, _GATHER = np.uint64(0x8080808080808080), np.uint64(0x0102040810204080)
_ONES = 0x0101010101010101


def _lane_bytes(size: int) -> int:
    """Bytes of a lane that counts to ``size``."""
    return np.min_scalar_type(size).itemsize


def _rolling(features: np.ndarray, lane: int = 1) -> np.ndarray:
    """Eight running sums for each byte of a lane; each holds the counts of 8 // lane bits, a lane for each, of all features so far."""
    if lane > 1:
        some = 8 // lane
        sums = np.zeros((64 // some, len(features) + 1), np.uint64)
        for k in range(len(sums)):
            bits = sum((features >> np.uint64(some * k + j) & np.uint64(1)) << np.uint64(8 * lane * j) for j in range(some))
            np.cumsum(bits, out=sums[k, 1:])
        return sums
    octets = features.view(np.uint8).reshape(-1, 8)
    sums = np.zeros((8, len(features) + 1), np.uint64)
    for k in range(8):
        np.cumsum(_LANES[octets[:, k]], out=sums[k, 1:])
    return sums


def _fingerprints(sums: np.ndarray, size: int, step: int) -> np.ndarray:
    """Bits set in over half the features of every window of ``size`` features, whose lanes count that far, a window every ``step``."""
    n = sums.shape[1] - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(range(0, n, step)), np.uint64)
    some = 64 // len(sums)
    if some < 8:
        for k in range(len(sums)):
            counts = sums[k, size::step][: len(out)] - sums[k, :n:step]
            for j, lane in enumerate(counts.view(f"<u{8 // some}").reshape(-1, some).T):
                out |= (lane > size // 2).astype(np.uint64) << np.uint64(some * k + j)
        return out
    lift = np.uint64((127 - size // 2) * _ONES)
    for k in range(8):
        # The difference of two running sums is exact modulo 2**64, and no lane of it overflows.
        counts = sums[k, size::step][: len(out)] - sums[k, :n:step]
        # A lane's highest bit shows that its count exceeds half of the window.
        high = ((counts + lift) & _HIGH) >> np.uint64(7)
        out |= (high * _GATHER >> np.uint64(56)) << np.uint64(8 * k)
    return out


def _nearby(octets: int, radius: int) -> np.ndarray:
    """For every value of a 16-bit block, whether it is within ``radius`` bits of ``octets``."""
    return np.bitwise_count(np.arange(1 << 16, dtype=np.uint16) ^ np.uint16(octets)) <= radius


@dataclass
class _Sized:
    """Items of one number of words."""

    words: int
    items: list[int] = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: list[np.ndarray] = field(default_factory=list)


class Leaks:
    """Finds the windows of texts that repeat a benchmark item."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS, shared: dict[int, int] | None = None):
        """``shared``: of the items' shingles that several items of the whole benchmark hold, how many do; None if ``items`` are all of it."""
        self.similarity, self.radius = similarity, radius
        self.ids = [i for i, _ in items]
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, starts = joined(texts)
        begin, end, owner = words(data, starts, ALNUM)
        hashes = word_hashes(data, begin, end, LOWER)
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        self.shingled: list[Counter] = []
        lengths = np.diff(bounds)
        in_items: Counter = Counter()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.shingled.append(Counter(self._shingles(hashes[a:b]).tolist()))
            in_items.update(self.shingled[-1].keys())
        # A shingle that many items share says less of each.
        self.weight = {s: 1 / (n if shared is None else shared.get(s, 1)) for s, n in in_items.items()}
        self.known = np.sort(np.array(list(in_items), np.uint64))
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.known >> np.uint64(48)).astype(np.int64)] = True
        groups: dict[int, _Sized] = {}
        for i, n in enumerate(lengths.tolist()):
            if n >= SHINGLE:
                groups.setdefault(n, _Sized(n)).items.append(i)
        self.sized = []
        for n, group in sorted(groups.items()):
            for at in range(0, len(group.items), 64):  # a bit of a 64-bit set for each item
                part = _Sized(n, group.items[at : at + 64])
                size = self._features(n)
                part.prints = np.array([_fingerprints(_rolling(self._feature(hashes[bounds[i] : bounds[i + 1]]), _lane_bytes(size)), size, 1)[0] for i in part.items], np.uint64)
                sets = np.min_scalar_type((1 << len(part.items)) - 1).type
                for k in range(BLOCKS):
                    table = np.zeros(1 << 16, sets)
                    for bit, value in enumerate(part.prints.tolist()):
                        table[_nearby(value >> 16 * k & 0xFFFF, radius // BLOCKS)] |= sets(1 << bit)
                    part.tables.append(table)
                self.sized.append(part)
        self.longest = max(lengths.tolist(), default=0)

    @staticmethod
    def _shingles(hashes: np.ndarray) -> np.ndarray:
        return shingles(hashes, SHINGLE)

    @staticmethod
    def _feature(hashes: np.ndarray) -> np.ndarray:
        return mixed(shingles(hashes, FEATURE))

    @staticmethod
    def _features(n: int) -> int:
        """Features of a fingerprint of n words."""
        return n - FEATURE + 1

    def _candidates(self, part: _Sized, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item of the group): all windows within the radius, found by blocks that nearly agree."""
        step = max(1, part.words // STEPS)
        prints = _fingerprints(sums, self._features(part.words), step)
        octets = prints.view(np.uint16).reshape(-1, 4)
        some = part.tables[0][octets[:, 0]]
        for k in range(1, BLOCKS):
            some |= part.tables[k][octets[:, k]]
        at = np.flatnonzero(some)
        some = some[at].astype(np.uint64)
        window, item = [], []
        for bit, value in enumerate(part.prints):
            asked = at[(some >> np.uint64(bit) & np.uint64(1)).astype(bool)]
            near = asked[np.bitwise_count(prints[asked] ^ value) <= self.radius]
            window.append(near)
            item.append(np.full(len(near), bit))
        return np.concatenate(window) * step, np.concatenate(item)

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text number, item number, first word, words, similarity): for every text and item, the best window."""
        best: dict[tuple[int, int], tuple] = {}
        for text, item, start, window in self._windows(texts, self._likely):
            alike = self.alike(item, window)
            old = best.get((text, item))
            if alike >= self.similarity and (old is None or (-alike, start) < (-old[2], old[0])):
                best[text, item] = (start, len(window), alike)
        return [(text, item, *found) for (text, item), found in sorted(best.items())]

    def open_windows(self, texts: pa.Array) -> list[tuple[int, int, int, int, float, float, list[int]]]:
        """(text number, item number, first word, words, both, either, others): the windows that may be the best, whatever others weigh.

        ``others`` are the shingles, repeats counted, that no item of this pass holds; each adds its weight, from
        0 to 1, to ``either``, and both / either is the similarity.
        """
        made, least = {}, {}
        for text, item, start, window in self._windows(texts, self._possible):
            if (text, item, start) in made:
                continue
            both, either, others = self._sums(item, window)
            made[text, item, start] = (len(window), both, either, others)
            low = both / (either + len(others)) if either else 0.0
            least[text, item] = max(least.get((text, item), self.similarity), low)
        return [(text, item, start, *x) for (text, item, start), x in sorted(made.items()) if x[2] and x[1] / x[2] >= least[text, item] - 1e-9]

    def _windows(self, texts: pa.Array, choose: Callable) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text number, item number, first word, word hashes) of the windows around candidates that ``choose`` names."""
        data, starts = joined(texts)
        begin, end, owner = words(data, starts, ALNUM)
        if not len(begin) or not self.sized:
            return
        hashes = word_hashes(data, begin, end, LOWER)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        # Words before and behind, so that windows that begin outside exist; verification stays within a text.
        pad = self.longest
        features = np.concatenate([np.zeros(pad, np.uint64), self._feature(hashes), np.zeros(pad + 1, np.uint64)])
        lane, sums = 0, None
        grams = shingles(hashes, SHINGLE)
        may = np.flatnonzero(self.first[(grams >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.known, grams[may]), max(0, len(self.known) - 1))
        held = np.zeros(len(hashes) + 1, np.int64)
        held[may[self.known[slot] == grams[may]] + 1] = 1
        held = np.cumsum(held)
        for part in self.sized:  # by size, so that the sums of one lane width are held at a time
            if lane != _lane_bytes(self._features(part.words)):
                lane = _lane_bytes(self._features(part.words))
                sums = None
                sums = _rolling(features, lane)
            window, bit = self._candidates(part, sums)
            window, reach = window - pad, max(1, part.words // STEPS)
            # Without a shingle of some item nearby the weighted similarity is zero.
            low, high = np.clip(window - reach, 0, len(hashes)), np.clip(window + part.words + reach, 0, len(hashes))
            fine = held[high] > held[low]
            window, bit = window[fine], bit[fine]
            for at, b in zip(window.tolist(), bit.tolist(), strict=True):
                yield from self._around(part, part.items[b], at - reach, at + reach, hashes, owner, first, choose)

    def _around(self, part: _Sized, item: int, low: int, high: int, hashes: np.ndarray, owner: np.ndarray, first: np.ndarray, choose: Callable) -> Iterator[tuple]:
        """Windows of the item's size that start from low to high, within each text there."""
        n = part.words
        for text in range(owner[min(max(low, 0), len(owner) - 1)], owner[min(max(high + n, 0), len(owner) - 1)] + 1):
            a, b = int(first[text]), int(first[text + 1])
            begin = max(low, a)
            if min(n, b - begin) < SHINGLE:
                continue
            for start in (choose(item, hashes[begin : min(max(begin, min(high, b - n)) + n, b)], n) + begin).tolist():
                yield text, item, start - a, hashes[start : min(start + n, b)]

    def _likely(self, item: int, stretch: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows of n words in a stretch that may be the best one over the threshold."""
        found = self._slid(item, stretch, n, 1.0)
        return np.flatnonzero(found >= max(self.similarity, found.max()) - 1e-6)

    def _possible(self, item: int, stretch: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows of n words in a stretch that may be the best one over the threshold, whatever shingles of no item here weigh."""
        least = self._slid(item, stretch, n, 1.0).max()
        return np.flatnonzero(self._slid(item, stretch, n, 0.0) >= max(self.similarity, least) - 1e-6)

    def _slid(self, item: int, stretch: np.ndarray, n: int, unknown: float) -> np.ndarray:
        """Similarity of every window of n words in a stretch, kept up word by word; shingles of no item weigh ``unknown``."""
        grams, its = self._shingles(stretch).tolist(), self.shingled[item]
        width = min(len(grams), n - SHINGLE + 1)
        mine: Counter = Counter()
        weight, own = self.weight.get, sum(self.weight[s] * c for s, c in its.items())
        both = total = 0.0
        found = np.zeros(len(grams) - width + 1)
        for at, s in enumerate(grams):
            if at >= width:
                old = grams[at - width]
                w = weight(old, unknown)
                both -= w * (mine[old] <= its.get(old, 0))
                total -= w
                mine[old] -= 1
            w = weight(s, unknown)
            both += w * (mine[s] < its.get(s, 0))
            total += w
            mine[s] += 1
            if at >= width - 1:
                found[at - width + 1] = both / max(1e-12, own + total - both)
        return found

    def _sums(self, item: int, window: np.ndarray) -> tuple[float, float, list[int]]:
        """Weights in both and in either of window and item, without the shingles of no item here, and those, repeats counted."""
        mine, its = Counter(self._shingles(window).tolist()), self.shingled[item]
        known = [s for s in mine.keys() | its.keys() if s in self.weight]
        both = math.fsum(self.weight[s] * min(mine[s], its[s]) for s in known)
        either = math.fsum(self.weight[s] * max(mine[s], its[s]) for s in known)
        return both, either, [s for s, n in mine.items() if s not in self.weight for _ in range(n)]

    def alike(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of shingles to 12 decimals, repeats counted; a shingle of several items weighs their share."""
        both, either, others = self._sums(item, window)
        return round(both / (either + len(others)), 12) if either else 0.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item, first_word, n_words, similarity): every text and benchmark item of which a window repeats the item.

    Texts and items are words of letters, digits and non-ASCII characters, lower-cased.  Of each item size,
    windows of that many words get a fingerprint of their word pairs; blocks of bits that nearly agree give
    all windows within the radius, and windows around them are compared exactly by weighted shingles of
    five words.  One row for each text and item, with its best window; rows
    of a repeated id come out one by one, so equal rows may repeat.  Null texts, and items that are null or
    have fewer than five words, match nothing.

    Tasks hold the benchmark, PASS_WORDS words at most at a time; a larger one takes more passes over ``docs``.
    Shingles weigh by all items of the benchmark in any case: the counts of a pass's own shingles go with it, those
    of other passes' items are joined to the few windows that may be the best.
    """
    spark = docs.sparkSession
    items = benchmark.select(column(benchmark, item_col).alias("item"), column(benchmark, item_text_col).cast("string").alias("text")).where("text RLIKE '\\\\S'")
    items = items.withColumn("n", F.size(F.split("text", "\\s+")))
    total = items.agg(F.sum("n")).first()[0] or 0
    passes = 1 + total // PASS_WORDS
    kinds = f"{id_col} {dict(docs.dtypes)[id_col]}, {item_col} {dict(benchmark.dtypes)[item_col]}, first_word bigint, n_words bigint, similarity double"
    chosen = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("t")).where("t IS NOT NULL")

    def scan(held: Broadcast) -> DataFrame:
        """The rows asked for, by a benchmark of one pass."""
        key = str(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks = once(key, lambda: Leaks(held.value, similarity, radius))
            for batch in batches:
                for part in slices(batch):
                    found = leaks.find(part.column(1))
                    ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([leaks.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.float64())], names)

        return small_batches(chosen).mapInArrow(tidy(run), kinds)

    def scan_open(held: Broadcast) -> DataFrame:
        """(text, nth, id, item, first_word, n_words, both, either, others): windows, texts and items numbered, by one of several passes."""
        key = str(uuid.uuid4())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaks, text = once(key, lambda: Leaks(held.value[0], similarity, radius, held.value[1])), TaskContext.get().partitionId() << 40
            for batch in batches:
                for part in slices(batch):
                    found = leaks.open_windows(part.column(1))
                    grams = [np.array(f[6], np.uint64).view(np.int64) for f in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([text + f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                        part.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([leaks.ids[f[1]] for f in found], item_type),
                        *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)), *(pa.array([f[k] for f in found], pa.float64()) for k in (4, 5)),
                        pa.array(grams, pa.list_(pa.int64()))], ["text", "nth", "id", "item", "first_word", "n_words", "both", "either", "others"])
                    text += part.num_rows

        kind = f"text bigint, nth bigint, id {dict(docs.dtypes)[id_col]}, item {dict(benchmark.dtypes)[item_col]}, first_word bigint, n_words bigint, both double, either double, others array<bigint>"
        return small_batches(chosen).mapInArrow(tidy(run), kind)

    names = [id_col, item_col, "first_word", "n_words", "similarity"]
    item_type = pa.string() if dict(benchmark.dtypes)[item_col] == "string" else pa.int64() if dict(benchmark.dtypes)[item_col] == "bigint" else pa.int32()
    items = items.select("item", "text", F.pmod(F.xxhash64("item", "text"), F.lit(passes)).alias("turn")).distinct()

    def listed(some: DataFrame) -> list[tuple]:
        return sorted(((r["item"], r["text"]) for r in some.collect()), key=str)

    if passes == 1:
        return scan(spark.sparkContext.broadcast(listed(items)))
    shared = cut_lineage(_shared_shingles(items))
    turns = []
    for turn in range(passes):
        own = {r["gram"] % (1 << 64): r["n"] for r in shared.where(F.array_contains("turns", F.lit(turn).cast("bigint"))).collect()}
        turns.append(scan_open(spark.sparkContext.broadcast((listed(items.where(F.col("turn") == turn)), own))).withColumn("turn", F.lit(turn)))
    opened = cut_lineage(reduce(DataFrame.union, turns).withColumn("row", F.monotonically_increasing_id()))
    weights = (opened.select("row", F.explode("others").alias("gram")).join(small_side(shared.select("gram", "n")), "gram", "left")
               .groupBy("row").agg(F.sum(1 / F.coalesce("n", F.lit(1))).alias("more")))
    alike = F.round(F.col("both") / (F.col("either") + F.coalesce("more", F.lit(0.0))), 12)
    done = opened.join(weights, "row", "left").withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    best = done.groupBy("turn", "text", "nth").agg(F.min_by(F.struct("id", "item", "first_word", "n_words", "similarity"), F.struct(-F.col("similarity"), "first_word")).alias("best"))
    return best.select(*[F.col(f"best.{c}").alias(n) for c, n in zip(("id", "item", "first_word", "n_words", "similarity"), names, strict=True)])


def _shared_shingles(items: DataFrame) -> DataFrame:
    """(gram, n, turns): shingles of several items, how many hold each, and the passes of those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, starts = joined(part.column(1))
                begin, end, owner = words(data, starts, ALNUM)
                grams, inside = shingles(word_hashes(data, begin, end, LOWER), SHINGLE), owner[SHINGLE - 1 :]
                fine = owner[: len(grams)] == inside[: len(grams)]
                both = np.unique(np.stack([owner[: len(grams)][fine], grams[fine].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(both[0])), pa.array(both[1])], ["turn", "gram"])

    each = small_batches(items.select("turn", "text")).mapInArrow(tidy(run), "turn bigint, gram bigint")
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.collect_set("turn").alias("turns")).where("n > 1")
