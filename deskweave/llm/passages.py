"""Repeated passages: MinHash banding of sentences, exact verification, removal by component."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskweave.session import cut_lineage

from .components import connected_components
from .sides import small_side
from .texts import LOWER, SOLID, column, joined, mixed, ragged, shingles, slices, small_batches, tidy, word_hashes, words

#: Words of a shingle; a paragraph with fewer has none and is compared with nothing.
SHINGLE = 5
#: Least Jaccard similarity of two paragraphs.
SIMILARITY = 0.8
#: Least share of such pairs that bands must bring together.
RECALL = 0.99
#: Minima in a band.
ROWS = 2
#: A run of repeated paragraphs is removed from this many words on; shorter ones are common lines, not passages.
MIN_WORDS = 20
#: Contents of a band key that are paired at once; of a key with more, all are compared in pieces.
FEW = 4
#: Contents of a crowded key that are compared with each other at a time.
PIECE = 1024
#: Words between two repeated paragraphs of a run at most; they stay, and count for nothing.
GAP_WORDS = 12
#: Paragraphs on either side whose keepers may be a paragraph's own in a run.
AROUND = 8
#: Numbers by which paragraphs that count as neighbours differ at most; between them may be one that comes nowhere else.
APART = 2
#: A sentence with more words is cut where the words' hashes say, so that its parts can be told apart.
LONG_SENTENCE = 24
#: Such a cut has the least hash of this many words on either side, so cuts are further apart than that.
REACH = 4
#: Bytes of text that make a block.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each bucket of a band's keys.
BUCKET_BYTES = 16 << 20
_NO_ID = 2**63 - 1
_SEEDS = np.random.default_rng(77).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` minima that bring a pair of this similarity together with the given chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Paragraphs:
    """Sentences of some texts, as ranges of words: cut at line ends and behind . ! ? and, if long, where word hashes say.

    Sentences or lines side by side that are too short to be compared are one.
    """

    def __init__(self, texts: pa.Array):
        data, starts = joined(texts)
        self.starts = starts
        self.begin, self.end, self.owner = words(data, starts, SOLID)
        n = len(self.begin)
        self.hashes = word_hashes(data, self.begin, self.end, LOWER)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        last = np.isin(data[self.end - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
        after = np.concatenate([self.begin[1:], [len(data)]]) if n else self.begin
        ends = last | (lines[after] > lines[self.end])
        if n:
            ends[-1] = True
        stop = np.flatnonzero(ends) + 1
        first = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        short = stop - first < SHINGLE
        both = short[:-1] & short[1:] & (self.owner[first[:-1]] == self.owner[first[1:]]) if n else short
        if both.any():
            ends[stop[:-1][both] - 1] = False
            stop = np.flatnonzero(ends) + 1
            first = np.concatenate([[0], stop[:-1]])
        long = stop - first > LONG_SENTENCE
        if long.any():
            # Cuts depend on the words close by alone; no part has fewer than SHINGLE words.
            inside = ragged(first[long] + REACH, (stop - first)[long] - 2 * REACH - 1)
            value = shingles(self.hashes, 2)
            here, least = value[inside], np.ones(len(inside), bool)
            for apart in range(1, REACH + 1):
                least &= (here < value[inside - apart]) & (here <= value[inside + apart])
            ends[inside[least]] = True
            stop = np.flatnonzero(ends) + 1
            first = np.concatenate([[0], stop[:-1]])
        self.first, self.stop = first, stop
        self.text = self.owner[first] if len(first) else first
        counts = np.bincount(self.text, minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.number = np.arange(len(first)) - self.bounds[self.text] if len(first) else first
        self.size = stop - first
        self.fit = np.flatnonzero(self.size >= SHINGLE)  # those that can be compared
        self.grams = shingles(self.hashes, SHINGLE)
        self.content = self._content()

    def _content(self) -> np.ndarray:
        """64-bit hash of each comparable paragraph's words."""
        if not len(self.fit):
            return np.zeros(0, np.uint64)
        at, count = self.first[self.fit], self.size[self.fit]
        place = ragged(np.zeros(len(at), np.int64), count).astype(np.uint64)
        value = mixed(self.hashes[ragged(at, count)] + place * np.uint64(0x9E3779B97F4A7C15))
        return mixed(np.add.reduceat(value, np.cumsum(count) - count) + count.astype(np.uint64))

    def band_keys(self, chosen: np.ndarray, bands: int) -> np.ndarray:
        """bands x len(chosen): a hash of each band's minima; ``chosen`` indexes ``fit``."""
        at, count = self.first[self.fit[chosen]], self.size[self.fit[chosen]] - SHINGLE + 1
        grams, cuts = self.grams[ragged(at, count)], np.cumsum(count) - count
        keys = np.empty((bands, len(chosen)), np.uint64)
        for band in range(bands):
            key = np.full(len(chosen), band + 1, np.uint64)
            for row in range(ROWS):
                seed = _SEEDS[(band * ROWS + row) % len(_SEEDS)]
                value = grams * seed
                value ^= value >> np.uint64(29)
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(value * seed, cuts))
            keys[band] = key
        return keys

    def shingle_sets(self, chosen: np.ndarray) -> list[np.ndarray]:
        """The shingles of some paragraphs; ``chosen`` indexes ``fit``."""
        at, count = self.first[self.fit[chosen]], self.size[self.fit[chosen]] - SHINGLE + 1
        return [np.unique(self.grams[a : a + c]).view(np.int64) for a, c in zip(at, count, strict=True)]


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes())


def _widened(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _entries(docs: DataFrame, bands: int, buckets: int) -> DataFrame:
    """Entries of blocks of texts, packed by bucket.

    A bucket holds the band keys of one band whose hash falls into it: key, content, and the smallest (id,
    paragraph) of the block with that content.  Negative buckets pass on where the block holds a content again.
    """
    names = ["bucket", "keys", "contents", "ids", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, held = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held], axis=1)
            content, ids, numbers = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            order = np.lexsort((numbers, ids, content))
            first = np.ones(len(order), bool)
            first[1:] = content[order][1:] != content[order][:-1]
            again = np.zeros(len(order), bool)  # whether a content comes more than once
            again[:-1] |= ~first[1:]
            again |= ~first
            rows = {n: [] for n in names}

            def add(bucket: int, key: np.ndarray | None, which: np.ndarray) -> None:
                rows["bucket"].append(bucket)
                rows["keys"].append(None if key is None else _squeezed(key))
                rows["contents"].append(_squeezed(content[which]))
                base = np.diff(ids[which], prepend=0)
                rows["ids"].append(_squeezed(base))
                rows["numbers"].append(_squeezed(numbers[which].astype(np.uint32)))

            if again.any():
                add(-1 - ((part << 20) + blocks), None, order[again])
            one = order[first]
            one = one[np.lexsort((numbers[one], ids[one]))]
            for band in range(bands):
                key = keys[band][one]
                bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                for chunk in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    if len(chunk):
                        add(band * buckets + int(bucket[chunk[0]]), key[chunk], one[chunk])
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for some in slices(batch):
                found = Paragraphs(some.column(1))
                if len(found.fit):
                    ids = some.column(0).to_numpy(zero_copy_only=False)[found.text[found.fit]]
                    every = np.arange(len(found.fit))
                    held.append((found.band_keys(every, bands), found.content, ids, found.number[found.fit]))
                size += some.column(1).nbytes
                if held and size >= BLOCK_BYTES:
                    yield flush()
                    held, size, blocks = [], 0, blocks + 1
        if held:
            yield flush()

    return small_batches(docs).mapInArrow(tidy(run), "bucket bigint, keys binary, contents binary, ids binary, numbers binary")


def _collisions(entries: DataFrame, buckets: int) -> DataFrame:
    """What the buckets show: occurrences of contents that come again (other_id and band_key null), pairs of paragraphs of different content to verify, and members of crowded keys.

    The different contents of a key are all paired, or, if there are more than FEW, come out once each with band_key and members, their number.
    """
    schema = "content bigint, id bigint, number int, other_id bigint, other_number int, band_key bigint, members bigint"

    def search(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        content = np.concatenate([_widened(b, "<u8") for b in table.column("contents").to_pylist()])
        ids = np.concatenate([np.cumsum(_widened(b, "<i8")) for b in table.column("ids").to_pylist()])
        numbers = np.concatenate([_widened(b, "<u4") for b in table.column("numbers").to_pylist()]).astype(np.int64)
        if bucket < 0:
            return _rows(content, ids, numbers)
        keys = np.concatenate([_widened(b, "<u8") for b in table.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        same[1:] = keys[order][1:] == keys[order][:-1]
        same[:-1] |= same[1:]
        order = order[same]  # those that collide
        order = order[np.lexsort((numbers[order], ids[order], content[order], keys[order]))]
        key, held = keys[order], content[order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_content = new_key.copy()
        new_content[1:] |= held[1:] != held[:-1]
        again = np.zeros(len(order), bool)
        again[1:] = ~new_content[1:]
        again[:-1] |= again[1:]
        exact = order[again] if bucket < buckets else order[:0]  # every band shows the same ones
        # Of each key, the first of every content stands for it.
        lead = np.flatnonzero(new_content)
        start = np.flatnonzero(new_key[lead])
        count = np.diff(np.concatenate([start, [len(lead)]]))
        few, many = count <= FEW, count > FEW
        ends = [(lead[:0], lead[:0])]
        for apart in range(1, FEW):
            some = few & (count > apart)
            first = ragged(start[some], count[some] - apart)
            ends.append((lead[first + apart], lead[first]))
        a, b = order[np.concatenate([x for x, _ in ends])], order[np.concatenate([x for _, x in ends])]
        crowd = order[lead[ragged(start[many], count[many])]]
        return pa.concat_tables([
            _rows(content[exact], ids[exact], numbers[exact]), _rows(content[a], ids[a], numbers[a], ids[b], numbers[b]),
            _rows(content[crowd], ids[crowd], numbers[crowd], keys=keys[crowd], members=np.repeat(count[many], count[many]))])

    def _rows(content, ids, numbers, other=None, other_number=None, keys=None, members=None) -> pa.Table:  # noqa: ANN001
        n = len(content)
        return pa.table({
            "content": content.view(np.int64), "id": ids.astype(np.int64), "number": numbers.astype(np.int32),
            "other_id": pa.nulls(n, pa.int64()) if other is None else other.astype(np.int64),
            "other_number": pa.nulls(n, pa.int32()) if other is None else other_number.astype(np.int32),
            "band_key": pa.nulls(n, pa.int64()) if keys is None else keys.view(np.int64),
            "members": pa.nulls(n, pa.int64()) if members is None else members.astype(np.int64)})

    return entries.groupBy("bucket").applyInArrow(search, schema)


def _forest(grams: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all sets of shingles with a Jaccard similarity, directly or by way of others.

    A set is compared with all that no link has reached, so alike sets cost one look each and only sets unlike all others meet each other.
    """
    sizes = np.array([len(g) for g in grams], np.int64)
    flat = np.unique(np.concatenate(grams), return_inverse=True)[1]
    cuts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(flat), bool)
    rest, waiting, a, b = np.arange(len(grams)), [], [], []
    while len(rest):
        if waiting:
            node = waiting.pop()
        else:
            node, rest = int(rest[0]), rest[1:]
        if not len(rest):
            break
        mine = flat[cuts[node] : cuts[node] + sizes[node]]
        mark[mine] = True
        shared = np.add.reduceat(mark[flat[ragged(cuts[rest], sizes[rest])]], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        mark[mine] = False
        near = shared >= similarity * (sizes[node] + sizes[rest] - shared)
        a += [node] * int(near.sum())
        b += rest[near].tolist()
        waiting += rest[near].tolist()
        rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _crowd_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all alike contents of each crowded key (id, number, band_key, members).

    Small keys share a bucket.  A large one is cut into pieces, and each two pieces meet in a group of their
    own that returns a spanning forest.
    """
    buckets = max(1, members.count() // PIECE)
    pieces = F.ceil(F.col("members") / PIECE).cast("int")
    spread = (members.withColumn("pieces", pieces)
              .withColumn("bucket", F.when(F.col("pieces") > 1, F.col("band_key")).otherwise(F.pmod(F.xxhash64("band_key"), F.lit(buckets))))
              .withColumn("own", F.pmod(F.xxhash64("id", "number", F.lit(5)), F.col("pieces")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
              .select("id", "number", "band_key", "bucket", (F.col("pieces") > 1).alias("cut"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, content = (table.column(c).to_numpy() for c in ("band_key", "content"))
        held = table.column("grams").chunk(0)
        offsets, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        a, b = [content[:0]], [content[:0]]
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            left, right = _forest([flat[offsets[i] : offsets[i + 1]] for i in some], similarity)
            a.append(content[some[left]])
            b.append(content[some[right]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.join(sets, ["id", "number"]).groupBy("cut", "bucket", "low", "high").applyInArrow(search, "a bigint, b bigint")


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, number, content, grams) of the paragraphs in ``asked`` (id, numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.select([0, 2, 1])):
                found = Paragraphs(some.column(2))
                wanted = some.column(1)
                counts = pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)
                text, number = np.repeat(np.arange(len(counts)), counts), wanted.flatten().to_numpy(zero_copy_only=False)
                fine = number < np.diff(found.bounds)[text]
                unit = (found.bounds[text] + number)[fine]
                chosen = np.searchsorted(found.fit, unit)
                there = (chosen < len(found.fit)) & (found.fit[np.minimum(chosen, max(0, len(found.fit) - 1))] == unit) if len(found.fit) else np.zeros(len(unit), bool)
                chosen = chosen[there]
                grams = found.shingle_sets(chosen)
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(pa.array(text[fine][there])), pa.array(number[fine][there].astype(np.int32)),
                    pa.array(found.content[chosen].view(np.int64)), pa.array(grams, pa.list_(pa.int64()))], ["id", "number", "content", "grams"])

    joined_docs = docs.join(small_side(asked, F.size("numbers")), "id").select("id", "t", "numbers")
    return joined_docs.mapInArrow(tidy(run), "id bigint, number int, content bigint, grams array<bigint>")


def _keepers(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, late): for each text its paragraphs that a text with a smaller id has too, or one nearly the same."""
    held = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(8, -(-held // BUCKET_BYTES))
    found = cut_lineage(_collisions(_entries(docs, bands_for(similarity), buckets), buckets))
    exact = found.where("other_id IS NULL AND band_key IS NULL").select("content", "id", "number")
    pairs = found.where("other_id IS NOT NULL").select("id", "number", "other_id", "other_number").distinct()
    crowd = found.where("band_key IS NOT NULL").select("id", "number", "band_key", "members")
    ends = pairs.select("id", "number").union(pairs.select("other_id", "other_number")).union(crowd.select("id", "number")).groupBy("id").agg(F.collect_set("number").alias("numbers"))
    sets = cut_lineage(_sets(docs, ends).dropDuplicates(["id", "number", "content"]))
    other = sets.select(F.col("id").alias("other_id"), F.col("number").alias("other_number"), F.col("content").alias("other_content"), F.col("grams").alias("other_grams"))
    shared = F.size(F.array_intersect("grams", "other_grams"))
    alike = (pairs.join(sets, ["id", "number"]).join(other, ["other_id", "other_number"])
             .where(shared >= similarity * (F.size("grams") + F.size("other_grams") - shared)))
    links = alike.select(F.col("content").alias("a"), F.col("other_content").alias("b"))
    roots = connected_components(links.union(_crowd_links(crowd, sets, similarity)))
    # Every occurrence of a content that comes again or has a near copy.
    near = sets.select("content", "id", "number").join(roots.select(F.col("node").alias("content")), "content", "left_semi")
    places = cut_lineage(exact.union(near).distinct())
    low = places.groupBy("content").agg(F.min("id").alias("low"))
    group = low.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    keeper = cut_lineage(group.join(group.groupBy("root").agg(F.min("low").alias("keeper")), "root").select("content", "root", "keeper"))
    rooted = cut_lineage(_followed(places.join(keeper, "content")))
    late = rooted.where("id > keeper")
    # The first texts that have a paragraph, or it and its neighbour, also for those around: a run can follow any of them.
    around = Window.partitionBy("id").orderBy("number").rangeBetween(-AROUND, AROUND)
    late = late.withColumn("nearby", F.collect_set(F.array_compact(F.array("keeper", "pair_keeper"))).over(around))
    asked = late.withColumn("nearby", F.array_distinct(F.flatten("nearby"))).withColumn("kept", F.explode(F.filter("nearby", lambda x: x < F.col("id"))))
    spots = cut_lineage(rooted.groupBy("root", F.col("id").alias("kept")).agg(F.min("number").alias("place"), (F.min("number") < F.max("number")).alias("several")))
    marks = asked.join(spots, ["root", "kept"]).groupBy("id", "number", "content", "keeper").agg(F.sort_array(F.collect_set(F.struct("kept", "place", "several"))).alias("spots"))
    return marks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "content", "keeper", "spots"))).alias("late"))


def _followed(rooted: DataFrame) -> DataFrame:
    """``rooted`` with ``pair_keeper``: the smallest id of a text in which a paragraph alike comes before one like the next.

    A passage of sentences that each occur in some earlier text has no keeper of its own among these; the first
    text that holds two of them side by side is the first that can hold the passage.
    """
    order = Window.partitionBy("id").orderBy("number", "content")
    behind = F.lead(F.struct("root", "number")).over(order)
    ahead = rooted.withColumn("behind", behind).withColumn("next_root", F.when(F.col("behind.number") - F.col("number") <= APART, F.col("behind.root"))).drop("behind")
    ahead = cut_lineage(ahead)
    low = cut_lineage(ahead.where("next_root IS NOT NULL").groupBy("root", "next_root").agg(F.min("id").alias("pair_keeper")))
    return ahead.join(low, ["root", "next_root"], "left").drop("next_root")


def remove_repeats(docs: DataFrame, keep: list[Column], schema: str, id_col: str = "doc_id", text_col: str = "text",
                   similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``keep`` columns of every row, clean (its text without passages that a text with a smaller id has) and cuts.

    A paragraph is a sentence, a part of a long one, or short lines side by side; bands of MinHash minima of its five-word shingles bring alike ones together,
    and exact Jaccard similarity verifies them.  Components of alike paragraphs stay in the text with the smallest id.
    In other texts, runs of such paragraphs that one earlier text holds in the same order, as far apart and with up
    to GAP_WORDS words between, are cut if the repeated words alone are ``min_words`` or more; words between stay.
    Where the earlier text has a paragraph several times, any of its places counts as fitting.
    cuts: array of (start, end in UTF-8 bytes, n_words, kept_id).  A repeat within one text stays.

    Entries of a block of texts hold each content once, so a passage that a third of all texts share comes to a
    task once per block.  Within a band's key all contents are compared, those of a crowded key in pieces that
    return only a spanning forest of their links.

    Rows of one id count as one text.  Rows with a null id come last and keep nothing from others.  A null text stays
    null with no cuts; a text left without a word is empty; extra columns are ignored unless kept.
    """
    key = F.coalesce(column(docs, id_col).cast("bigint"), F.lit(_NO_ID))
    slim = docs.select(key.alias("id"), column(docs, text_col).cast("string").alias("t"))
    late = _keepers(slim.where("t IS NOT NULL"), similarity)
    names = [f"k{i}" for i in range(len(keep))]
    wide = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], key.alias("id"), column(docs, text_col).cast("string").alias("t"))
    # A merge join at every size: the marks have no bound, and the work then grows evenly.
    wide = wide.hint("merge").join(late, "id", "left").select(*names, "late", "t")
    cuts = "array<struct<start:bigint,end:bigint,n_words:bigint,kept_id:bigint>>"
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "n_words", "kept_id")]))
    outs = [x.strip().split(" ")[0] for x in schema.split(",")] + ["clean", "cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                texts, marks = some.column(len(names) + 1), some.column(len(names))
                clean, spans = [None] * len(texts), [[] for _ in range(len(texts))]
                marked = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
                if len(marked):
                    chosen = texts.take(pa.array(marked))
                    parts = Paragraphs(chosen)
                    for i, (row, late_ones) in enumerate(zip(marked.tolist(), marks.take(pa.array(marked)).to_pylist(), strict=True)):
                        spans[row] = _runs(parts, i, late_ones, min_words)
                        if spans[row]:
                            clean[row] = _without(texts[row].as_py().encode(), spans[row])
                kept = pa.array(clean, pa.string())
                kept = pa.compute.coalesce(kept, texts.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(names))), kept, pa.array(spans, kind)], outs)

    return wide.mapInArrow(tidy(run), f"{schema}, clean string, cuts {cuts}")


def _runs(parts: Paragraphs, text: int, late: list[dict], min_words: int) -> list[dict]:
    """Spans of words to cut, from the paragraphs of one text that come again."""
    base, n = int(parts.bounds[text]), int(parts.bounds[text + 1] - parts.bounds[text])
    units: list[tuple[int, int, int, dict]] = []
    for x in late:
        unit = base + x["number"]
        place = int(np.searchsorted(parts.fit, unit))
        # A row of the same id may hold another text; only the content says that this is the paragraph meant.
        if x["number"] >= n or place >= len(parts.fit) or parts.fit[place] != unit or int(parts.content[place : place + 1].view(np.int64)[0]) != x["content"]:
            continue
        if units and units[-1][0] == x["number"]:
            continue
        units.append((x["number"], int(parts.first[unit]), int(parts.stop[unit]), {y["kept"]: None if y["several"] else y["place"] for y in x["spots"]}))
    # For each keeper that units may follow: the units of its run so far, and their words.
    open_runs: dict[int, list[int]] = {}
    done: list[tuple[int, list[int]]] = []
    for i, (number, first, _, spots) in enumerate(units):
        for kept, place in spots.items():
            run = open_runs.get(kept)
            if run is not None:
                before, _, stop, its = units[run[-1]]
                then = its[kept]
                if first - stop > GAP_WORDS or (place is not None and then is not None and place - then != number - before):
                    done.append((kept, run))
                    run = None
            if run is None:
                run = open_runs[kept] = []
            run.append(i)
    done += open_runs.items()
    keeper: dict[int, int] = {}  # of units to cut, the smallest
    for kept, run in done:
        if sum(units[i][2] - units[i][1] for i in run) >= min_words:
            for i in run:
                keeper[i] = min(kept, keeper.get(i, kept))
    spans: list[list[int]] = []
    for i in sorted(keeper):
        _, first, stop, _ = units[i]
        if spans and spans[-1][1] == first and spans[-1][2] == keeper[i]:
            spans[-1][1] = stop
        else:
            spans.append([first, stop, keeper[i]])
    start = int(parts.starts[text])
    return [{"start": int(parts.begin[a]) - start, "end": int(parts.end[b - 1]) - start, "n_words": b - a, "kept_id": kept} for a, b, kept in spans]


def _without(text: bytes, spans: list[dict]) -> str:
    """The text without spans of bytes, and without blanks that would then begin it, end it or meet a blank."""
    out, at = b"", 0
    for span in spans:
        out += text[at : span["start"]]
        at = span["end"]
        if not out or out[-1:].isspace():
            while at < len(text) and text[at : at + 1] in (b" ", b"\t"):
                at += 1
    out += text[at:]
    return out.decode() if out.strip() else ""
