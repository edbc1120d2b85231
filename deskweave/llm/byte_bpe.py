"""Byte-level BPE encoding and decoding, with each distinct word encoded once."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .texts import column, once, ragged, slices, small_batches, tidy

#: Bytes of text of which words are collected before they are sent on; a longer text is a block alone.
BLOCK_BYTES = 8 << 20
#: Buckets of words for each shuffle partition.
BUCKETS_PER_PARTITION = 3
_LONG = 1 << 23


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Numbering(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers as compressed byte planes."""
    octets = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(octets.T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _places(text: str, pattern: regex.Pattern, number: _Numbering) -> np.ndarray:
    """The number of each pre-token of a text, in order."""
    if len(text) < _LONG:
        return np.array(list(map(number.__getitem__, pattern.findall(text))), np.uint32)
    found, parts = (m.group(0) for m in pattern.finditer(text)), []
    while some := list(islice(found, 1 << 20)):
        parts.append(np.array(list(map(number.__getitem__, some)), np.uint32))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str, buckets: int) -> DataFrame:
    """A row for every block of texts: ids, numbers of words of each text, all texts as numbers of the block's distinct words,
    and, for each bucket of words by hash, the words that fall into it with their numbers."""
    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("t"))
    names = ["block", "ids", "sizes", "places", "buckets", "words", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        part, ids, texts, number, held, blocks = TaskContext.get().partitionId(), [], [], _Numbering(), 0, 0

        def flush() -> pa.RecordBatch:
            spelled = list(number)
            bucket = np.fromiter((_hash_of(w) % buckets for w in spelled), np.int64, len(spelled))
            by = np.argsort(bucket, kind="stable")
            groups = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + blocks], pa.int64()),
                pa.array([[x for some in ids for x in some.to_pylist()]], pa.list_(ids[0].type)),
                pa.array([_packed(np.array([len(t) for t in texts]))], pa.binary()),
                pa.array([_packed(np.concatenate(texts))], pa.binary()),
                pa.array([[int(bucket[g[0]]) for g in groups]], pa.list_(pa.int32())),
                pa.array([[_spelled([spelled[i] for i in g]) for g in groups]], pa.list_(pa.binary())),
                pa.array([[_packed(np.diff(g, prepend=0)) for g in groups]], pa.list_(pa.binary())),
            ], names)

        for batch in batches:
            for some in slices(batch):
                if texts and held + some.column(1).nbytes > BLOCK_BYTES:
                    yield flush()
                    ids, texts, number, held, blocks = [], [], _Numbering(), 0, blocks + 1
                ids.append(some.column(0))
                texts += [_places(t, split, number) for t in some.column(1).to_pylist()]
                held += some.column(1).nbytes
        if texts:
            yield flush()

    return small_batches(chosen).mapInArrow(tidy(run), f"block bigint, ids array<{kind}>, sizes binary, places binary, buckets array<int>, words array<binary>, numbers array<binary>")


def _hash_of(word: str) -> int:
    """A hash that all workers agree on."""
    return zlib.crc32(word.encode())


def _spelled(words: list[str]) -> bytes:
    """Words, packed; none is empty."""
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(4, "little") + sizes.tobytes() + "".join(words).encode())


def _spellings(blob: bytes) -> list[str]:
    """What ``_spelled`` packed."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    text, ends = raw[4 + 4 * n :].decode(), np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<u4"), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every row's whole text; a null or empty text has none.

    1. Each block of texts numbers its pre-tokens as they come; a text becomes a list of numbers.
    2. Distinct words of all blocks are shuffled by hash, and each different word is encoded once.  A word
       comes at most once from a block, so a frequent word is no hot key.
    3. The ids go back to the blocks and are put in the order of the words' positions.

    Rows may repeat and ids may be null or equal; extra columns are ignored.
    """
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((ranks, pattern))  # the vocabulary
    kind = dict(docs.dtypes)[id_col]
    # Both uses below take whole rows, so that this one exchange serves them: blocks are made once.
    rows = _blocks(docs, id_col, text_col, pattern, buckets).repartition("block")

    key = str(uuid.uuid4())

    def coding() -> tiktoken.Encoding:
        ranked, split = shared.value
        return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranked, special_tokens={})

    def merge(table: pa.Table) -> pa.Table:
        coder = once(key, coding)
        known: dict[str, list[int]] = {}
        sizes, ids = [], []
        for blob in table.column("words").to_pylist():
            found = []
            for word in _spellings(blob):
                if word not in known:
                    known[word] = coder.encode_ordinary(word)
                found.append(known[word])
            sizes.append(_packed(np.fromiter(map(len, found), np.int64, len(found))))
            ids.append(_packed(np.fromiter((x for f in found for x in f), np.int64)))
        return pa.table({"block": table.column("block"), "numbers": table.column("numbers"), "sizes": pa.array(sizes, pa.binary()), "tokens": pa.array(ids, pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, words, numbers = (batch.column(i).slice(row, 1).flatten() for i in (4, 5, 6))
                block = pa.array(np.full(len(bucket), batch.column(0)[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([bucket, block, words, numbers], ["bucket", "block", "words", "numbers"])

    requests = rows.mapInArrow(spread, "bucket int, block bigint, words binary, numbers binary")
    coded = requests.groupBy("bucket").applyInArrow(merge, "block bigint, numbers binary, sizes binary, tokens binary")

    def put_together(texts: pa.Table, words: pa.Table) -> pa.Table:
        numbers = [np.cumsum(_unpacked(b)) for b in words.column("numbers").to_pylist()]
        sizes = [_unpacked(b) for b in words.column("sizes").to_pylist()]
        tokens = [_unpacked(b) for b in words.column("tokens").to_pylist()]
        none = [np.zeros(0, np.int64)]
        number, size, flat = np.concatenate(numbers + none), np.concatenate(sizes + none), np.concatenate(tokens + none)
        count, begin = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], begin[number] = size, np.cumsum(size) - size
        ids, chunks = [], []
        for row in texts.select(["ids", "sizes", "places"]).to_pylist():
            places, lengths = _unpacked(row["places"]), _unpacked(row["sizes"])
            ids += row["ids"]
            at = 0
            for end in np.cumsum(lengths):  # a text at a time bounds what is unfolded
                some = places[at:end]
                chunks.append(flat[ragged(begin[some], count[some])].astype(np.int32))
                at = end
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int32)
        values = np.concatenate(chunks) if chunks else np.zeros(0, np.int32)
        return pa.table({id_col: pa.array(ids, texts.schema.field("ids").type.value_type), "ids": pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))})

    return rows.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(put_together, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes of its ids.

    The token-byte table is a side of fixed size, so the join by id is a lookup in each batch.  Null ids give no bytes; an id outside the table raises.
    """
    size = max(ranks.values(), default=-1) + 1
    table = [b""] * size
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    at = encoded.columns.index(ids_col)
    key = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once(key, lambda: pa.array(shared.value, pa.binary()))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                flat = tokens.take(lists.flatten())
                lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                sizes = pa.compute.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
                raw = flat.buffers()[2].to_pybytes() if len(flat) and flat.buffers()[2] else b""
                texts = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), schema)
