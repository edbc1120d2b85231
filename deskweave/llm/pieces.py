"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .texts import column, once, per_text, ragged, small_batches, tidy

#: Words a task remembers with their ids before it starts anew.
REMEMBERED = 300_000
#: Symbols of a word beyond which it is merged alone, touching only the places that change.
ALONE = 4096
#: Ids decoded at a time; a longer row is decoded alone.
DECODE_IDS = 1 << 20
_BLOCK = 512
_LONG = 1 << 23
# The mark that stands for a space, and what an unknown id decodes to.
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
_NONE = np.int32(2**31 - 1)


class Merges:
    """The vocabulary as arrays: characters, merges of two symbols by rank, and ids.

    A symbol is a character or a piece.  Two neighbours merge if their strings together are a piece; its
    rank follows its score, equal scores having equal ranks.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        pieces = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, byte_ids)) or any(map(self.library.is_unused, range(size))):
            raise ValueError("needs a vocabulary with all bytes as pieces and no unused ones")
        self.byte_ids = np.array(byte_ids, np.int32)
        names = [*pieces, *sorted({c for p in pieces for c in p} - pieces.keys())]
        number = {name: i for i, name in enumerate(names)}
        self.ids = np.array([pieces.get(name, -1) for name in names], np.int32)
        self.characters = np.full(0x110000, -1, np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.characters[ord(name)] = i
        order = {score: rank for rank, score in enumerate(sorted({-self.library.get_score(i) for i in pieces.values()}))}
        self.count = len(names)
        splits = [(number[p[:k]] * self.count + number[p[k:]], order[-self.library.get_score(i)], number[p])
                  for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs, self.ranks, self.made = np.array(sorted(splits), np.int64).reshape(-1, 3).T.copy()
        self.ranks, self.made = self.ranks.astype(np.int32), self.made.astype(np.int32)
        self._make_table()
        inside = {ord(p[k]) << 21 | ord(p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        self.inside = np.array(sorted(inside), np.int64)
        #: No piece has the mark behind another character, so that a word begins at every run of marks.
        self.splits_at_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def _make_table(self) -> None:
        """Where to look for a pair: slots by hash, of which a pair has the first that was free."""
        bits = max(4, int(2 * len(self.pairs)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.probes = 0
        left, at = np.arange(len(self.pairs)), self._slot(self.pairs)
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for a slot, one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each two symbols' merge (_NONE: there is none) and the symbol it makes."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.count + right, -1)
        entry = np.full(len(key), -1, np.int64)
        asked, at = np.arange(len(key)), self._slot(key)
        for _ in range(self.probes):
            found = self.slots[at]
            hit = (found >= 0) & (self.pairs[found] == key[asked])
            entry[asked[hit]] = found[hit]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            asked, at = asked[more], (at[more] + 1) & self.mask
        return np.where(entry >= 0, self.ranks[entry], _NONE), self.made[entry]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        # A segment ends where two characters stand side by side in no piece: nothing merges across.
        cut = owner[1:] != owner[:-1]
        both = points[:-1] << 21 | points[1:]
        cut |= self.inside[np.minimum(np.searchsorted(self.inside, both), len(self.inside) - 1)] != both if len(self.inside) else True
        segment = np.concatenate([[0], np.cumsum(cut)]) if len(points) else np.zeros(0, np.int64)
        symbols = self.characters[points]
        place = np.arange(len(points))
        if len(points):
            long = np.flatnonzero(np.bincount(segment) > ALONE)
            apart = np.isin(segment, long)
            done = [self._rounds(symbols[~apart], segment[~apart], place[~apart])]
            done += [self._alone(symbols[segment == s], place[segment == s]) for s in long]
            symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
            by = np.argsort(place, kind="stable")
            symbols, place = symbols[by], place[by]
        return self._ids(symbols, place, points, owner, len(words))

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair is, and their places.

        A round merges in every segment the pairs of its least rank, from the left, those that overlap an
        earlier one excepted.  The order of single merges is kept: where a merge makes a neighbour whose
        rank is not above its own, that one comes next, so the segment's later pairs wait for another round.
        """
        finished = []
        if len(symbols) > 1:
            rank, made = self.merge_of(symbols[:-1], symbols[1:])
            rank[segment[1:] != segment[:-1]] = _NONE
            rank, made = np.append(rank, _NONE), np.append(made, -1)
        else:
            rank, made = np.full(len(symbols), _NONE), np.full(len(symbols), -1)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sizes = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            active = np.repeat(least < _NONE, sizes)
            finished.append((symbols[~active], place[~active]))
            symbols, segment, place, rank, made = (x[active] for x in (symbols, segment, place, rank, made))
            if not len(symbols):
                break
            chosen = np.flatnonzero(rank == np.repeat(least[least < _NONE], sizes[least < _NONE]))
            # Pairs side by side overlap: of such a run, the first, third, ... merge.
            run = np.concatenate([[True], np.diff(chosen) != 1])
            chosen = chosen[(np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            chosen = self._until_overtaken(chosen, symbols, segment, rank, made)
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            new = np.cumsum(keep)[chosen] - 1
            symbols, segment, place, rank, made = (x[keep] for x in (symbols, segment, place, rank, made))
            touched = np.zeros(len(symbols), bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed], made[changed] = _NONE, -1
            ask = changed[(changed + 1 < len(symbols))]
            ask = ask[segment[ask] == segment[ask + 1]]
            rank[ask], made[ask] = self.merge_of(symbols[ask], symbols[ask + 1])
        kept = [np.concatenate(x) for x in zip(*finished, strict=True)] if finished else [symbols, place]
        return kept[0], kept[1]

    def _until_overtaken(self, chosen: np.ndarray, symbols: np.ndarray, segment: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """The chosen pairs of each segment up to the first one that makes a neighbour of no higher rank."""
        own, of = rank[chosen], segment[chosen]
        after_pair = np.concatenate([[False], np.diff(chosen) == 2]) & np.concatenate([[False], of[1:] == of[:-1]])
        before = np.where(after_pair, made[np.roll(chosen, 1)], symbols[chosen - 1])
        before = np.where((chosen > 0) & (segment[chosen - 1] == of), before, -1)
        right = np.minimum(chosen + 2, len(symbols) - 1)
        behind = np.where((chosen + 2 < len(symbols)) & (segment[right] == of), symbols[right], -1)
        overtaken = (self.merge_of(before, made[chosen])[0] <= own) | (self.merge_of(made[chosen], behind)[0] <= own)
        if not overtaken.any():
            return chosen
        so_far = np.cumsum(overtaken) - overtaken  # before each pair
        start = np.concatenate([[True], of[1:] != of[:-1]])
        return chosen[so_far - so_far[np.flatnonzero(start)[np.cumsum(start) - 1]] == 0]

    def _alone(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``_rounds`` gives for one long segment, a pair a round: the least rank is kept for each block of places."""
        n = -(-len(symbols) // _BLOCK) * _BLOCK
        rank, made = np.full(n, _NONE), np.full(n, -1)
        rank[: len(symbols) - 1], made[: len(symbols) - 1] = self.merge_of(symbols[:-1], symbols[1:])
        symbols, rows = symbols.copy(), rank.reshape(-1, _BLOCK)
        least = rows.min(axis=1)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        alive = np.ones(len(symbols), bool)
        while True:
            block = int(least.argmin())
            if least[block] == _NONE:
                return symbols[alive], place[alive]
            at = block * _BLOCK + int(rows[block].argmin())
            gone = after[at]
            symbols[at], alive[gone], rank[gone] = made[at], False, _NONE
            after[at] = follower = after[gone]
            if follower < len(symbols):
                before[follower] = at
            places = [p for p in (before[at], at) if p >= 0]
            ask = [p for p in places if after[p] < len(symbols)]
            rank[at] = _NONE
            if ask:
                rank[ask], made[ask] = self.merge_of(symbols[ask], symbols[[after[p] for p in ask]])
            for b in {p // _BLOCK for p in (*places, gone)}:
                least[b] = rows[b].min()

    def _ids(self, symbols: np.ndarray, place: np.ndarray, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; a character without a piece becomes its bytes."""
        ids = np.where(symbols >= 0, self.ids[symbols], -1)
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            spelled = [chr(p).encode("utf-8", "surrogatepass") for p in points[place[strange]].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[strange] = [len(s) for s in spelled]
            begin = np.cumsum(sizes) - sizes
            whole = np.repeat(ids, sizes)
            whole[ragged(begin[strange], sizes[strange])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            return np.bincount(np.repeat(owner[place], sizes), minlength=n), whole.astype(np.int32)
        return np.bincount(owner[place], minlength=n), ids.astype(np.int32)


class _Lexicon:
    """Words seen so far, with their ids in one array; the words of a text follow one another."""

    def __init__(self, model: bytes):
        self.merges = Merges(model)
        self.words = re.compile(f"[^{MARK}]+|{MARK}+[^{MARK}]*") if self.merges.splits_at_marks else re.compile("(?s).+")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.counts, self.begins, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, found: list[str]) -> None:
        new = list(set(found).difference(self.number))
        if not new:
            return
        counts, ids = self.merges.encode(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(counts) - counts])
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, ids])

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word counted, all ids) of words in the order of a text."""
        if len(self.number) > REMEMBERED:
            self.clear()
        self._learn(words)
        some = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.counts[some], self.flat[ragged(self.begins[some], self.counts[some])]

    def encode(self, texts: list[str]) -> pa.Array:
        normal = [self.merges.library.normalize(t) if t else "" for t in texts]
        if len(normal) == 1 and len(normal[0]) >= _LONG:  # in parts, which bounds what is held
            found, parts = (m.group(0) for m in self.words.finditer(normal[0])), []
            while some := list(islice(found, 1 << 20)):
                parts.append(self._of(some)[1])
            flat, offsets = np.concatenate(parts), [0, sum(map(len, parts))]
        else:
            split = [self.words.findall(t) for t in normal]
            counts, flat = self._of([w for words in split for w in words])
            bounds = np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])[bounds]
        return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row and ids, the pieces of its whole text as the vocabulary's own library numbers them.

    The file at ``path`` (BPE with byte pieces) is read by the driver and handed to the tasks.  A text is
    normalised, cut into words at its marks of spaces - no piece crosses such a place, which is proven from
    the vocabulary - and the different words of a slice of texts are merged together in rounds.  There is no
    shuffle, so that frequent words are no hot keys.

    Null and empty texts have no ids.  Equal ranks merge from the left.  Rows may repeat and have null ids,
    extra columns are ignored, an empty table gives no rows; no begin or end ids are added, and the names of
    such ids inside a text are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    key = str(uuid.uuid4())

    def work(texts: pa.Array) -> list:
        return [once(key, lambda: _Lexicon(shared.value)).encode(texts.to_pylist())]

    return per_text(docs, keep, column(docs, text_col), schema + ", ids array<int>", work)


def _decoded_bytes(raw: bytes) -> str:
    """The characters that a run of byte pieces spells; a byte that begins none stands as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Surfaces:
    """What each id stands for, as one array of bytes."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.byte = np.array([library.is_byte(i) for i in range(size)])
        self.silent = np.array([library.is_control(i) for i in range(size)])
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [not (self.byte[i] or self.silent[i] or library.is_unknown(i)) for i in range(size)]
        self.marked = np.array([p and n.startswith(MARK) for p, n in zip(plain, names, strict=True)])
        # A space is put before every text when it is encoded; it goes again if the vocabulary does that.
        self.dummy = library.normalize("a").startswith(MARK)
        spelled = [n.replace(MARK, " ").encode() if plain[i] else bytes([int(n[3:5], 16)]) if self.byte[i] else b"" if self.silent[i] else UNKNOWN_SURFACE.encode()
                   for i, n in enumerate(names)]
        self.table = pa.array(spelled, pa.binary())

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        flat = self.table.take(pa.array(ids))
        sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = flat.buffers()[2].to_pybytes()[: ends[-1]] if len(flat) and flat.buffers()[2] else b""
        loud = np.concatenate([np.flatnonzero(~self.silent[ids]), [len(ids)]])
        first = loud[np.searchsorted(loud, offsets[:-1])]
        drop = (first < offsets[1:]) & self.dummy
        drop[drop] = self.marked[ids[first[drop]]]
        out = []
        for a, b, dropped in zip(offsets[:-1].tolist(), offsets[1:].tolist(), drop.tolist(), strict=True):
            spelled = raw[ends[a] : ends[b]]
            try:
                # A silent id ends a run of bytes, so that what stands around it spells no character together.
                text = self._piece_by_piece(ids[a:b], flat[a:b]) if self.silent[ids[a:b]].any() else spelled.decode()
            except UnicodeDecodeError:
                text = self._piece_by_piece(ids[a:b], flat[a:b])
            out.append(text[1:] if dropped else text)
        return out

    def _piece_by_piece(self, ids: np.ndarray, flat: pa.Array) -> str:
        byte, spelled, out = self.byte[ids].tolist(), flat.to_pylist(), []
        at = 0
        while at < len(byte):
            to = at + 1
            while byte[at] and to < len(byte) and byte[to]:
                to += 1
            run = b"".join(spelled[at:to])
            out.append(_decoded_bytes(run) if byte[at] else run.decode())
            at = to
        return "".join(out)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text that its ids stand for.

    Begin and end ids are silent, runs of byte pieces become characters, bytes that spell none become U+FFFD,
    and the space put before every text goes.  Null or empty ids give an empty text; an id outside the
    vocabulary raises.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    at, key = encoded.columns.index(ids_col), str(uuid.uuid4())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = once(key, lambda: _Surfaces(shared.value))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                past = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, past + DECODE_IDS, side="right")))
                part = batch.slice(start, stop - start)
                offsets = np.concatenate([[0], ends[start:stop] - past])
                made = surfaces.texts(part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names)
                start = stop

    return small_batches(encoded.select("*")).mapInArrow(tidy(run), schema)
