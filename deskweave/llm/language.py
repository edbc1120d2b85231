"""Language identification with a convolutional network over bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .sides import small_side
from .texts import column, joined, once, per_text, ragged, small_batches

#: Bytes of a window; windows overlap so that every run of up to the widest filter is inside one.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bound of the training sample: different texts of a language, and windows of a text.
TEXTS_PER_LANGUAGE = 700
WINDOWS_PER_TEXT = 4
#: Texts of the sample in all; many languages share them, with one text each at least.
TEXTS_IN_ALL = 280_000
UNDETERMINED = "und"
_STEP = WINDOW - max(WIDTHS) + 1


def windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows over whole texts, zero-padded at the end of a text, and the text of each."""
    counts = np.maximum(1, -(-(sizes - (WINDOW - _STEP)) // _STEP))
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin = np.repeat(starts, counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * _STEP
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < (starts + sizes)[owner][:, None]
    return np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8), owner


@dataclass
class ByteNet:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    names: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # width x EMBEDDING x FILTERS
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width, what its first two and its last one or two bytes add to each filter."""
        made = []
        for kernel in self.filters:
            one = [(self.embedding @ k).astype(np.float32) for k in kernel]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(256 * 256, -1)
            made.append((pair(one[0], one[1]), None if len(one) == 2 else one[2] if len(one) == 3 else pair(one[2], one[3])))
        return made

    def probabilities(self, views: np.ndarray, tables: list, batch: int = 64) -> np.ndarray:
        out = np.empty((len(views), len(self.names)), np.float32)
        for at in range(0, len(views), batch):
            some = views[at : at + batch].astype(np.int32)
            pairs = some[:, :-1] * 256 + some[:, 1:]
            pooled = []
            for kernel, shift, (head, tail) in zip(self.filters, self.offsets, tables, strict=True):
                width = len(kernel)
                y = np.take(head, pairs[:, : WINDOW - width + 1], axis=0)
                if width == 3:
                    y += np.take(tail, some[:, 2:], axis=0)
                elif width == 4:
                    y += np.take(tail, pairs[:, 2:], axis=0)
                pooled.append(np.maximum(y.max(axis=1) + shift, 0))
            z = np.concatenate(pooled, axis=1) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + batch] = z / z.sum(axis=1, keepdims=True)
        return out


def train(views: np.ndarray, target: np.ndarray, names: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteNet:
    """Fit the network by Adam on windows and the number of each one's language; classes count alike."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.5, (256, EMBEDDING))]
    params += [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names))]
    weight = (len(target) / np.maximum(1, np.bincount(target, minlength=len(names))) / len(names))[target]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    n = len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(views))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, size = views[rows], len(rows)
            embedded = params[0][x]
            pooled, where = [], []
            for k, width in enumerate(WIDTHS):
                y = sum(embedded[:, j : WINDOW - width + 1 + j] @ params[1 + k][j] for j in range(width))
                place = y.argmax(axis=1)
                where.append(place)
                pooled.append(np.take_along_axis(y, place[:, None, :], axis=1)[:, 0] + params[1 + n + k])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ params[-2] + params[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = z / z.sum(axis=1, keepdims=True)
            slope[np.arange(size), target[rows]] -= 1
            slope *= weight[rows][:, None] / size
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ slope, slope.sum(axis=0)
            back = (slope @ params[-2].T) * (raw > 0)
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + n + k] = part.sum(axis=0)
                for j in range(width):
                    seen = np.take_along_axis(x, where[k] + j, axis=1)
                    grads[1 + k][j] = np.einsum("nfe,nf->ef", params[0][seen], part)
                    np.add.at(grads[0], seen.ravel(), (part[:, :, None] * params[1 + k][j].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(names, params[0], params[1 : 1 + n], params[1 + n : 1 + 2 * n], params[-2], params[-1])


def training_windows(docs: DataFrame, text_col: str, label: Column, texts_per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """(lang, view): evenly spread windows of a sample of each language's different texts, by a hash of the text."""
    rows = docs.select(label.cast("string").alias("lang"), column(docs, text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text RLIKE '\\\\S'")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts = cut_lineage(rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.min("hash").alias("least")))
    texts = min(texts_per_language, max(1, TEXTS_IN_ALL // max(1, counts.count())))
    shares = counts.select("lang", "least", F.least(F.lit(1.0), texts / F.greatest(F.col("n"), F.lit(1))).alias("share"))
    # Every language has one text at least, that of its least hash.
    drawn = rows.join(small_side(shares), "lang").where((F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.col("hash") == F.col("least")))
    drawn = drawn.dropDuplicates(["lang", "hash"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data, starts = joined(batch.column(1))
            sizes = np.diff(np.concatenate([starts, [len(data)]])) - 1
            taken = np.minimum(WINDOWS_PER_TEXT, np.maximum(1, sizes // WINDOW))
            owner = np.repeat(np.arange(len(sizes)), taken)
            nth = ragged(np.zeros(len(taken), np.int64), taken)
            begin = (nth * np.maximum(0, sizes - WINDOW)[owner]) // np.maximum(1, taken[owner] - 1)
            views = [data[starts[o] + b : starts[o] + min(sizes[o], b + WINDOW)].tobytes() for o, b in zip(owner, begin, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(views, pa.binary())], ["lang", "view"])

    return small_batches(drawn).mapInArrow(run, "lang string, view binary")


def fit(docs: DataFrame, text_col: str, label: Column, texts_per_language: int = TEXTS_PER_LANGUAGE) -> ByteNet | None:
    """A network trained on the rows of ``docs`` whose label is not null; None if there are none.

    Every label is learned.  Only a bounded sample reaches the driver: about TEXTS_PER_LANGUAGE texts of a
    language, TEXTS_IN_ALL together or one of each, and WINDOWS_PER_TEXT windows of a text.
    """
    drawn = sorted((r["lang"], bytes(r["view"])) for r in training_windows(docs, text_col, label, texts_per_language).collect())
    if not drawn:
        return None
    names = sorted({lang for lang, _ in drawn})
    views = np.zeros((len(drawn), WINDOW), np.uint8)
    for i, (_, view) in enumerate(drawn):
        views[i, : len(view)] = np.frombuffer(view, np.uint8)
    return train(views, np.array([names.index(lang) for lang, _ in drawn]), names)


def _lettered(texts: pa.Array, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    plain = np.zeros(256, bool)
    plain[[*range(65, 91), *range(97, 123)]] = True
    found = np.add.reduceat(plain[data], starts, dtype=np.int64) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def predict(docs: DataFrame, model: ByteNet | None, keep: list[Column], schema: str, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row, and with ``with_text`` its text (empty for null), which then need not be kept.

    All windows of a text are scored; their probabilities are averaged by the bytes they hold, and score is the
    mean of the language named, of equally likely ones the first by name.  A text that is null or has no letter
    is ``und`` with score 0, as is every text if there was nothing to learn from.  Rows may repeat; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, whatever the tables hold
    key = str(uuid.uuid4())

    def work(texts: pa.Array) -> list:
        net = shared.value
        data, starts = joined(texts)
        known = _lettered(texts, data, starts)
        echo = [texts] if with_text else []
        if net is None:
            return [pa.array([UNDETERMINED] * len(texts)), np.zeros(len(texts)), *echo]
        tables = once(key, net.tables)
        sizes = np.diff(np.concatenate([starts, [len(data)]])) - 1
        total = np.zeros((len(sizes), len(net.names)))
        at = 0
        while at < len(sizes):  # a few texts at a time, or a part of the windows of a long one
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 19))))
            for some, owner in _parts(data, starts[at:to], sizes[at:to]):
                chance = net.probabilities(some, tables)
                np.add.at(total, at + owner, chance * np.maximum(1, (some != 0).sum(axis=1))[:, None])
            at = to
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        score = np.where(known, total[np.arange(len(best)), best], 0.0)
        return [pa.array([net.names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]), np.clip(score, 0, 1), *echo]

    return per_text(docs, keep, column(docs, text_col), schema + ", lang_pred string, score double" + ", text string" * with_text, work)


def _parts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of some texts; a single long text comes in parts that overlap like its windows."""
    limit = _STEP * 8192
    if len(sizes) > 1 or sizes[0] <= limit:
        yield windows(data, starts, sizes)
        return
    for at in range(0, int(sizes[0]) - (WINDOW - _STEP), limit):
        some, owner = windows(data, starts + at, np.minimum(sizes - at, limit + WINDOW - _STEP))
        yield some, owner
