"""Quality scores from Naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.session import cut_lineage

from .texts import LOWER, SOLID, column, joined, mixed, packed, per_text, shingles, unpacked, word_hashes, words

#: Hashed n-gram indicators.
FEATURES = 1 << 18
#: Rows of a class, different ones, that the support vectors are fitted on.
FIT_ROWS = 3000
_LEVELS = (64, 16, 4)  # an n-gram is also marked as one of every so many words


def _shapes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A small number for each word: its case, length, digits, symbols, last characters, and whether it repeats the word before."""
    def count(low: int, high: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((data >= low) & (data <= high), dtype=np.int64)])
        return sums[end] - sums[begin]

    size = end - begin
    upper, lower, digits, other = count(65, 90), count(97, 122), count(48, 57), count(128, 255)
    symbols = size - upper - lower - digits - other
    first_upper = (data[begin] >= 65) & (data[begin] <= 90)
    case = np.select([upper + lower == 0, upper == 0, first_upper & (upper == 1), lower == 0], [0, 1, 2, 3], 4)
    kind = np.select([symbols == size, digits == size, digits > 0], [0, 1, 2], 3)
    last = np.isin(data[end - 1], np.frombuffer(b".,;:!?", np.uint8))
    tail = np.select([symbols == 0, (symbols == 1) & last, symbols == 1, symbols == 2], [0, 1, 2, 3], 4)
    again = np.zeros(len(begin), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    length = np.searchsorted([2, 4, 7, 11, 20], size, side="right")
    return (((case * 4 + kind) * 5 + tail) * 2 + again) * 6 + length


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every indicator: lower-cased words, and n-grams of one to three word shapes by how frequent they are."""
    data, starts = joined(texts)
    begin, end, owner = words(data, starts, SOLID)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = word_hashes(data, begin, end, LOWER)
    shape = mixed(_shapes(data, begin, end, hashes, owner).astype(np.uint64) + np.uint64(1))
    total = np.bincount(owner, minlength=len(texts))
    place = np.uint64(FEATURES - 1)
    found = [(owner.astype(np.uint64) << np.uint64(32)) | (hashes & place)]
    for size in (1, 2, 3):
        grams = shingles(shape, size)
        same = owner[: len(grams)] == owner[size - 1 :]
        key = (owner[: len(grams)][same].astype(np.uint64) << np.uint64(32)) | (grams[same] >> np.uint64(32))
        key, n = np.unique(key, return_counts=True)
        whose, gram = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        for level in (0, *_LEVELS):
            often = slice(None) if not level else n * level >= total[whose.astype(np.int64)]
            feature = mixed(gram[often] * np.uint64(128) + np.uint64(size * 64 + level % 64 + bool(level))) & place
            found.append((whose[often] << np.uint64(32)) | feature)
    key = np.unique(np.concatenate(found))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class QualityModel:
    """Weight of each indicator, bias, and the slope and offset that turn a margin into a probability."""

    weights: np.ndarray
    bias: float
    ratios: np.ndarray
    slope: float
    offset: float


def hinge_fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent over rows of scaled indicators, each of unit length, and a bias."""
    rng = np.random.default_rng(seed)
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    values = [_unit(ratios[r]) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = labels[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                move = (new - alpha[i]) * labels[i]
                weights[rows[i]] += move * values[i]
                bias += move
                alpha[i] = new
    return weights, bias


def _unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt(values @ values)
    return values / norm if norm else values


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, with each class's total weight alike."""
    target = (labels > 0).astype(float)
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        miss, curve = weight * (p - target), weight * p * (1 - p)
        g = np.array([miss @ margins + 1e-3 * (slope - 1), miss.sum()])
        h = np.array([[curve @ margins**2 + 1e-3, curve @ margins], [curve @ margins, curve.sum() + 1e-6]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(h, g)
        slope = min(max(slope, 0.1), 20.0)
    return float(slope), float(offset)


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, features): each row's indicators, packed as the gaps between them."""
    def work(texts: pa.Array) -> list:
        owner, feature = indicators(texts)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).tolist()
        return [pa.array([packed(np.diff(feature[a:b], prepend=0)) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]

    return per_text(docs, [column(docs, id_col)], column(docs, text_col), f"id {dict(docs.dtypes)[id_col]}, features binary", work)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_rows: int = FIT_ROWS, smoothing: float = 1.0) -> QualityModel | float:
    """Learn from the labelled rows of ``docs`` (label 1 or 0; others and null are no labels).

    Class log-count ratios come from indicator counts over all labelled rows, added up in the tasks first;
    the FEATURES sums of each class reach the driver.  The support vectors are fitted there on at most about
    ``fit_rows`` different rows of each class.  Without rows of both classes the result is a constant
    score: the share of label 1, or 0.5.
    """
    named = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    # A merge join at every size: the labels have no bound, and the work then grows evenly.
    rows = cut_lineage(_feature_rows(docs, id_col, text_col).hint("merge").join(named, "id").select("label", "features"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for label, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label][np.cumsum(unpacked(blob))] += 1
        for label in (0, 1):
            used = np.flatnonzero(sums[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), label, np.int32)), pa.array(used), pa.array(sums[label][used])], ["label", "feature", "n"])

    counts = np.full((2, FEATURES), smoothing)
    for r in rows.mapInArrow(partial, "label int, feature bigint, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["feature"]] += r["n"]
    rows = rows.withColumn("hash", F.xxhash64("features"))
    sizes = {r["label"]: (r["n"], r["d"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("d")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = F.when(F.col("label") == 1, fit_rows / sizes[1][1]).otherwise(fit_rows / sizes[0][1])
    drawn = rows.where(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["label", "hash"]).select("label", "features").collect()
    drawn = sorted((r["label"], bytes(r["features"])) for r in drawn)
    sample, target = [np.cumsum(unpacked(f)) for _, f in drawn], np.array([1 if label else -1 for label, _ in drawn])
    if len(set(target.tolist())) < 2:
        return float(sizes[1][0] / (sizes[0][0] + sizes[1][0]))
    weights, bias = hinge_fit(sample, target, ratios)
    margins = np.array([weights[r] @ _unit(ratios[r]) + bias for r in sample])
    return QualityModel(weights, bias, ratios, *_calibrated(margins, target))


def score(docs: DataFrame, model: QualityModel | float, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns and score, 0 to 1, of every row; a null or empty text has no indicator and gets what the bias says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the tables hold

    def work(texts: pa.Array) -> list:
        net = shared.value
        if not isinstance(net, QualityModel):
            return [np.full(len(texts), net)]
        owner, feature = indicators(texts)
        ratio = net.ratios[feature]
        length = np.sqrt(np.bincount(owner, ratio * ratio, minlength=len(texts)))
        margin = np.bincount(owner, ratio * net.weights[feature], minlength=len(texts)) / np.maximum(length, 1e-12) + net.bias
        return [1 / (1 + np.exp(-np.clip(net.slope * margin + net.offset, -30, 30)))]

    return per_text(docs, keep, column(docs, text_col), schema + ", score double", work)
