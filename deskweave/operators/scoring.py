"""Calling external scorers from partitions, and the caches around them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions.replies import verdict_key
from ..functions.text import tokens
from ..sources.answers import AnswerLog

Scorer = Callable[[pd.DataFrame], pd.Series]

#: Rows of a task that wait for another attempt at most, before it waits for them.
WAITING_ROWS = 4_096


def score_batch(requests: DataFrame, key: str, scorer_factory: Callable[[], Scorer], *, attempts: int = 3,
                backoff_seconds: float = 1.0, parallelism: int | None = None, batch_size: int = 64,
                log: AnswerLog | None = None, derive: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, raw, error): one answer per distinct request.

    ``scorer_factory`` runs once per task and returns a function from a batch of
    requests to raw answers (a row may be null); it gets at most ``batch_size`` requests at a time.  Rows
    without an answer are retried with linear back-off, while others are sent, and together; those that have one are not sent again.  If a call
    raises, each of its rows is sent alone, so one bad row costs no other its answer.
    Equal requests are sent once; ``parallelism`` bounds the concurrent clients.  ``derive``: columns that
    are made of the others where a request is sent, so that they need not be moved there.

    With a ``log``, requests are dealt out by its buckets, answers that it holds are not asked for, and
    new ones are logged ``batch_size`` at a time as they come: a task that is lost after some of its calls
    repeats only the others, and so does a run that is started again.  Requests that got no answer are
    not logged.  Keys of all types are logged as text; a null key is asked each time.
    """
    distinct = requests.dropDuplicates([key])
    key_type = requests.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, raw string, error string"
    if log is None:
        if parallelism:
            distinct = distinct.repartition(parallelism, key)
        distinct = distinct.withColumns(dict(derive or {}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sender = _Sender(scorer_factory(), key, attempts, backoff_seconds, batch_size)
            for batch in batches:
                for start in range(0, len(batch), batch_size):
                    yield from (answers for _, answers in sender.send(batch.iloc[start:start + batch_size]))
            yield from (answers for _, answers in sender.finish())

        return distinct.mapInPandas(run, schema)

    dealt = distinct.withColumns({_BUCKET: log.bucket(F.col(key)), _LOGGED: F.col(key).cast("string")})
    dealt = dealt.repartition(min(parallelism or log.buckets, log.buckets), _BUCKET).sortWithinPartitions(_BUCKET)
    dealt = dealt.withColumns(dict(derive or {}))

    def run_logged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender, bucket, known = None, None, {}

        def logged(sent: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            for rows, scored in sent:
                for own, part in rows.groupby(_BUCKET, sort=True):
                    raw = scored["raw"][part.index]
                    keep = raw.notna() & part[_LOGGED].notna()
                    log.append(int(own), part[_LOGGED][keep], raw[keep])
                yield scored

        for batch in batches:
            for own, part in batch.groupby(_BUCKET, sort=True):
                if own != bucket:
                    bucket, known = own, log.read(int(own))
                found = part[_LOGGED].map(known)
                held = found.notna()
                if held.any():
                    yield pd.DataFrame({key: part[key][held], "raw": found[held], "error": None})
                asked = part[~held]
                sender = sender or (None if asked.empty else _Sender(scorer_factory(), key, attempts, backoff_seconds, batch_size, (_BUCKET, _LOGGED)))
                for start in range(0, len(asked), batch_size):
                    yield from logged(sender.send(asked.iloc[start:start + batch_size]))
        if sender:
            yield from logged(sender.finish())

    return dealt.mapInPandas(run_logged, schema)


_BUCKET, _LOGGED = "_answer_bucket", "_answer_key"


class _Sender:
    """Sends batches; rows without an answer wait for their next attempt while other batches are sent, and are sent again together.

    A back-off for each batch would make a task wait as often as it has batches with such a row.
    """

    def __init__(self, scorer: Scorer, key: str, attempts: int, backoff: float, batch_size: int, hidden: Sequence[str] = ()) -> None:
        self.scorer, self.key, self.attempts, self.backoff, self.batch_size, self.hidden = scorer, key, attempts, backoff, batch_size, list(hidden)
        self.waiting: list[list[tuple[float, pd.DataFrame]]] = [[] for _ in range(attempts)]  # by attempts made: when they are due, and rows

    def send(self, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """(requests, answers) of rows that are through: those of the batch, and others when very many wait."""
        yield self._sent(batch, 1)
        if sum(len(rows) for queue in self.waiting for _, rows in queue) >= WAITING_ROWS:
            yield from self.finish()

    def finish(self) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """(requests, answers) of all that wait."""
        for made, queue in enumerate(self.waiting):
            while queue:
                some = [queue.pop(0)]
                while queue and sum(len(rows) for _, rows in some) + len(queue[0][1]) <= self.batch_size:
                    some.append(queue.pop(0))
                time.sleep(max(0.0, some[-1][0] - time.monotonic()))
                yield self._sent(pd.concat([rows for _, rows in some], ignore_index=True), made + 1)

    def _sent(self, batch: pd.DataFrame, made: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        raw = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        error = raw.copy()
        _call(batch.drop(columns=self.hidden), self.scorer, raw, error)
        lost = raw.isna() & (made < self.attempts)
        if lost.any():
            self.waiting[made].append((time.monotonic() + self.backoff * made, batch[lost]))
        through = ~lost
        return batch[through], pd.DataFrame({self.key: batch[self.key], "raw": raw, "error": error})[through]


def _call(todo: pd.DataFrame, scorer: Scorer, raw: pd.Series, error: pd.Series) -> None:
    """Answers of ``todo`` into ``raw``; if the call raises, each row is sent alone."""
    try:
        answers = scorer(todo).reindex(todo.index)
    except Exception as failure:  # any client error is retried, then reported for its row
        if len(todo) == 1:
            error.loc[todo.index] = str(failure)
            return
        for place in range(len(todo)):
            _call(todo.iloc[place:place + 1], scorer, raw, error)
        return
    raw.loc[todo.index] = answers
    error.loc[todo.index] = None


def misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests without a stored answer."""
    return requests.join(cache.select(key), key, "left_anti")


def lookup(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with their stored answer, null where there is none.

    The cache has one row per key; a request key shared by very many rows is
    split by the adaptive skew join, since only the request side is large.
    """
    return requests.join(cache, key, "left")


def stored_verdicts(requests: DataFrame, cache: DataFrame, text: str, procedure: str) -> DataFrame:
    """Attach (resolves_problem, verdict_confidence, verdict_reason) from the verdict cache.

    An empty text or procedure is a certain 'no' without any lookup; a request
    that is not stored keeps nulls and ``verdict_known`` false.
    """
    blank = (F.coalesce(F.col(text), F.lit("")) == "") | (F.coalesce(F.col(procedure), F.lit("")) == "")
    keyed = requests.withColumn("verdict_key", verdict_key(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(procedure), F.lit(""))))
    stored = cache.select("verdict_key", F.col("resolves_problem").alias("_r"), F.col("confidence").alias("_c"), F.col("reason").alias("_w"))
    joined = lookup(keyed, stored, "verdict_key")
    return joined.select(
        *requests.columns, "verdict_key",
        F.when(blank, F.lit(False)).otherwise(F.col("_r")).alias("resolves_problem"),
        F.when(blank, F.lit(1.0)).otherwise(F.col("_c")).alias("verdict_confidence"),
        F.when(blank, F.lit(d.EMPTY_VERDICT_REASON)).otherwise(F.col("_w")).alias("verdict_reason"),
        (blank | F.col("_r").isNotNull()).alias("verdict_known"))


def new_entries(scored: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Answers to append to the cache: not there yet and marked cacheable."""
    return scored.filter("cacheable").drop("cacheable").join(cache.select(key), key, "left_anti")


def cache_valid(cached: DataFrame, expected: DataFrame, model: str | Column) -> DataFrame:
    """One row: may ``cached`` stand in for scoring ``expected`` with ``model``?

    Needs the same number of rows and the requested model on every row.
    """
    wanted = model if isinstance(model, Column) else F.lit(model)
    stored = cached.agg(
        F.count(F.lit(1)).alias("cached_rows"),
        F.count_if(F.col("judge_model") == wanted).alias("model_rows"))
    rows = expected.agg(F.count(F.lit(1))).scalar()
    return stored.select(
        "cached_rows", rows.alias("expected_rows"),
        ((F.col("cached_rows") == rows) & (F.col("cached_rows") > 0) & (F.col("model_rows") == F.col("cached_rows"))).alias("valid"))


def embed(texts: DataFrame, id_col: str, text_col: str, encoder: Callable[[Sequence[str]], object],
          batch_size: int = 128) -> DataFrame:
    """(id, embedding): ``encoder`` maps a list of texts to a matrix; blank text gives no row."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start:start + batch_size]
                matrix = encoder(part["text"].tolist())
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": list(matrix)})

    cleaned = texts.select(id_col, F.col(text_col).alias("text")).filter(F.col("text") != "")
    return cleaned.mapInPandas(run, f"{id_col} {id_type}, embedding array<double>")


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): signed feature hashing of lower-case words, unit length; stands in for a learned encoder.

    A word's md5 names its place and sign.  Counts are added up per id and place before they are put into
    an array, in column expressions only.  A text without a word gives no row; ids are unique.
    """
    hashed = texts.select(id_col, F.explode(tokens(F.col(text_col))).alias("word")).withColumn("h", F.md5("word"))
    place = F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % dim
    sign = F.when(F.substring("h", 5, 1) < "8", F.lit(1)).otherwise(F.lit(-1))
    counts = hashed.groupBy(id_col, place.alias("place")).agg(F.sum(sign).cast("double").alias("w"))
    rows = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("held"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda p: F.coalesce(F.try_divide(F.try_element_at("held", p), F.col("norm")), F.lit(0.0)))
    return rows.select(id_col, filled.alias("embedding"))
