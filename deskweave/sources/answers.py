"""A log of finished answers, kept in the shared store while a stage still runs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a bucket, about; a task holds one bucket's answers at a time.
BUCKET_KEYS = 20_000
#: Buckets at least, since as many tasks may call at once.
LEAST_BUCKETS = 64
_ROWS = pa.schema([("key", pa.string()), ("raw", pa.string())])
_SETTINGS = "_log.json"


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that may be a URI (file, hdfs, s3, gs) or a plain path."""
    if re.match(r"file:/+", folder):
        folder = re.sub(r"^file:/+", "/", folder)
    return pafs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class AnswerLog:
    """Answers by key under ``folder``, in ``buckets`` folders by a hash of the key.

    A task adds a file for every chunk of answers as soon as it has them, under a name of its own that
    appears only when the file is whole.  Whoever asks for the same keys later - the task's next
    attempt, the same run started again, or another run - reads the bucket before it calls.  A key
    may be logged twice by attempts that ran at the same time; the first file by name counts for all.
    """

    folder: str
    buckets: int

    @classmethod
    def open(cls, folder: str, expected: int) -> AnswerLog:
        """The log of a run; a new one gets buckets for ``expected`` keys, and one that exists keeps its own.

        ``folder`` names the run - scorer, model, prompt - since answers are found by key alone.
        """
        store, path = store_of(folder)
        settings = f"{path}/{_SETTINGS}"
        if store.get_file_info(settings).type == pafs.FileType.NotFound:
            store.create_dir(path)
            _appear(store, path, _SETTINGS, json.dumps({"buckets": max(LEAST_BUCKETS, -(-expected // BUCKET_KEYS))}).encode())
        with store.open_input_file(settings) as held:
            return cls(folder, json.loads(held.read())["buckets"])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _folder(self, bucket: int) -> tuple[pafs.FileSystem, str]:
        store, path = store_of(self.folder)
        return store, f"{path}/bucket={bucket}"

    def read(self, bucket: int) -> dict[str, str]:
        """The answers of one bucket; a file that cannot be read is passed over, and its keys are asked again."""
        store, path = self._folder(bucket)
        known: dict[str, str] = {}
        for found in sorted(store.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda x: x.path):
            if not found.path.endswith(".parquet") or found.base_name.startswith("_"):
                continue
            try:
                table = pq.read_table(found.path, filesystem=store, schema=_ROWS)
            except (OSError, pa.ArrowException):
                continue
            for key, raw in zip(table.column("key").to_pylist(), table.column("raw").to_pylist(), strict=True):
                known.setdefault(key, raw)
        return known

    def append(self, bucket: int, keys: Iterable[str], answers: Iterable[str]) -> None:
        """Keep answers; they are there once this returns."""
        table = pa.table([pa.array(keys, pa.string()), pa.array(answers, pa.string())], schema=_ROWS)
        if table.num_rows:
            store, path = self._folder(bucket)
            store.create_dir(path)
            out = pa.BufferOutputStream()
            pq.write_table(table, out)
            _appear(store, path, f"{uuid.uuid4().hex}.parquet", out.getvalue())

    def answers(self, spark: SparkSession) -> DataFrame:
        """(key, raw) of everything logged, once for each key."""
        schema = "key string, raw string, bucket int"
        store, path = store_of(self.folder)
        if not any(x.type == pafs.FileType.Directory for x in store.get_file_info(pafs.FileSelector(path))):
            return spark.createDataFrame([], schema).select("key", "raw")
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self.folder)
        return rows.withColumn("file", F.input_file_name()).groupBy("key").agg(F.min_by("raw", "file").alias("raw"))


def _appear(store: pafs.FileSystem, folder: str, name: str, content: bytes) -> None:
    """A file that is there whole or not at all; of two writers of one name, the later one's stays."""
    draft = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, f"{folder}/{name}")
