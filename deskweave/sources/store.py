"""A keyed store of results: appended by many runs at once, compacted into buckets, joined without moving it."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import _appear, store_of

#: Rows of a bucket, about, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8
#: Appended parts beyond which ``append`` compacts the store.
MOST_PARTS = 32
_FILE = "_store_file"


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` with one row for each ``key`` under ``folder`` in the shared store.

    Each append is a part of its own, so that runs need no lock: a key that two runs store at the same time
    is in two parts, and the first one by name counts.  ``compact`` writes all rows into a new base, one
    sorted file for each bucket of the key, and then publishes a manifest that names the base and the parts
    it holds.  A reader takes the last manifest's base and all parts that it does not name; a base whose
    manifest came second, or never came, is as if it were not there.
    """

    spark: SparkSession
    folder: str
    key: str
    schema: T.StructType

    def _listed(self) -> tuple[list[str], list[str]]:
        """(manifests, finished parts) by name."""
        store, path = store_of(self.folder)
        found = [x for x in store.get_file_info(pafs.FileSelector(path, allow_not_found=True))]
        manifests = sorted(x.base_name for x in found if x.base_name.startswith("manifest-"))
        parts = sorted(x.base_name for x in found if x.base_name.startswith("part-")
                       and store.get_file_info(f"{x.path}/_SUCCESS").type == pafs.FileType.File)
        return manifests, parts

    def _state(self) -> tuple[dict, list[str]]:
        """The last manifest, or that of an empty base, and the parts that are not in its base."""
        manifests, parts = self._listed()
        state = {"number": 0, "base": None, "buckets": 0, "parts": []}
        if manifests:
            store, path = store_of(self.folder)
            with store.open_input_file(f"{path}/{manifests[-1]}") as held:
                state = json.loads(held.read())
        return state, [p for p in parts if p not in set(state["parts"])]

    def _base(self, state: dict) -> DataFrame:
        """The base as a bucketed table over its folder."""
        if state["base"] is None:
            return self.spark.createDataFrame([], self.schema)
        where = f"{self.folder}/{state['base']}"
        name = "deskweave_store_" + hashlib.md5(where.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                           f"INTO {state['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _appended(self, parts: list[str]) -> DataFrame:
        """Rows of parts, once for each key; a damaged file is passed over, and its keys are stored again."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(*[f"{self.folder}/{p}" for p in parts])
        kept = F.min_by(F.struct(*self.schema.names), _FILE)
        return rows.withColumn(_FILE, F.input_file_name()).groupBy(F.col(self.key).alias("_k")).agg(kept.alias("r")).select("r.*")

    def rows(self) -> DataFrame:
        """All rows, one for each key."""
        state, parts = self._state()
        base = self._base(state)
        return base.unionByName(self._appended(parts).join(base.select(self.key), self.key, "left_anti")) if parts else base

    def lookup(self, requests: DataFrame) -> DataFrame:
        """``requests`` with the stored columns, null where the key is not stored.

        The base is joined bucket by bucket as it lies; only the requests move, and what was appended since.
        Requests may repeat keys and have null ones, which match nothing.
        """
        state, parts = self._state()
        values = [n for n in self.schema.names if n != self.key]
        base = self._base(state).select(self.key, F.struct(*values).alias("_base"))
        found = requests.join(base.hint("merge") if state["base"] else base, self.key, "left")
        if parts:
            found = found.join(self._appended(parts).select(self.key, F.struct(*values).alias("_new")), self.key, "left")
        held = F.coalesce("_base", "_new") if parts else F.col("_base")
        return found.select(*requests.columns, *[held[n].alias(n) for n in values])

    def append(self, new: DataFrame) -> None:
        """Store the rows whose key is not stored yet, one for each; a null key is not stored."""
        state, parts = self._state()
        fresh = new.select(*self.schema.names).filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        for held in (self._base(state), self._appended(parts)):
            fresh = fresh.join(held.select(self.key), self.key, "left_anti")
        fresh.write.parquet(f"{self.folder}/part-{uuid.uuid4().hex}")
        if len(parts) >= MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        """Put base and parts into a new base, published at once by one small file.

        Parts stay until ``clean``: readers that began before still read them.
        """
        state, parts = self._state()
        rows = self.rows()
        n = rows.count()
        buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
        base, name = f"base-{uuid.uuid4().hex}", f"deskweave_made_{uuid.uuid4().hex}"
        (rows.repartition(buckets, self.key).write.format("parquet").bucketBy(buckets, self.key).sortBy(self.key)
         .option("path", f"{self.folder}/{base}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, since the table has a place of its own
        number = state["number"] + 1
        store, path = store_of(self.folder)
        _appear(store, path, f"manifest-{number:09d}-{uuid.uuid4().hex}", json.dumps(
            {"number": number, "base": base, "buckets": buckets, "parts": sorted({*state["parts"], *parts})}).encode())

    def clean(self) -> None:
        """Delete parts that are in the base, and bases and manifests that are not the last; for when nobody reads them any more."""
        state, waiting = self._state()
        manifests, parts = self._listed()
        store, path = store_of(self.folder)
        for x in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if x.base_name in manifests[:-1]:
                store.delete_file(x.path)
            elif x.base_name.startswith("base-") and x.base_name != state["base"] or x.base_name in set(parts) - set(waiting):
                store.delete_dir(x.path)
