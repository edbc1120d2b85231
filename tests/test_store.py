"""The keyed store: appends that meet, compaction, and a join that leaves it where it lies."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from deskweave.sources import store as stores
from deskweave.sources.store import KeyedStore

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), "k", SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(store):
    rows = [tuple(r) for r in store.rows().collect()]
    assert len({k for k, _ in rows}) == len(rows)
    return dict(rows)


def test_runs_at_once_leave_one_row_for_each_key(spark, store, tmp_path):
    assert held(store) == {}
    # Two runs looked before either had stored anything, so both store b.
    other = KeyedStore(spark, store.folder, "k", SCHEMA)
    state = store._state()
    store.append(frame(spark, [("a", 1), ("b", 2), (None, 9)]))
    object.__setattr__(other, "_state", lambda: state)
    other.append(frame(spark, [("b", 3), ("c", 4), ("c", 4)]))
    once = held(store)
    assert set(once) == {"a", "b", "c"} and once["b"] in (2, 3)
    assert held(store) == once  # the same one each time
    store.compact()
    assert held(store) == once
    store.append(frame(spark, [("a", 7), ("d", 5)]))
    assert held(store) == once | {"d": 5}


def test_compactions_at_once_lose_nothing(spark, store):
    store.append(frame(spark, [("a", 1)]))
    old = store._state()
    store.append(frame(spark, [("b", 2)]))
    late = KeyedStore(spark, store.folder, "k", SCHEMA)
    object.__setattr__(late, "_state", lambda: old)  # it does not see b
    store.compact()
    late.compact()
    assert held(KeyedStore(spark, store.folder, "k", SCHEMA)) == {"a": 1, "b": 2}
    store.append(frame(spark, [("c", 3)]))
    store.compact()
    store.clean()
    assert held(KeyedStore(spark, store.folder, "k", SCHEMA)) == {"a": 1, "b": 2, "c": 3}


def test_a_half_written_part_or_base_is_not_seen(spark, store, tmp_path):
    store.append(frame(spark, [("a", 1)]))
    folder = tmp_path / "store"
    (folder / "part-half").mkdir()
    (folder / "part-half" / "x.parquet").write_bytes(b"PAR1")
    (folder / "base-half").mkdir()
    (folder / "_draft").write_bytes(b"{")
    assert held(store) == {"a": 1}


def test_the_join_moves_only_the_requests(spark, store):
    store.append(frame(spark, [(f"k{i}", i) for i in range(500)]))
    store.compact()
    asked = spark.createDataFrame([(i, f"k{i % 700}") for i in range(1400)] + [(5000, None)], "id long, k string")

    def exchanges(found):
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.lookup(asked)
        assert exchanges(found) == 1
        assert {(r.id, r.v) for r in found.collect()} == {(i, i % 700 if i % 700 < 500 else None) for i in range(1400)} | {(5000, None)}
        store.append(frame(spark, [("k600", 600), ("k3", -1)]))
        found = store.lookup(asked)
        assert {(r.id, r.v) for r in found.collect()} == {(i, i % 700 if i % 700 < 500 or i % 700 == 600 else None) for i in range(1400)} | {(5000, None)}
        scan = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Bucketed: true" in line]
        assert scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_parts_are_compacted_by_themselves(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "MOST_PARTS", 2)
    for i in range(5):
        store.append(frame(spark, [(f"k{i}", i)]))
    state, parts = store._state()
    assert state["base"] is not None and len(parts) <= 2 and held(store) == {f"k{i}": i for i in range(5)}
