"""Links of near vectors where partitions are many and where vectors crowd into one cone."""

from __future__ import annotations

import numpy as np
import pytest

from deskweave.llm import vectors


def cone(rng, n, dim, cosine):
    """Unit vectors whose cosine with one another is about ``cosine`` (0: spread evenly)."""
    axis = np.zeros(dim)
    axis[0] = 1
    rest = rng.standard_normal((n, dim))
    rest[:, 0] = 0
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    return np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * rest


def beside(rng, unit, cosine):
    other = rng.standard_normal(unit.shape)
    other -= (other * unit).sum(axis=1, keepdims=True) * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)


def lost(spark, table, threshold=0.95):
    """(link ends that are missing, link ends there are); no row has a link too many."""
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    true = np.zeros(len(unit), np.int64)
    for at in range(0, len(unit), 2000):
        true[at : at + 2000] = (unit[at : at + 2000] @ unit.T >= threshold).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(frame).collect()}
    found = np.array([got[i] for i in range(len(table))])
    assert (found <= true).all()
    return int((true - found).sum()), int(true.sum())


@pytest.mark.parametrize("n", [500, 1800])
def test_many_partitions_lose_no_links(spark, n):
    rng = np.random.default_rng(n)
    heads = cone(rng, n // 2, 64, 0.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        missing, there = lost(spark, np.concatenate([heads, beside(rng, heads, 0.955)]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert there == n and missing <= 0.002 * there


def test_a_cone_loses_no_links(spark):
    rng = np.random.default_rng(8)
    heads = cone(rng, 4000, 64, 0.8)
    missing, there = lost(spark, np.concatenate([heads, beside(rng, heads, 0.955)]))
    assert there >= 8000 and missing <= 0.002 * there


def test_a_third_in_one_cone_and_many_alike(spark):
    rng = np.random.default_rng(12)
    heads = np.concatenate([cone(rng, 700, 32, 0.85), cone(rng, 1400, 32, 0.0)])
    alike = np.repeat(cone(rng, 1, 32, 0.0), 900, axis=0) + 0.01 * rng.standard_normal((900, 32))
    missing, there = lost(spark, np.concatenate([heads, beside(rng, heads, 0.957), alike]))
    assert missing <= 0.002 * there
