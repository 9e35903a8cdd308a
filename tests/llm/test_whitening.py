"""Whitening against plain whole-number moments and numpy."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrad.llm import whitening


def plain(rows: list[tuple]) -> dict:
    """id -> (n, deviation, whitened of each component, explained) with Python numbers and a full decomposition."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * x[j] - s[j] for j in range(d)] for x in fit], dtype=object)
    v = (centred.T.dot(centred) / n**3).astype(float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in good:
        c = [n * x[j] - s[j] for j in range(d)]
        w = np.array(c, dtype=float) / n @ q / np.sqrt(e)
        out.setdefault(i, (n, sum(y * y for y in c), w[:4], e[:4] / np.trace(v)))
    return out


def test_query_equals_plain_moments(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = whitening.op11_bit_sliced_whitening(spark, sf_dir).collect()
    assert len(got) == 4 * len(want) and {r["component"] for r in got} == {1, 2, 3, 4}
    signs = defaultdict(set)
    for r in got:
        n, deviation, w, explained = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        k = r["component"] - 1
        assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-9 and abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(w[k]) > 1e-6:
            signs[k].add(np.sign(r["whitened"]) == np.sign(w[k]))
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("seed,top", [(1, 5), (2, 2**20), (3, 2**40), (4, 2**62)])
def test_scatter_is_exact(seed, top):
    rng = np.random.default_rng(seed)
    x = rng.integers(-top, top, size=(int(rng.integers(1, 200)), 5))
    sums, products = whitening.scatter(x)
    y = x.astype(object)
    assert sums.tolist() == y.sum(axis=0).tolist() and products.tolist() == np.triu(y.T.dot(y)).tolist()
    numbers = np.array([0, 1, -1, 2**100, -(2**100) + 7, 2**158], dtype=object)
    assert whitening._from_limbs(whitening._to_limbs(numbers)).tolist() == numbers.tolist()


def test_edges(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, [None, 1.0, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (None, good[0][1])]
    rows = [(i, v, 1.0, "x") for i, v in good + good[:5] + odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, n string")
    got = whitening.whiten(table.repartition(7)).collect()
    want = plain(good)
    assert len(got) == 3 * 46 and {r["component"] for r in got} == {1, 2, 3}
    for r in got:
        if r["vec_id"] is not None:
            assert r["n"] == 40 and r["deviation"] == want[r["vec_id"]][1]
            assert abs(abs(r["whitened"]) - abs(want[r["vec_id"]][2][r["component"] - 1])) < 1e-9
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id > 99")).count() == 1  # (105, [1.0]): one value, no variance
    one = whitening.whiten(table.filter("vec_id = 30")).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    flat = spark.createDataFrame([(i, [float(i), 2.0, float(2 * i)]) for i in range(10)], "vec_id long, embedding array<double>")
    assert [r["whitened"] is None for r in whitening.whiten(flat).filter("vec_id = 1").orderBy("component").collect()] == [False, True, True]
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None and math.isfinite(r["whitened"] or 0) for r in whitening.whiten(huge).collect())


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    few, many = ({(r["vec_id"], r["component"]): r for r in whitening.whiten(table.repartition(k, F.col("vec_id"))).collect()} for k in (1, 90))
    assert all(r["deviation"] == many[key]["deviation"] and abs(r["whitened"] - many[key]["whitened"]) < 1e-9 for key, r in few.items())
