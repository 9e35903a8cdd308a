"""Hard negatives against plain scans of all rows, and the tree's ranges."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loomgrad.llm import hard_negatives as hn


def plain(rows: list[tuple]) -> set[tuple]:
    """(anchor, positive, rank, negative, scores) by scanning all rows for each anchor."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            good[i] = ([math.floor(256 * float(c)) for c in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = set()
    for a, (x, label) in good.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, of) for i, (y, of) in good.items() if i != a)
        for score, i, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(s, j) for s, j, of in scored if of != label and 50 * -score <= 100 * -s <= 95 * -score]
            out |= {(a, i, rank, j, -score, -s) for rank, (s, j) in enumerate(fits[:3], 1)}
    return out


def found(df) -> list[tuple]:
    return [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()]


def test_query_equals_plain_scan(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found(hn.op13_hyperplane_tree_negatives(spark, sf_dir))
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def clumped(seed: int, n: int, d: int = 6) -> list[tuple]:
    """Vectors in clumps, whose labels cross them, and copies; small whole steps make many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 0.2
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=d) * 0.01).round(2).tolist(), int(rng.integers(4))) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(n // 3)]


@pytest.mark.parametrize("sample,leaf,ways", [(8192, 4096, 16), (60, 40, 4), (5, 16, 3)])
def test_clumps_equal_plain_scan(spark, monkeypatch, sample, leaf, ways):
    monkeypatch.setattr(hn, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(hn, "LEAF_ROWS", leaf)
    monkeypatch.setattr(hn, "WAYS", ways)
    monkeypatch.setattr(hn, "SCORES_AT_ONCE", 1000)
    rows = clumped(2, 900)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = found(hn.hard_negatives(table))
    assert len(got) == len(set(got)) and set(got) == plain(rows) and got


def test_ranges_rule_out_siblings_but_no_row_that_fits(spark, monkeypatch):
    monkeypatch.setattr(hn, "WAYS", 8)
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in clumped(3, 1200)], dtype=np.int64)
    tree = hn.plant(x[:400], 2)
    tree = hn.measure(tree, spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(3))
    leaf, kept, every = tree.leaves(x), 0, 0
    for a in x[::60]:
        scores = x @ a
        for low, high in ((int(scores.max()) * 9 // 10, int(scores.max())), (int(np.median(scores)), int(np.median(scores)) + 50)):
            reached = set(tree.reached(a, low, high))
            assert set(leaf[(scores >= low) & (scores <= high)].tolist()) <= reached
            kept, every = kept + len(reached), every + len(set(leaf.tolist()))
    assert kept < 0.6 * every


def test_inner_products_are_exact():
    rng = np.random.default_rng(4)
    for top in (100, 2**28, 2**33):
        a, b = (rng.integers(-top, top, size=(5, 7)) for _ in range(2))
        want = np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1)
        assert hn.inner_products(a, b).tolist() == want.tolist()


def test_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(3))) for i in range(0, 400, 2)]
    odd = [(None, [1.0, 0.0, 0.0], 1), (50, None, 1), (451, [1.0, 0.0, 0.0], None), (453, [None, 1.0, 1.0], 1), (455, [1.0, float("nan"), 0.0], 2), (457, [], 1), (459, [1.0], 1)]
    rows = [r for r in rows if r[0] != 50]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:40] + odd], "vec_id long, embedding array<double>, label int, id string, rank int")
    got = found(hn.hard_negatives(table))
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert hn.hard_negatives(table.limit(0)).count() == 0 and hn.hard_negatives(table.filter("vec_id > 450")).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1), (100, [0.0], 1), (150, [-1e300], 2)], "vec_id long, embedding array<double>, label int")
    assert set(found(hn.hard_negatives(lone))) == set()
