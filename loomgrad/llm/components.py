"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrad.session import cut_lineage


def stars(links: np.ndarray) -> np.ndarray:
    """Links (u, v) as links of each node to the least one that it reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for u, v in links.tolist():
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([(x, r) for x in root if (r := find(x)) != x], dtype=np.int64).reshape(-1, 2)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer links (u, v) with the same components: those of a batch, with all of a node's close together, become stars.

    For links that come many times over, as when each of many cells links what it holds to its least node.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = stars(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.T.copy()], names=["u", "v"])

    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return near.repartition("u").sortWithinPartitions("u").mapInArrow(contract, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours over to the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    handed = edges.join(least.hint("merge"), F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link at most, to a node that has none: then all point to their root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by_node.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node it can reach.

    ``edges`` has long columns u and v; loops, repeats and either direction are allowed. Minima are
    partially aggregated and the rest are merge joins, so a hub of any degree spreads over tasks and
    rounds leave no broadcasts behind. Each round is checkpointed; there are O(log^2 n), and none once
    all components are stars. Links never reach the driver.
    """
    now = cut_lineage(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        now = cut_lineage(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
