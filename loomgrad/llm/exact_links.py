"""Exact components of similar sets: candidates form clusters, and each cluster is linked in tasks of bounded size.

Candidate links are only used for the clusters that they connect. Every pair within a cluster counts, so a pair
that the candidates miss is still found if others lead from one to the other. A task yields a forest of the
links that hold, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrad.llm.common import broadcast_if_small
from loomgrad.llm.components import connected_components, contracted
from loomgrad.session import cut_lineage, materialise

#: Sets, and members of sets, in a block; a larger cluster is a grid of blocks, each compared with each.
BLOCK_SETS = 1024
BLOCK_MEMBERS = 500_000


def similar_forest(sets: list[np.ndarray], share: tuple[int, int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that the pairs with a Jaccard similarity of ``share`` or more connect.

    ``sets`` are arrays of distinct members; with ``side`` only pairs of different sides count. A search from
    each set: the members of one set lead to the sets that hold them, counted all at once, and what it reaches
    isn't looked at again. Empty sets are linked with nothing.
    """
    p, q = share
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if n else np.empty(0, dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[order]
    begins = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.empty(0, dtype=np.int64)
    held = np.diff(np.append(begins, len(flat)))
    member = np.empty(len(flat), dtype=np.int64)
    member[order] = np.repeat(np.arange(len(begins)), held)
    waiting, left, links = np.ones(n, dtype=bool), n, []
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root], left, front = False, left - 1, [root]
        while front and left:
            i = front.pop()
            mine = member[starts[i] : starts[i + 1]]
            mine = mine[held[mine] > 1]
            reps = held[mine]
            places = np.repeat(begins[mine] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
            common = np.bincount(holder[places], minlength=n)
            near = waiting & (common > 0) & (common * (p + q) >= p * (sizes[i] + sizes))
            if side is not None:
                near &= side != side[i]
            found = np.flatnonzero(near).tolist()
            waiting[found] = False
            left -= len(found)
            front += found
            links += [(i, j) for j in found]
    return links


def _link_cells(share: tuple[int, int]):
    """(u, v) of rows (root, cell, part, node, members) that come sorted by root and cell."""

    def links_of(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        side = np.array([r[0] for r in rows])
        for i, j in similar_forest([r[2] for r in rows], share, side if side.any() else None):
            if rows[i][1] != rows[j][1]:
                yield rows[i][1], rows[j][1]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for batch in batches:
            root, cell, part, node = (batch.column(i).to_pylist() for i in range(4))
            sets = batch.column(4)
            ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            for k in range(batch.num_rows):
                if (root[k], cell[k]) != now:
                    found += links_of(rows)
                    now, rows = (root[k], cell[k]), []
                rows.append((part[k], node[k], flat[ends[k] : ends[k + 1]].copy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])
                found = []
        found += links_of(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return link


def _in_cells(sets: DataFrame) -> DataFrame:
    """(root, cell, part, node, members): a cluster is one cell, a large one a grid of pairs of its blocks."""
    total = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_MEMBERS)).cast("int")
    large = cut_lineage(total.select(F.col("root").alias("large_root"), blocks.alias("blocks")).filter("blocks > 1"))
    dealt = sets.join(broadcast_if_small(large, 100_000), F.col("root") == F.col("large_root"), "left")
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    others = F.sequence(F.lit(0), n - 1)
    placed = F.transform(
        others, lambda other: F.struct((F.least(own, other).cast("long") * F.lit(2**31) + F.greatest(own, other)).alias("cell"), (own > other).cast("int").alias("part"))
    )
    return dealt.select("root", F.explode(placed).alias("at"), "node", "members").select("root", "at.cell", "at.part", "node", "members")


def exact_components(
    nodes: DataFrame, candidates: DataFrame, base: DataFrame, members: Callable, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """(node, root) of the nodes that links of at least the similarity ``share`` connect with another one.

    ``nodes``: (node, first_id); ``candidates``: (u, v) between nodes; ``base``: (doc_id, text). ``members``
    is a map over Arrow batches from (root, node, text) to (root, node, members), which leaves out a text
    that isn't the node's: the set of a node is made again from the text of one of its documents, once.
    """
    clusters = connected_components(contracted(candidates))
    wanted = cut_lineage(nodes.join(clusters, "node").select("root", "node", F.col("first_id").alias("doc_id")))
    texts = base.join(broadcast_if_small(wanted), "doc_id").select("root", "node", "text")
    found = texts.mapInArrow(members, "root long, node long, members array<long>")
    sets = materialise(found.groupBy("root", "node").agg(F.first("members").alias("members")))
    cells = _in_cells(sets).repartition("root", "cell").sortWithinPartitions("root", "cell", "part")
    return connected_components(cells.mapInArrow(_link_cells(share), "u long, v long"))
