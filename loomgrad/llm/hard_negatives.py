"""Hard-negative mining with a multiway hyperplane tree whose ranges rule out sibling subtrees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrad.llm.common import read_table
from loomgrad.llm.whitening import usable, vectors_of, whole_steps
from loomgrad.operators.merging import merged_states
from loomgrad.session import cut_lineage, materialise

#: Rows that the tree is fitted on, at most. Every row is indexed.
SAMPLE_ROWS = 8192
#: Split points of a node, and levels at most: 4,096 leaves. The tree and its ranges are some MB.
WAYS, LEVELS = 16, 3
#: Rows that a leaf should hold; a larger one is searched in blocks of so many.
LEAF_ROWS = 4096
#: Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 20
POSITIVES, NEGATIVES = 5, 3
#: A negative has a score of 50 to 95 hundredths of its positive's.
LOW_SHARE, HIGH_SHARE = (50, 100), (95, 100)
ANCHOR_EVERY, RELABELLED = 50, 7
#: What rounding may move a distance, as a share of the lengths involved.
_SLACK = 1e-6
_LEAST = np.iinfo(np.int64).min


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m) whole-number inner products, exact; those beyond a long become its end."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    top = a.shape[1] * max(-int(a.min()), int(a.max())) * max(-int(b.min()), int(b.max()))
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, (1 << 63) - 1).astype(np.int64)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    x, points = x.astype(np.float64), points.astype(np.float64)
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(squares, 0.0))


# --- the tree ---------------------------------------------------------------------------------


@dataclass
class Tree:
    """``points``: node -> its (WAYS, d) split points or fewer. A node is the path to it, as a number in base WAYS.

    ``low``, ``high``: node -> least and greatest distance of each split point to the rows of each sibling
    subtree; ``norms``: node -> the same of the lengths of the rows in each subtree.
    """

    levels: int
    points: dict[tuple[int, int], np.ndarray]
    low: dict[tuple[int, int], np.ndarray]
    high: dict[tuple[int, int], np.ndarray]
    norms: dict[tuple[int, int], np.ndarray]

    def paths(self, x: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows in it, the subtree that each goes to, distances to the split points) on the way to the leaves; last (None, ..., leaf, None)."""
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(self.levels):
            below = np.empty(len(x), dtype=np.int64)
            for node in np.unique(at).tolist():
                mine = np.flatnonzero(at == node)
                apart = _distances(x[mine], self.points[level, node])
                goes = apart.argmin(axis=1)
                below[mine] = node * WAYS + goes
                yield (level, node), mine, goes, apart
            at = below
        yield (self.levels, -1), np.arange(len(x)), at, np.empty((0, 0))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        for (level, _), _, goes, _ in self.paths(x):
            if level == self.levels:
                return goes
        return np.empty(0, dtype=np.int64)

    def reached(self, anchor: np.ndarray, low_score: int, high_score: int) -> list[int]:
        """The leaves that may hold a row whose score with the anchor is from ``low_score`` to ``high_score``.

        |a - x|^2 = |a|^2 + |x|^2 - 2 a.x: with the lengths in a subtree the window is an annulus about the
        anchor. By the triangle inequality a split point at distance D from the anchor, and lo to hi from the
        rows of a subtree, puts them at max(D - hi, lo - D) to D + hi; if that misses the annulus, the subtree goes.
        """
        a = anchor.astype(np.float64)[None, :]
        own, nodes = float((a * a).sum()), [0]
        for level in range(self.levels):
            below = []
            for node in nodes:
                if (level, node) not in self.low:
                    continue
                low, high, norms = self.low[level, node], self.high[level, node], self.norms[level, node]
                d = _distances(a, self.points[level, node])[0][:, None]
                slack = _SLACK * (1.0 + own**0.5 + norms[:, 1])
                nearest = np.maximum(d - high, low - d).max(axis=0) - slack
                farthest = (d + high).min(axis=0) + slack
                inner = np.sqrt(np.maximum(own + norms[:, 0] ** 2 - 2.0 * high_score, 0.0))
                outer = np.sqrt(np.maximum(own + norms[:, 1] ** 2 - 2.0 * low_score, 0.0))
                kept = (norms[:, 0] <= norms[:, 1]) & (nearest <= outer + slack) & (farthest >= inner - slack) & (own + norms[:, 1] ** 2 - 2.0 * low_score >= -slack * (1 + own))
                below += (node * WAYS + np.flatnonzero(kept)).tolist()
            nodes = below
        return nodes


def plant(sample: np.ndarray, levels: int) -> Tree:
    """Split points: of a few sampled rows of a node, each the farthest from those before; equal rows count once."""
    points: dict[tuple[int, int], np.ndarray] = {}
    rows = {0: sample}
    for level in range(levels):
        below = {}
        for node, mine in rows.items():
            some = np.unique(mine[: 4 * WAYS], axis=0)
            if not len(some):
                some = np.zeros((1, sample.shape[1]), dtype=np.int64)
            chosen, apart = [0], _distances(some, some[:1])[:, 0]
            while len(chosen) < min(WAYS, len(some)):
                chosen.append(int(apart.argmax()))
                apart = np.minimum(apart, _distances(some, some[chosen[-1:]])[:, 0])
            points[level, node] = some[chosen]
            goes = _distances(mine, some[chosen]).argmin(axis=1)
            below |= {node * WAYS + k: mine[goes == k] for k in range(len(chosen))}
        rows = below
    return Tree(levels, points, {}, {}, {})


def measure(tree: Tree, indexed: DataFrame) -> Tree:
    """The tree with the ranges of all rows ``x``: each task keeps the least and greatest of its own, merged in executors."""
    order = sorted(tree.points)
    at, width = {}, 0
    for key in order:
        m = len(tree.points[key])
        at[key] = (width, m)
        width += (m + 1) * m  # distances of each split point to each subtree, and lengths

    def work(batches: Iterator[pa.RecordBatch]) -> bytes:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column(0), tree.points[0, 0].shape[1])
            lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            for key, mine, goes, apart in tree.paths(x):
                if key[0] == tree.levels:
                    continue
                start, m = at[key]
                both = np.column_stack([apart, lengths[mine]])
                for k in np.unique(goes).tolist():
                    found = both[goes == k]
                    where = start + k * (m + 1) + np.arange(m + 1)
                    low[where] = np.minimum(low[where], found.min(axis=0))
                    high[where] = np.maximum(high[where], found.max(axis=0))
        return np.concatenate([low, -high]).tobytes()

    def least(a: bytes, b: bytes) -> bytes:
        return np.minimum(np.frombuffer(a), np.frombuffer(b)).tobytes()

    found = np.full(2 * width, np.inf)
    for state in merged_states(indexed.select("x"), work, least):
        found = np.minimum(found, np.frombuffer(state))
    for key, (start, m) in at.items():
        low, high = (part[start : start + (m + 1) * m].reshape(m, m + 1) for part in (found[:width], -found[width:]))
        tree.low[key], tree.high[key], tree.norms[key] = low[:, :m].T, high[:, :m].T, np.column_stack([low[:, m], high[:, m]])
    return tree


# --- bounds from the sample -------------------------------------------------------------------


def top_scores(scores: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest good score of each line, or the least long where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _LEAST)
    return -np.partition(np.where(good, -scores, (1 << 63) - 1), k - 1, axis=1)[:, k - 1]


def window(positive: int) -> tuple[int, int]:
    """The least and greatest score of a negative for the score of a positive."""
    (a, b), (c, d) = LOW_SHARE, HIGH_SHARE
    return -(-a * positive // b), c * positive // d


# --- search -----------------------------------------------------------------------------------
#
# Rows and anchors of a leaf meet in one task, rows first. The entry of an anchor has its windows: from the
# score that the sample already reaches to the greatest allowed. A search for positives has one window.


def _route(tree: Tree, blocks: dict[int, int]):
    """(leaf, block, kind 1, id, label, x, lows, highs): an anchor's entry for each block of each leaf that its windows reach."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lows, highs = (row.column(i)[0].as_py() for i in (3, 4))
                open_windows = [(a, b) for a, b in zip(lows, highs, strict=True) if a <= b]
                if not open_windows:
                    continue
                anchor = row.column(2).flatten().to_numpy()
                leaves = tree.reached(anchor, min(a for a, _ in open_windows), max(b for _, b in open_windows))
                cells = [(leaf, block) for leaf in leaves for block in range(blocks.get(leaf, 0))]
                if not cells:
                    continue
                n, same = len(cells), lambda i, n=len(cells), row=row: pa.concat_arrays([row.column(i)] * n)
                columns = [pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int32()), pa.array([1] * n, pa.int32())]
                names = ["leaf", "block", "kind", "id", "label", "x", "lows", "highs"]
                yield pa.RecordBatch.from_arrays([*columns, *(same(i) for i in range(5))], names=names)

    return route


_ENTRY = "leaf long, block int, kind int, id long, label int, x array<long>, lows array<long>, highs array<long>"
_FOUND = "anchor long, k int, id long, score long"


def _search(same_label: bool, most: int, d: int):
    """(anchor, window, id, score) of the best ``most`` rows of a cell in each window, of the anchor's label or of others.

    Rows come sorted by cell, those of the leaf before the anchors. Exact: every row of the leaf is scored.
    """

    def best(rows: tuple, anchors: tuple, out: list[np.ndarray]) -> None:
        ids, labels, x = rows
        a_ids, a_labels, a, lows, highs = anchors
        step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for at in range(0, len(a_ids), step):
            mine = slice(at, at + step)
            scores = inner_products(a[mine], x)
            good = (a_labels[mine, None] == labels) == same_label
            good &= a_ids[mine, None] != ids
            low, high = lows[mine], highs[mine]
            least = np.where(low <= high, low, (1 << 63) - 1).min(axis=1)
            greatest = np.where(low <= high, high, _LEAST).max(axis=1)
            good &= (scores >= least[:, None]) & (scores <= greatest[:, None])
            line, column = np.nonzero(good)
            found = scores[line, column]
            for k in range(low.shape[1]):
                fits = (found >= low[line, k]) & (found <= high[line, k])
                of, score, row = line[fits], found[fits], ids[column[fits]]
                order = np.lexsort((row, -score, of))
                of, score, row = of[order], score[order], row[order]
                fresh = np.ones(len(of), dtype=bool)
                fresh[1:] = (of[1:] != of[:-1]) | (row[1:] != row[:-1]) | (score[1:] != score[:-1])
                of, score, row = of[fresh], score[fresh], row[fresh]
                first = np.searchsorted(of, of)
                few = np.arange(len(of)) - first < most
                out.append(np.column_stack([a_ids[mine][of[few]], np.full(int(few.sum()), k), row[few], score[few]]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block, kind, ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            edges = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            out: list[np.ndarray] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = vectors_of(batch.column(5).slice(a, b - a), d)
                if (leaf[a], block[a]) != now:
                    now, parts, rows = (leaf[a], block[a]), [], None
                if kind[a] == 0:
                    parts.append((ids[a:b], labels[a:b], x))
                elif parts:
                    if rows is None:
                        rows = tuple(np.concatenate([p[i] for p in parts]) for i in range(3))
                    lows, highs = (batch.column(i).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1) for i in (6, 7))
                    best(rows, (ids[a:b], labels[a:b], x, lows, highs), out)
            if out:
                table = np.concatenate(out)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(table.T, kinds, strict=True)], names=["anchor", "k", "id", "score"])

    return search


def _bound(sample: tuple[np.ndarray, np.ndarray, np.ndarray], d: int, positives: int, negatives: int, first: bool):
    """The windows of anchors (id, label, x[, positive scores]), with the scores that the sample reaches as lower ends.

    The sample is part of the table, so the k-th best of the whole is at least the k-th best of the sample.
    """
    s_ids, s_labels, s_x = sample

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                scores = inner_products(vectors_of(part.column(2), d), s_x)
                other = ids[:, None] != s_ids
                alike = labels[:, None] == s_labels
                if first:
                    lows = top_scores(scores, alike & other, positives)[:, None]
                    highs = np.full((len(ids), 1), (1 << 63) - 1)
                else:
                    wanted = [[*map(window, scores), *[(1, 0)] * (positives - len(scores))] for scores in part.column(3).to_pylist()]
                    lows, highs = (np.array([[w[i] for w in ws] for ws in wanted], dtype=np.int64).reshape(len(ids), positives) for i in (0, 1))
                    for k in range(positives):
                        good = ~alike & other & (scores <= highs[:, k, None])
                        lows[:, k] = np.maximum(lows[:, k], top_scores(scores, good, negatives))
                columns = [*(part.column(i) for i in range(3)), *(pa.array(v.tolist(), pa.list_(pa.int64())) for v in (lows, highs))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "lows", "highs"])

    return emit


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of all anchors.

    The tree is fitted on a bounded sample; every row is indexed in a leaf, and ranges cover all rows. For
    each anchor the sample gives lower bounds, the ranges rule out subtrees, and what is left is scored
    exactly, so no row that belongs to the result is missed. It is searched twice: for positives, and in
    the windows that these leave. Vectors without structure let no subtree be ruled out; then each anchor
    meets each leaf, in blocks.

    Rows without an id or a label, and those whose vector is null, empty, or holds a null or non-finite
    component, take no part, nor do those of another length than the sample's most frequent one (the longer
    if tied). Exact repeats count once; of anchors that share an id, that with the smallest label and vector
    is searched for. Other columns are ignored. No rows in, no rows out.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("v"))
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    moved = F.when(F.pmod("id", F.lit(RELABELLED)) == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    whole = base.select("id", moved.cast("int").alias("label"), whole_steps(F.col("v")).alias("x"))
    n = whole.count()
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1))
    some = whole.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_ROWS).collect()
    if not some:
        some = whole.limit(SAMPLE_ROWS).collect()
    if not some:
        return spark.createDataFrame([], schema)
    lengths = [len(r["x"]) for r in some]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    some = list({r["id"]: r for r in some if len(r["x"]) == d}.values())
    sample = (np.array([r["id"] for r in some]), np.array([r["label"] for r in some]), np.array([r["x"] for r in some], dtype=np.int64))
    levels = next((k for k in range(1, LEVELS) if WAYS**k * LEAF_ROWS >= n), LEVELS)
    tree = plant(sample[2], levels)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(vectors_of(batch.column(2), d)) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "id", "label", "x"])

    indexed = materialise(whole.filter(F.size("x") == d).mapInArrow(index, "leaf long, id long, label int, x array<long>"))
    tree = measure(tree, indexed)
    blocks = {r["leaf"]: -(-r["count"] // LEAF_ROWS) for r in indexed.groupBy("leaf").count().collect()}  # at most WAYS ** LEVELS
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "of_leaf long, blocks long"))
    none = F.array().cast("array<long>")
    block = F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int")  # repeated rows too go to different blocks
    rows = indexed.join(sizes, F.col("leaf") == F.col("of_leaf")).select(
        "leaf", block.alias("block"), F.lit(0).alias("kind"), "id", "label", "x", none.alias("lows"), none.alias("highs")
    )

    def searched(anchors: DataFrame, same_label: bool, most: int) -> DataFrame:
        """The best ``most`` of each anchor and window: (anchor, k, rank, id, score), stored."""
        entries = anchors.mapInArrow(_route(tree, blocks), _ENTRY).unionByName(rows)
        dealt = entries.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
        found = dealt.mapInArrow(_search(same_label, most, d), _FOUND)
        best = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id")
        return cut_lineage(found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most))

    bounded = "id long, label int, x array<long>, lows array<long>, highs array<long>"
    anchors = indexed.filter(F.pmod("id", F.lit(ANCHOR_EVERY)) == 0).groupBy("id").agg(F.min(F.struct("label", "x")).alias("row"))
    anchors = cut_lineage(anchors.select("id", "row.label", "row.x"))
    liked = searched(anchors.mapInArrow(_bound(sample, d, positives, negatives, True), bounded), True, positives)
    scores = liked.groupBy(F.col("anchor").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))
    with_scores = anchors.join(scores, F.col("id") == F.col("of")).select("id", "label", "x", F.col("found.score").alias("scores"))
    unlike = searched(with_scores.mapInArrow(_bound(sample, d, positives, negatives, False), bounded), False, negatives)
    mine = liked.select("anchor", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return unlike.join(mine, ["anchor", "k"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hyperplane_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))
