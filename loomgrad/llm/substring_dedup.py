"""Substring deduplication: prefix-partitioned suffix trees over words.

Suffixes are sampled: of each window, the one that begins at its least-hash prefix of six words. Equal
windows have it at equal distances, so no repeat is lost, and neighbouring windows share it: a run. The
prefix says in which subtree a run hangs. Subtrees that hold several different runs and fit into memory
are built in tasks, on the words themselves. Where a prefix has more runs than that, the prefixes of its
windows are lengthened, to twelve words and at last to the whole window, until every subtree fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import broadcast_if_small, id_and_text, read_table
from loomgrad.llm.wordhash import mix, pieces, run_hashes, sliding_argmin, word_hash_pairs, word_spans
from loomgrad.session import cut_lineage, materialise

WINDOW_WORDS = 20
PREFIX_WORDS = 6
#: Different runs (of up to 2 * window - prefix words) that make a subtree of one task.
SUBTREE_RUNS = 4096
#: Runs whose subtrees are built together.
CHUNK_RUNS = 8192
_NO_ID = -(2**63)
#: Marks of a level of prefixes, in the order in which they are applied; the next level follows.
_RUN, _FIRST_RUN, _COVERED, _KINDS = range(4)


def _runs_of(raw: np.ndarray, bounds: np.ndarray, window: int, prefix: int):
    """The windows of some texts as runs that hang below one prefix.

    The prefix of a window is the one with the least hash among those that start in it and fit into
    it (the leftmost of equal ones). It depends on the window's words alone, so equal windows have
    equal prefixes at equal distances, and neighbouring windows mostly share one: a run. Returns
    (prefix, path, text, first window, windows, first byte, end byte) arrays, one entry a run; path is a
    hash of the whole run, independent of that of the prefix.
    """
    starts, ends, doc = word_spans(raw, bounds)
    words, other = word_hash_pairs(raw, starts, ends)
    none = np.empty(0, dtype=np.int64)
    empty = (none.view(np.uint64), none.view(np.uint64), *[none] * 5)
    if len(words) < window:
        return empty
    inside = doc[: len(words) - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    prefixes = mix(run_hashes(words, prefix))
    anchor = sliding_argmin(prefixes, window - prefix + 1)[at]  # differs between texts, and between the repeats of a periodic text
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.concatenate([begins, [len(at)]]))
    # The path of a run: its windows' hashes, each mixed with its place, summed.
    place = (np.arange(len(at)) - np.repeat(begins, n)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    path = mix(np.add.reduceat(mix(mix(run_hashes(other, window))[at] + place), begins) + n.astype(np.uint64))
    owner = doc[at[begins]]
    text_start = np.searchsorted(doc, owner, side="left")
    first = at[begins]
    return prefixes[anchor[begins]], path, owner, first - text_start, n, starts[first], ends[first + n + window - 2]


def _place(th: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (th.astype(np.int64) << 32) | start


def _emit_runs(window: int, prefix: int):
    """(did, th, text) as runs (prefix, path, did, place, n)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy(zero_copy_only=False)
            th = batch.column(1).to_numpy(zero_copy_only=False)
            for row, _, raw, bounds in pieces(batch.column(2)):
                *keys, doc, start, n, _, _ = _runs_of(raw, bounds, window, prefix)
                columns = [*(k.view(np.int64) for k in keys), did[doc + row], _place(th[doc + row], start), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["prefix", "path", "did", "place", "n"])

    return emit


def _emit_runs_of_runs(window: int, prefix: int):
    """Runs (did, place, words) as shorter ones below longer prefixes, with their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for row, _, raw, bounds in pieces(batch.column(2)):
                *keys, run, start, n, first, end = _runs_of(raw, bounds, window, prefix)
                data = raw.tobytes()
                words = pa.array([data[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())
                columns = [*(k.view(np.int64) for k in keys), did[run + row], place[run + row] + start, n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), words], names=["prefix", "path", "did", "place", "n", "words"])

    return emit


# --- subtrees ---------------------------------------------------------------------------------


def _emit_leaves(window: int):
    """The contested runs of each text (did, th, text, runs), with their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy(zero_copy_only=False)
            th = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            for row, end, raw, bounds in pieces(batch.column(2)):
                starts, ends, doc = word_spans(raw, bounds)
                edges = lists.offsets.to_numpy()[row : end + 1]
                prefix, start, n, crowded = (lists.values.field(i).to_numpy(zero_copy_only=False)[edges[0] : edges[-1]] for i in range(4))
                owner = np.repeat(np.arange(end - row), np.diff(edges))
                at = np.searchsorted(doc, owner, side="left") + start
                data = raw.tobytes()
                words = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at + n + window - 2].tolist(), strict=True)]
                columns = [prefix, did[owner + row], _place(th[owner + row], start.astype(np.int64)), crowded]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.binary())], names=["prefix", "did", "place", "crowded", "words"])

    return emit


def suffix_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` on the path of each suffix of ``words`` (integers) that is so long.

    Nodes at depths 1, 2, 4 ... are the pairs of nodes at half the depth, so equal numbers mean equal
    words, not hashes. This is the suffix tree, cut at the depth, by prefix doubling.
    """
    node, at = np.unique(words, return_inverse=True)[1], 1
    while at < depth:
        step = min(at, depth - at)
        node = np.unique(node[: len(node) - step] * (int(node.max()) + 1) + node[step:], return_inverse=True)[1]
        at += step
    return node


def repeated_windows(texts: list[bytes], did: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows of some runs that also occur earlier among them: by did, then place.

    A node at the window depth with several leaves is a repeat; all its leaves but the first are it.
    """
    split = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for s in split for w in s], dtype=np.int64)
    lengths = np.array([len(s) for s in split])
    n = lengths - window + 1
    run = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    node = suffix_nodes(flat, window)[(np.cumsum(lengths) - lengths)[run] + offset]
    order = np.lexsort((place[run] + offset, did[run], node))
    again = order[1:][node[order[1:]] == node[order[:-1]]]
    again.sort()
    return run[again], offset[again]


def _grow_subtrees(window: int):
    """Rows (prefix, did, place, words) come sorted: the covered windows of complete groups, as spans."""

    def covered(rows: pa.Table) -> pa.RecordBatch:
        did, place = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        run, offset = repeated_windows(rows.column(3).to_pylist(), did, place, window)
        begins = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(run) else run
        n = np.diff(np.concatenate([begins, [len(run)]])).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(did[run[begins]]), pa.array(place[run[begins]] + offset[begins]), pa.array(n)], names=["did", "place", "n"]
        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            if waiting.num_rows >= CHUNK_RUNS:
                keys = waiting.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last group may go on in the next batch
                if cut:
                    yield covered(waiting.slice(0, cut))
                    waiting = waiting.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield covered(waiting)

    return grow


# --- marks ------------------------------------------------------------------------------------


def covered_windows(n_windows: int, kind: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which windows of a text occur earlier, from its marks, level by level.

    A run that isn't the first with its path is covered whole. A first run is uncovered, but for the
    windows that its subtree found to repeat, or that are looked at again with longer prefixes.
    """
    out = np.zeros(n_windows, dtype=bool)
    for marked in np.unique(kind).tolist():
        for s, k in zip(start[kind == marked].tolist(), n[kind == marked].tolist(), strict=True):
            out[s : s + k] = marked % _KINDS != _FIRST_RUN
    return out


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            list_at = marks.offsets.to_numpy()
            kind, start, n = (marks.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = batch.column(2)
            total, removed, spans, kept = [], [], [], []
            for i in range(len(texts)):
                words = texts[i].as_buffer().to_pybytes().split()
                lo, hi = int(list_at[i]), int(list_at[i + 1])
                total.append(len(words))
                gone = None
                if hi > lo:
                    at = np.flatnonzero(covered_windows(len(words) - window + 1, kind[lo:hi], start[lo:hi], n[lo:hi]))
                    if len(at):
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + window, -1)
                        gone = np.cumsum(steps[:-1]) > 0
                if gone is None:
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                else:
                    removed.append(int(gone.sum()))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                    kept.append(b" ".join(compress(words, ~gone)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "removed_spans", "kept_text"],
            )

    return remove


def _one_of_each(rows: DataFrame) -> DataFrame:
    """(did, th, text) of one of the rows (doc_id, did, th, text) that are equal.

    Repeated ids are looked for first, without the texts; only rows that share one are compared by text hash.
    """
    twice = F.count(F.lit(1)) > 1
    ids = cut_lineage(rows.groupBy("doc_id").agg(twice.alias("twice")).filter("twice").select(F.col("doc_id").alias("shared_id")))
    texts = rows.drop("doc_id")
    if not ids.limit(1).count():
        return texts
    sharing = rows.join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("shared_id")), "left_semi")
    again = cut_lineage(sharing.groupBy("did", "th").agg(twice.alias("twice")).filter("twice").select("did", "th"))
    if not again.limit(1).count():
        return texts
    listed = broadcast_if_small(again)
    alone = texts.join(listed, ["did", "th"], "left_anti")
    return alone.unionByName(materialise(texts.join(listed, ["did", "th"], "left_semi").dropDuplicates(["did", "th"])))


def _contested(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs whose prefix comes again, the first run of each path of those, firsts of prefixes with several paths).

    The last have ``crowded``: whether there are more paths than a subtree takes. All are stored.
    """
    shared = runs.groupBy("prefix").agg(F.count(F.lit(1)).alias("leaves")).filter("leaves > 1").select("prefix")
    repeated = materialise(runs.join(materialise(shared), "prefix"))  # both sides are plain shuffles, so skew is split
    columns = [c for c in ("did", "place", "n", "words") if c in runs.columns]
    firsts = materialise(repeated.groupBy("prefix", "path").agg(F.min(F.struct(*columns)).alias("at")).select("prefix", "at.*"))
    paths = firsts.groupBy("prefix").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1")
    many = materialise(paths.select("prefix", (F.col("paths") > SUBTREE_RUNS).alias("crowded")))
    return repeated, firsts, materialise(firsts.join(many, "prefix"))


def _marks(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """(did, th, kind, start, n): what is known of the windows of each text, level by level of ever longer prefixes.

    The first level reads the texts twice, the second time for the words of contested runs. Those below crowded
    prefixes are the texts of the next level, so no text is read or moved again.
    """
    th = F.shiftright("place", 32).cast("int").alias("th")
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start")
    runs = texts.mapInArrow(_emit_runs(window, prefix), "prefix long, path long, did long, place long, n int")
    repeated, firsts, contested = _contested(runs)
    by_text = (
        contested.select("did", th, "prefix", start, "n", "crowded")
        .groupBy("did", "th")
        .agg(F.collect_list(F.struct("prefix", "start", "n", "crowded")).alias("runs"))
    )
    with_words = texts.join(by_text, ["did", "th"]).select("did", "th", "text", "runs")
    leaves = materialise(with_words.mapInArrow(_emit_leaves(window), "prefix long, did long, place long, crowded boolean, words binary"))
    found, level = [], 0
    while True:
        last = prefix == window  # equal prefixes are equal windows, so several paths are colliding hashes
        subtrees = (leaves if last else leaves.filter("NOT crowded")).select("prefix", "did", "place", "words")
        covered = subtrees.repartition("prefix").sortWithinPartitions("prefix", "did", "place").mapInArrow(
            _grow_subtrees(window), "did long, place long, n int"
        )
        found += [
            rows.select("did", th, F.lit(level * _KINDS + kind).alias("kind"), start, "n")
            for rows, kind in ((repeated, _RUN), (firsts, _FIRST_RUN), (covered, _COVERED))
        ]
        if last or not leaves.filter("crowded").limit(1).count():
            return reduce(DataFrame.unionByName, found)
        prefix, level = min(2 * prefix, window), level + 1
        crowded = leaves.filter("crowded").select("did", "place", "words")
        runs = crowded.mapInArrow(_emit_runs_of_runs(window, prefix), "prefix long, path long, did long, place long, n int, words binary")
        repeated, firsts, leaves = _contested(runs)


def remove_repeated_windows(
    docs: DataFrame,
    window_words: int = WINDOW_WORDS,
    prefix_words: int = PREFIX_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, removed_spans (word positions, maximal), kept_text of every row.

    A window is ``window_words`` consecutive words ``[^\\x20\\x09-\\x0D]+``. Every word goes that lies
    in a window whose words also start earlier: at a smaller id, or earlier in the same text.

    How: runs below prefixes with one leaf stop there. Of runs with the same prefix and path (two
    independent 64-bit hashes; 1e13 runs, at most SUBTREE_RUNS different ones a prefix, expect 0.001 false
    matches) all but the first repeat it. The first runs of prefixes that have several
    paths form subtrees of at most SUBTREE_RUNS runs, built in tasks on the words: the nodes at the
    window depth that have several leaves are the repeats, which join to maximal spans. The windows of a
    prefix with more paths go round again with prefixes of twice the length, the window's at last, below
    which all windows are equal. Counts and minima are partially aggregated and rows return to
    their text by id, so a passage that a third of all documents share is never gathered in one task.

    Null or empty text has no words. Null ids come first, in the order of a text hash. Rows with one id and
    different texts are ordered by a text hash; fully repeated rows count as one document, of which one
    is worked on, and get equal results. Other columns are ignored. No rows in, no rows out.
    """
    if not 1 <= prefix_words <= window_words:
        raise ValueError("prefix_words must be between 1 and window_words")
    base = id_and_text(docs, id_col, text_col)
    hashed = F.xxhash64("text")
    nameless = F.lit(_NO_ID) + F.shiftrightunsigned(hashed, 2)  # rows without an id are told apart by 62 more bits
    rows = base.select("doc_id", F.coalesce("doc_id", nameless).alias("did"), hashed.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("th"), "text")
    texts = _one_of_each(rows)
    marks = _marks(texts, window_words, prefix_words)
    marks = marks.groupBy("did", "th").agg(F.collect_list(F.struct("kind", "start", "n")).alias("marks"))
    none = F.array().cast("array<struct<kind:int,start:int,n:int>>")
    return (
        rows.join(marks, ["did", "th"], "left")
        .select("doc_id", "th", "text", F.coalesce("marks", none).alias("marks"))
        .mapInArrow(
            _remove(window_words),
            "doc_id long, n_words long, n_removed long, removed_spans array<struct<start:long,end:long>>, kept_text string",
        )
    )


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
