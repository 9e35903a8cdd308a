"""SimHash near-duplicates: fingerprints meet at the anchors of covering codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrad.llm.common import broadcast_if_small, fresh_name, id_and_text, read_table, unsigned_hex
from loomgrad.llm.components import connected_components, stars
from loomgrad.llm.exact_links import exact_components
from loomgrad.llm.wordhash import mix, pieces, run_hashes, word_hashes, word_spans
from loomgrad.session import cut_lineage, materialise

HASH_SEED = 42
MAX_DISTANCE = 4
#: Rows of an anchor that one task compares with each other; larger anchors are cut into a grid.
ANCHOR_ROWS = 4096
#: Pairs of a cell up to which it is compared together with others.
SMALL_CELL = 4096
#: Pairs that a task compares at once: what bounds its memory.
PAIRS_AT_ONCE = 100_000
#: Hot anchors up to this many are broadcast: 16 bytes each.
HOT_BROADCAST = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(text: str, shingle_words: int) -> list[int]:
    """XXH64 of each run of ``shingle_words`` words of the text with A-Z lower-cased."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return [xxhash.xxh64_intdigest(joined, HASH_SEED)] if words else []
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    hash64 = xxhash.xxh64_intdigest
    return [hash64(joined[s : e - 1], HASH_SEED) for s, e in zip(starts, starts[shingle_words:], strict=False)]


def fingerprints(text: str, shingle_words: int, n_prints: int = 1) -> list[int]:
    """``n_prints`` fingerprints as signed longs: the first from the shingle hashes, the others from remixed ones.

    A bit is 1 if it is set in over half of the hashes; no words: zero.
    """
    hashes = np.array(shingle_hashes(text, shingle_words), dtype=np.uint64)
    return majority(bit_counts(hashes, n_prints)[None], np.array([len(hashes)]))[0].view(np.int64).tolist()


def bit_counts(hashes: np.ndarray, n_prints: int) -> np.ndarray:
    """How many of the hashes have each bit: (prints, 64)."""
    counts = np.zeros(64 * n_prints, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        many = np.stack([part, *(mix(part ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) for k in range(1, n_prints))], axis=1)
        bits = np.unpackbits(many.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # as many as a byte can count
            counts += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return counts.reshape(n_prints, 64)


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, prints) fingerprints of (texts, prints, 64) counts among ``n`` hashes a text."""
    ones = counts * 2 > n[:, None, None]
    return np.packbits(ones, axis=2, bitorder="little").view("<u8")[:, :, 0].astype(np.uint64, copy=False)


def node_ids(prints: np.ndarray) -> np.ndarray:
    """One long per row of an (n, prints) matrix: the fingerprint itself, or a hash of several."""
    if prints.shape[1] == 1:
        return prints[:, 0].astype(np.uint64).view(np.int64)
    h = np.zeros(len(prints), dtype=np.uint64)
    for column in prints.T:
        h = mix(h + column)
    return h.view(np.int64)


def fingerprint_column(text: Column, shingle_words: int, n_prints: int = 1) -> Column:
    """array<long> of each whole text: its fingerprints and, last, its node id."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprints(t, shingle_words, n_prints) for t in texts], dtype=np.int64).reshape(-1, n_prints)
            yield pd.Series(list(np.column_stack([prints, node_ids(prints.view(np.uint64))])), dtype="object")

    return column(text)


# --- anchors ----------------------------------------------------------------------------------
#
# The 64 bits form blocks of 23, 23 and 18. Two fingerprints that differ in at most 4 bits differ in
# at most 1 bit of the first, or at most 1 of the second, or none of the third block (2 + 2 + 1 > 4).
# The anchors of a 23-bit block are the words of the code Hamming(15,11) x {0,1}^8: covering radius 1,
# each block value has one nearest anchor, its home. A fingerprint is replicated to every anchor
# within radius + threshold = 2 that can be the home of a value within 1 bit. Two linked fingerprints
# meet at the home of either; pairs are compared once per home, on all bits.

_BLOCKS = ((0, 23), (23, 23))
_EXACT_BLOCK = (46, 18)
_HAMMING = 15


def _syndrome(value: np.ndarray) -> np.ndarray:
    out = np.zeros(len(value), dtype=np.uint64)
    for i in range(_HAMMING):
        out ^= ((value >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _home(value: np.ndarray) -> np.ndarray:
    """The nearest anchor of each block value: the Hamming part corrected, the free bits as they are."""
    wrong = _syndrome(value)
    flip = np.where(wrong > 0, np.uint64(1) << (np.maximum(wrong, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return value ^ flip


def anchor_entries(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, is home, row) of an (n, prints) matrix of fingerprints; an entry per pair."""
    anchors, homes, owners = [], [], []
    index = np.arange(len(prints))
    for p in range(prints.shape[1]):
        name = p * (len(_BLOCKS) + 1)  # anchors of different fingerprints and blocks never meet
        for number, (shift, width) in enumerate(_BLOCKS):
            value = (prints[:, p] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            own = _home(value)
            reached = np.stack([own] + [_home(value ^ np.uint64(1 << i)) for i in range(width)], axis=1)
            reached.sort(axis=1)
            fresh = np.ones(reached.shape, dtype=bool)
            fresh[:, 1:] = reached[:, 1:] != reached[:, :-1]
            owner = np.broadcast_to(index[:, None], reached.shape)[fresh]
            anchor = reached[fresh]
            anchors.append(anchor | np.uint64(name + number << 32))
            homes.append(anchor == own[owner])
            owners.append(owner)
        shift, width = _EXACT_BLOCK
        value = (prints[:, p] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        anchors.append(value | np.uint64(name + len(_BLOCKS) << 32))
        homes.append(np.ones(len(prints), dtype=bool))
        owners.append(index)
    return np.concatenate(anchors), np.concatenate(homes), np.concatenate(owners)


def _longs(batch: pa.RecordBatch, columns: range) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in columns], axis=1)


#: Rows (n, columns) -> (anchor, is home, row) of their entries.
Entries = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _covering(n_prints: int) -> Entries:
    return lambda rows: anchor_entries(np.ascontiguousarray(rows[:, :n_prints]).view(np.uint64))


def _to_anchors(entries: Entries, names: list[str], carried: list[str]):
    """``names``: the columns of the rows. Their entries hold the ``carried`` ones; ``part`` is 1 at home, else 0."""

    def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _longs(batch, range(len(names)))
            for at in range(0, len(rows), 4_000):
                part = rows[at : at + 4_000]
                anchor, home, owner = entries(part)
                columns = [pa.array(anchor.view(np.int64)), pa.array(home.astype(np.int64)), *(pa.array(part[owner, names.index(c)]) for c in carried)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "part", *carried])

    return to_anchors


# --- comparison per anchor --------------------------------------------------------------------


def distances(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ other).sum(axis=-1, dtype=np.int64)


#: (n, columns) and (columns) or (n, columns) -> how far apart the rows are.
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spanning_links(
    homes: np.ndarray,
    home_nodes: np.ndarray,
    others: np.ndarray,
    other_nodes: np.ndarray,
    max_distance: int = MAX_DISTANCE,
    distance: Distance = distances,
) -> list[tuple[int, int]]:
    """Links that connect all that the pairs (home, other) within the distance connect: a spanning forest.

    Fingerprints are (n, prints) matrices. A search from each home: what it reaches leaves the
    unvisited sets, so a dense group costs a few scans and yields at most as many links as it has
    members, never all its pairs.
    """
    links: list[tuple[int, int]] = []
    left = {True: np.arange(len(homes)), False: np.arange(len(others))}  # unvisited homes and others
    prints, nodes = {True: homes, False: others}, {True: home_nodes, False: other_nodes}
    while len(left[True]):
        front = [(int(left[True][0]), True)]
        left[True] = left[True][1:]
        while front:
            at, is_home = front.pop()
            unvisited = left[not is_home]
            if not len(unvisited):
                continue
            near = distance(prints[not is_home][unvisited], prints[is_home][at]) <= max_distance
            if not near.any():
                continue
            for y in unvisited[near].tolist():
                if nodes[is_home][at] != nodes[not is_home][y]:
                    links.append((int(nodes[is_home][at]), int(nodes[not is_home][y])))
                front.append((y, not is_home))
            left[not is_home] = unvisited[~near]
    return links


def compare_cells(n_prints: int, max_distance: int, named: bool = False, distance: Distance = distances):
    """(u, v): links that connect what the pairs of each cell connect that are within the distance.

    Rows come sorted by cell: the anchor, the part of its grid (with the lowest bit: home), fingerprints.
    ``named``: a column with the node's id follows, and what the cells of a batch connect is linked to its least
    node. Cells of one group share their least nodes, so a node has few different links however many cells it is in.
    """

    def links_of(cell: np.ndarray, home: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        prints = np.ascontiguousarray(rows[:, :n_prints]).view(np.uint64)
        node = np.ascontiguousarray(rows[:, n_prints]) if named else node_ids(prints)
        edge = np.flatnonzero(np.any(cell[1:] != cell[:-1], axis=1)) + 1
        begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(prints)]])
        n_home = np.add.reduceat(home.astype(np.int64), begins)
        size = ends - begins
        us, vs = ([np.empty(0, dtype=np.int64)] for _ in range(2))
        small = (n_home > 0) & (size > 1) & (n_home * size <= SMALL_CELL)
        dense = (n_home > 0) & (size > 1) & ~small
        if small.any():  # many small cells at once: each home row against each row of its cell
            cell_of = np.repeat(np.arange(len(begins)), size)
            lines = np.flatnonzero(home & small[cell_of])
            for part in np.array_split(lines, max(1, int((size[cell_of[lines]].sum()) // PAIRS_AT_ONCE) + 1)):
                reps = size[cell_of[part]]
                left = np.repeat(part, reps)
                ahead = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
                right = np.repeat(begins[cell_of[part]], reps) + ahead
                near = (distance(prints[left], prints[right]) <= max_distance) & (node[left] != node[right]) & ~(home[right] & (left > right))
                left, right = left[near], right[near]
                # A cell with more near pairs than rows is a dense group: a forest will do.
                dense |= np.bincount(cell_of[left], minlength=len(begins)) > size
                few = ~dense[cell_of[left]]
                us.append(node[left[few]])
                vs.append(node[right[few]])
        for k in np.flatnonzero(dense):
            mine, own = slice(begins[k], ends[k]), home[begins[k] : ends[k]]
            if found := spanning_links(prints[mine][own], node[mine][own], prints[mine], node[mine], max_distance, distance):
                pair = np.array(found, dtype=np.int64)
                us.append(pair[:, 0])
                vs.append(pair[:, 1])
        u, v = np.concatenate(us), np.concatenate(vs)
        return list(stars(np.column_stack([u, v])).T) if named else [u, v]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = _longs(batch, range(2))
            now = (cell >> np.array([0, 1]), (cell[:, 1] & 1).astype(bool), _longs(batch, range(2, 2 + n_prints + named)))
            if kept is not None:
                now = tuple(np.concatenate([k, x]) for k, x in zip(kept, now, strict=True))
            cell = now[0]
            last = np.flatnonzero(np.any(cell != cell[-1], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(*(x[:cut] for x in now))], names=["u", "v"])
            kept = tuple(x[cut:] for x in now)
        if kept is not None and len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(*kept)], names=["u", "v"])

    return compare


def fingerprint_links(nodes: DataFrame, n_prints: int = 1, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v): links between nodes that share an anchor and differ in at most ``max_distance`` of all bits.

    ``nodes``: longs f0, f1, ... and one row per combination; u and v are their :func:`node_ids`. The
    links connect exactly the nodes with such a path. One fingerprint and a distance of at most 4 bits
    miss no pair; with several, a pair is missed only if no block of any of them is near enough.

    Hot anchors: the rows of an anchor are counted first (partial aggregation). One with more than
    ANCHOR_ROWS becomes a grid of cells, its homes against its rows, so a cell is bounded and no pair
    of the anchor is left out. The list of hot anchors is broadcast while it is short, else joined.
    """
    names = [f"f{i}" for i in range(n_prints)]
    dealt = deal_entries(nodes.select(*names), _covering(n_prints), names)
    return dealt.mapInArrow(compare_cells(n_prints, max_distance), "u long, v long")


def deal_entries(nodes: DataFrame, entries_of: Entries, names: list[str], counted: int = 1) -> DataFrame:
    """The entries of ``nodes`` with the columns ``names``, dealt and sorted by cell for :func:`compare_cells`.

    ``part`` is 2 * (line * 2**31 + column) of the anchor's grid, plus 1 for a home row. Hot anchors are
    found on one of ``counted`` nodes, by the hash of the first column: what a count gets wrong changes
    the size of cells, never which rows meet.
    """
    schema = "anchor long, part long, " + ", ".join(f"{c} long" for c in names)
    emit = _to_anchors(entries_of, nodes.columns, names)
    entries = nodes.mapInArrow(emit, schema)
    some = entries if counted == 1 else nodes.filter(F.pmod(F.xxhash64(nodes.columns[0]), F.lit(counted)) == 0).mapInArrow(emit, schema)
    hot = cut_lineage(
        some.groupBy("anchor")
        .agg((F.count(F.lit(1)) * counted).alias("n"), (F.sum("part") * counted).alias("n_home"))
        .filter(F.col("n") > ANCHOR_ROWS)
        .select(
            F.col("anchor").alias("hot_anchor"),
            F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("columns"),
            F.greatest(F.ceil(F.col("n_home") / ANCHOR_ROWS).cast("int"), F.lit(1)).alias("lines"),
        )
    )
    n_hot = hot.count()
    if n_hot:
        spread = entries.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, F.col("anchor") == F.col("hot_anchor"), "left")
        home = F.col("part") == 1
        place = F.xxhash64(*names)
        cell = lambda line, column, at_home: F.lit(2) * (line.cast("long") * F.lit(2**31) + column.cast("long")) + F.lit(at_home)
        # In a grid, a home row goes along its line, and every row along its column as one to compare with.
        along_line = F.when(
            home, F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: cell(F.pmod(place, F.col("lines")), c, 1))
        ).otherwise(F.array().cast("array<long>"))
        along_column = F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda r: cell(r, F.pmod(place, F.col("columns")), 0))
        parts = F.when(F.col("hot_anchor").isNull(), F.array("part")).otherwise(F.concat(along_line, along_column))
        entries = spread.select("anchor", F.explode(parts).alias("part"), *names)
    return entries.repartition("anchor", F.shiftright("part", 1)).sortWithinPartitions("anchor", "part")


# --- the operator -----------------------------------------------------------------------------


def simhash_components(
    docs: DataFrame,
    shingle_words: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_prints: int = 1,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """doc_id, fp (long, the first fingerprint), component_id of every row: the smallest id reachable.

    Fingerprints link at ``max_distance`` or fewer differing bits over all ``n_prints`` of a document.
    Documents with equal fingerprints are one node, so copies cost nothing beyond the partial
    aggregation that merges them.

    Null or wordless text has fingerprint zero and links like any other. Null ids are never a
    component_id unless all ids of the component are null. Repeated rows share a component. Other
    columns are ignored. No rows in, no rows out.
    """
    base = id_and_text(docs, id_col, text_col)
    printed = base.select("doc_id", fingerprint_column(F.col("text"), shingle_words, n_prints).alias("f"))
    prints = [F.col("f")[i].alias(f"f{i}") for i in range(n_prints)]
    printed = cut_lineage(printed.select("doc_id", F.col("f")[n_prints].alias("node"), *prints))  # lost executors don't hash texts again
    nodes = printed.groupBy("node", *[f"f{i}" for i in range(n_prints)]).agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(nodes, n_prints, max_distance)).withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, F.col("node") == F.col("linked"), "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    classes = rooted.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("class_node"), "component_id")
    return printed.join(classes, F.col("node") == F.col("class_node")).select("doc_id", F.col("f0").alias("fp"), "component_id")


# --- near duplicates by similarity ------------------------------------------------------------
#
# Shingle sets with Jaccard similarity J have an angle with cosine near 2J / (1 + J), and bits differ at
# angle / pi: 0.1515 for J = 0.8. The bits that differ are mostly those that nearly half of the shingles
# have. So the anchors are all values of a block of BLOCK_BITS bits, and a fingerprint goes to its own
# value and to those within reach over its WEAK_BITS least certain bits. Two texts meet in a block if
# each bit that differs is a weak one of either. For J = 0.8 that is 38 % a block (normal margins), and
# 99.7 % over the 12 blocks of four fingerprints. Candidates are pairs that meet and are near in
# COMPARED_PRINTS of them (128 bits, 19.4 +- 4.1 expected at J = 0.8); exact similarity decides.

SIMILAR_PRINTS = 4
COMPARED_PRINTS = 2
SIMILAR_DISTANCE = 32
BLOCK_BITS = 20
WEAK_BITS = 3
_PER_PRINT = 64 // BLOCK_BITS
#: Nodes whose entries one task makes (some 5 kB a node), up to a number of tasks.
ENTRY_NODES = 20_000
ENTRY_TASKS = 100_000
#: One of so many nodes is counted to find hot anchors.
COUNTED_NODES = 16
_LOWER_TABLE = np.frombuffer(_LOWER, dtype=np.uint8)


def shingle_sets(texts: pa.Array, shingle_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes, sorted) of each text with A-Z lower-cased. Fewer words: all of them are one shingle."""
    none = np.empty(0, dtype=np.uint64)
    for row, end, raw, bounds in pieces(texts):
        raw = _LOWER_TABLE[raw]
        starts, ends, doc = word_spans(raw, bounds)
        words = word_hashes(raw, starts, ends)
        runs = mix(run_hashes(words, shingle_words))
        first = np.searchsorted(doc, np.arange(end - row + 1)).tolist()
        for d in range(end - row):
            a, b = first[d], first[d + 1]
            if b - a >= shingle_words:
                yield row + d, np.unique(runs[a : b - shingle_words + 1])
            else:
                yield row + d, mix(run_hashes(words[a:b], b - a)) if b > a else none


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """The distinct shingle hashes of the text, sorted."""
    return next(shingle_sets(pa.array([text]), shingle_words))[1]


def set_id(shingles: np.ndarray) -> int:
    """One long per shingle set: texts with equal sets are one node."""
    whole = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([whole], dtype=np.uint64)).view(np.int64)[0])


def weak_bits(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, prints) masks of the WEAK_BITS bits of each block whose counts are nearest to half of ``n``."""
    margin = np.abs(2 * counts - n[:, None, None])[:, :, : _PER_PRINT * BLOCK_BITS].reshape(*counts.shape[:2], _PER_PRINT, BLOCK_BITS)
    weak = np.argsort(margin, axis=3, kind="stable")[..., :WEAK_BITS] + BLOCK_BITS * np.arange(_PER_PRINT)[:, None]
    return (np.uint64(1) << weak.astype(np.uint64)).sum(axis=(2, 3), dtype=np.uint64)


def _set_prints(shingle_words: int):
    """doc_id, node, fingerprints and weak bits of the shingle set of each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = np.zeros((part.num_rows, SIMILAR_PRINTS, 64), dtype=np.int64)
                n, node = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows, dtype=np.int64)
                for row, found in shingle_sets(part.column(1), shingle_words):
                    counts[row], n[row], node[row] = bit_counts(found, SIMILAR_PRINTS), len(found), set_id(found)
                both = np.concatenate([majority(counts, n), weak_bits(counts, n)], axis=1).view(np.int64)
                names = ["doc_id", "node", *_PRINTS, *_WEAK]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), *(pa.array(c) for c in both.T.copy())], names=names)

    return emit


_PRINTS = [f"f{i}" for i in range(SIMILAR_PRINTS)]
_WEAK = [f"w{i}" for i in range(SIMILAR_PRINTS)]


def weak_entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, is home, row) of rows that begin with SIMILAR_PRINTS fingerprints and their weak bits. All are homes."""
    bits = np.ascontiguousarray(rows[:, : 2 * SIMILAR_PRINTS]).view(np.uint64)
    anchors = []
    for p in range(SIMILAR_PRINTS):
        for block in range(_PER_PRINT):
            shift, width = np.uint64(block * BLOCK_BITS), np.uint64((1 << BLOCK_BITS) - 1)
            reached, weak = [(bits[:, p] >> shift) & width], (bits[:, SIMILAR_PRINTS + p] >> shift) & width
            for _ in range(WEAK_BITS):
                lowest = weak & (~weak + np.uint64(1))
                weak = weak ^ lowest
                reached += [r ^ lowest for r in reached]
            anchors += [r | np.uint64(p * _PER_PRINT + block << 32) for r in reached]
    owner = np.tile(np.arange(len(rows)), len(anchors))
    return np.concatenate(anchors), np.ones(len(owner), dtype=bool), owner


def set_emitter(shingle_words: int):
    """From (root, node, text) to (root, node, members): the shingle set of each text that is the node's."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, node, out = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)), [])
            for row, found in shingle_sets(batch.column(2), shingle_words):
                if set_id(found) == node[row]:
                    out.append((root[row], node[row], found.view(np.int64)))
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["root", "node", "members"])

    return emit


def smallest_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest id of the component of each of the ``nodes`` (node, first_id)."""
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("node", "component_id")


def similar_components(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row with an id: the smallest id that links of similarity 0.8 or more reach.

    Candidates are pairs that share an anchor and are near. What they connect is a cluster, in which the
    shingle sets themselves are linked (:func:`~loomgrad.llm.exact_links.exact_components`).

    Null or wordless texts have the empty set and are one node. Repeated rows share a component. Other
    columns are ignored. No rows in, no rows out.
    """
    base = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    longs = ", ".join(f"{c} long" for c in ("doc_id", "node", *_PRINTS, *_WEAK))
    printed = materialise(base.mapInArrow(_set_prints(shingle_words), longs))
    tasks = min(ENTRY_TASKS, -(-printed.count() // ENTRY_NODES)) or 1
    nodes = materialise(printed.groupBy("node", *_PRINTS, *_WEAK).agg(F.min("doc_id").alias("first_id")).repartition(tasks, "node"))
    carried = [*_PRINTS[:COMPARED_PRINTS], "node"]
    dealt = deal_entries(nodes.select(*_PRINTS, *_WEAK, "node"), weak_entries, carried, COUNTED_NODES)
    candidates = dealt.mapInArrow(compare_cells(COMPARED_PRINTS, SIMILAR_DISTANCE, named=True), "u long, v long")
    roots = exact_components(nodes, candidates, base, set_emitter(shingle_words))
    return printed.select("doc_id", "node").join(smallest_ids(nodes, roots), "node").select("doc_id", "component_id")


def keep_one_per_component(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component of similar texts; all columns stay.

    Similar: sets of word shingles with a Jaccard similarity of 0.8 or more. Of repeated rows with one
    id, one stays. Rows without an id can't be named and stay. No rows in, no rows out.
    """
    found = similar_components(docs, shingle_words, id_col, text_col)
    id_name = fresh_name(docs, "_gone_id")
    by_id = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = cut_lineage(by_id.filter("NOT stays OR n > 1"))
    rows, named = docs, F.col(id_col).isNotNull()
    if marked.filter("stays").limit(1).count():  # only then whole rows are grouped
        rows = docs.filter(named).dropDuplicates([id_col]).unionByName(docs.filter(~named))
    gone = broadcast_if_small(cut_lineage(marked.filter("NOT stays").select(F.col("doc_id").alias(id_name))))
    return rows.join(gone, F.col(id_col).cast("long") == F.col(id_name), "left_anti")


def op2_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), 4).select(
        "doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
