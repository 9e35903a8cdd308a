"""MinHash near-duplicates: documents meet in the posting lists of their signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import id_and_text, read_table, use_small_batches
from loomgrad.llm.exact_links import exact_components
from loomgrad.llm.simhash import ENTRY_NODES, ENTRY_TASKS, compare_cells, deal_entries, set_emitter, set_id, shingle_sets, smallest_ids
from loomgrad.llm.wordhash import mix
from loomgrad.session import cut_lineage, materialise

#: Coordinates of a signature. Those of two sets with similarity J agree with chance J each.
COORDINATES = 48
#: Coordinates that must agree. At J = 0.8 fewer do with chance 1.3e-5, at J = 0.4 as many with 0.03.
LEAST_MATCHES = 26
#: Two signatures with so many matches share one of any COORDINATES - LEAST_MATCHES + 1 of their coordinates.
PREFIX = COORDINATES - LEAST_MATCHES + 1
#: Coordinate-value pairs in more than this share of the sets come last in a prefix: at most 48 / share of them.
HEAVY_SHARE = 0.001
#: One of so many sets is counted to find them, and hot posting lists.
COUNTED_SETS = 16
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUES = [f"q{i}" for i in range(COORDINATES // 2)]  # two coordinates of 32 bits a long
_BYTES = [f"b{i}" for i in range(COORDINATES // 8)]  # the lowest 8 bits of each
_LOWER_HALF = np.uint64(0xFFFFFFFF)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES least values of the shingle hashes under as many orders; 32 bits of each."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        h = (shingles[at : at + 4096, None] ^ _SEEDS) * (_SEEDS | np.uint64(1))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        np.minimum(least, h.min(axis=0), out=least)
    return (mix(least) & _LOWER_HALF).astype(np.uint32)


def _signatures(shingle_words: int):
    """doc_id, node, n, coordinates and their lowest bytes of the shingle set of each text."""
    names = ["doc_id", "node", "n", *_VALUES, *_BYTES]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, COORDINATES), dtype=np.uint32)
            n, node = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, found in shingle_sets(batch.column(1), shingle_words):
                values[row], n[row], node[row] = signature(found), len(found), set_id(found)
            both = [*values.view(np.int64).T, *(values & np.uint32(255)).astype(np.uint8).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(n), *map(pa.array, both)], names=names)

    return emit


def _elements(rows: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) coordinate-value pairs as one number each, of rows that begin with the values."""
    values = np.ascontiguousarray(rows[:, : len(_VALUES)]).view(np.uint32).astype(np.int64)
    return values | (np.arange(COORDINATES, dtype=np.int64) << 32)


def posting_entries(heavy: np.ndarray):
    """(list, is home, row): each set under the first PREFIX of its coordinates, those of the sorted ``heavy`` pairs last.

    The order of pairs is the same for all sets, so any two with LEAST_MATCHES agreements meet in a list.
    """

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = _elements(rows)
        order = np.argsort(np.isin(pairs, heavy), axis=1, kind="stable")[:, :PREFIX]
        lists = np.take_along_axis(pairs, order, axis=1).ravel()
        return lists.view(np.uint64), np.ones(len(lists), dtype=bool), np.repeat(np.arange(len(rows)), PREFIX)

    return entries


def mismatches(sets: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Coordinates in which signatures differ. What differs too often in the first half is not counted further."""
    half, most = sets.shape[1] // 2, COORDINATES - LEAST_MATCHES

    def differ(part: slice, rows: np.ndarray | slice) -> np.ndarray:
        apart = np.ascontiguousarray(sets[rows, part] ^ (other[rows, part] if other.ndim == 2 else other[part]))
        return np.count_nonzero(apart.view(np.uint8), axis=1)

    out = differ(slice(0, half), slice(None))
    going = np.flatnonzero(out <= most)
    out[going] += differ(slice(half, None), going)
    return out


def _heavy_pairs(nodes: DataFrame) -> np.ndarray:
    """The coordinate-value pairs of more than HEAVY_SHARE of the counted sets, sorted: at most COORDINATES / HEAVY_SHARE."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(len(_VALUES))], axis=1).reshape(-1, len(_VALUES))
            pairs, times = np.unique(_elements(rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "times"])

    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(COUNTED_SETS)) == 0).select(*_VALUES)
    least = max(16, int(HEAVY_SHARE * some.count()))
    counted = some.mapInArrow(emit, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times"))
    return np.array(sorted(r["pair"] for r in counted.filter(F.col("times") > least).collect()), dtype=np.int64)


def minhash_components(
    docs: DataFrame, shingle_words: int = 4, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: sets of word shingles linked from a Jaccard similarity of ``share``.

    Equal sets are one node. Nodes are posted under a prefix of their signature coordinates; in a posting
    list collisions are counted and those above the match threshold connect candidates; in what these
    connect, the full sets decide (:func:`~loomgrad.llm.exact_links.exact_components`). The match threshold
    is made for 0.8: a lower ``share`` would lose links and is an error.

    Null, empty and wordless texts have no shingles and are linked with nothing. A row without an id can't
    be named: it has no component and is kept. Repeated rows share a component. Other columns are ignored.
    No rows in, no rows out.
    """
    if share[0] * 5 < share[1] * 4:
        raise ValueError("similarities under 4 / 5 are not found by these signatures")
    base = id_and_text(docs, id_col, text_col)
    longs = ", ".join(f"{c} long" for c in ("doc_id", "node", "n", *_VALUES, *_BYTES))
    signed = materialise(base.mapInArrow(_signatures(shingle_words), longs))
    sets = signed.filter("n > 0 AND doc_id IS NOT NULL")
    tasks = min(ENTRY_TASKS, -(-sets.count() // ENTRY_NODES)) or 1
    nodes = materialise(sets.groupBy("node", *_VALUES, *_BYTES).agg(F.min("doc_id").alias("first_id")).repartition(tasks, "node"))
    dealt = deal_entries(nodes.select(*_VALUES, *_BYTES, "node"), posting_entries(_heavy_pairs(nodes)), [*_BYTES, "node"], COUNTED_SETS)
    compare = compare_cells(len(_BYTES), COORDINATES - LEAST_MATCHES, named=True, distance=mismatches)
    candidates = dealt.mapInArrow(compare, "u long, v long")
    roots = exact_components(nodes, candidates, base.filter("doc_id IS NOT NULL"), set_emitter(shingle_words), share)
    shared = cut_lineage(smallest_ids(nodes, roots).select(F.col("node").alias("class_node"), "component_id"))
    rows = signed.select("doc_id", "node", F.col("n").alias("n_shingles"))
    named = rows.join(shared, (F.col("node") == F.col("class_node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    return minhash_components(read_table(spark, sf_dir, "documents"))
