"""Benchmark decontamination: every training passage queries a BM25 index of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from loomgrad.llm.common import broadcast_if_small, fresh_name, id_and_text, read_table
from loomgrad.llm.wordhash import NOT_ALPHANUMERIC, mix, pieces, run_hashes, word_hashes, word_spans
from loomgrad.session import cut_lineage

#: An index entry is at most ENTRY_WORDS consecutive words of an item. Passages are twice as long and
#: start every ENTRY_WORDS words, so an entry that a text contains lies whole in one of its passages.
ENTRY_WORDS = 64
#: Entries of one index. Items beyond it go to further indexes, and documents are read once for each.
INDEX_ENTRIES = 20_000
#: An item with fewer words than this is no evidence and doesn't match, unless the caller asks for less.
LEAST_WORDS = 5
#: A last entry with fewer words than this is evidence only together with the words before it.
LEAST_TAIL = 13
K1, B = 1.2, 0.75
#: Share of an entry's own BM25 score that a passage must reach to be a candidate.
LEAST_SCORE = 0.5
#: Share of the word trigrams of the question, and of the answer, that the passage must contain.
LEAST_OVERLAP = 0.6
GRAM = 3
BLOCK_ENTRIES = 8


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, text of each word) of lower-cased texts in bounded pieces."""
    for row, end, raw, bounds in pieces(pc.utf8_lower(texts)):
        starts, ends, doc = word_spans(raw, bounds, NOT_ALPHANUMERIC)
        yield row, end, word_hashes(raw, starts, ends, NOT_ALPHANUMERIC), doc


def trigrams(words: np.ndarray) -> np.ndarray:
    return np.unique(mix(run_hashes(words, min(GRAM, len(words))))) if len(words) else words


def gram_length(n_words: int) -> int:
    """Words of the runs that a part of so many words is compared by."""
    return min(GRAM, max(1, n_words))


# --- index ------------------------------------------------------------------------------------


def split_question(text: str) -> tuple[str, str]:
    """Question and answer of a text without separate columns: nothing tells an answer, so all is question."""
    return text, ""


#: Kinds of entries: cut from the start of an item, bridging two of those, and short tails.
CUT, BRIDGE, TAIL = 0, 1, 2


def _entries(least_words: int):
    """Items as entries: word hashes, how many of them belong to the question, and the kind.

    Items over ENTRY_WORDS words also give bridges, full entries half way between two others and at
    the end, so a quote of ENTRY_WORDS words shares three quarters of some entry wherever it begins.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, question, answer in zip(batch["item_id"], batch["question"], batch["answer"], strict=True):
                found = [w for _, _, w, _ in words_of(pa.array([question or ""]))][0]
                more = [w for _, _, w, _ in words_of(pa.array([answer or ""]))][0]
                words = np.concatenate([found, more])
                if len(words) < least_words:
                    continue
                for at in range(0, len(words), ENTRY_WORDS):
                    part = words[at : at + ENTRY_WORDS]
                    if not at or len(part) >= LEAST_WORDS:
                        kind = TAIL if at and len(part) < LEAST_TAIL else CUT
                        rows.append((item, part.view(np.int64).tolist(), int(np.clip(len(found) - at, 0, len(part))), kind))
                last = len(words) - ENTRY_WORDS
                for at in sorted({*range(ENTRY_WORDS // 2, last, ENTRY_WORDS), last} if last > 0 else ()):
                    if at % ENTRY_WORDS:
                        part = words[at : at + ENTRY_WORDS]
                        rows.append((item, part.view(np.int64).tolist(), int(np.clip(len(found) - at, 0, len(part))), BRIDGE))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n_question", "kind"])

    return entries


@dataclass(frozen=True)
class Index:
    """Impact-ordered facts of an inverted index. Weights are shares of the entry's own score."""

    items: list
    kinds: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    lengths: list[tuple[int, int]]  # words of the runs in question and answer
    terms: np.ndarray  # sorted hashes
    posting_entry: np.ndarray
    posting_weight: np.ndarray
    block_at: np.ndarray  # blocks of a term, and
    block_posting_at: np.ndarray  # the postings of each of them
    block_of: np.ndarray
    block_weight: np.ndarray
    rare_weight: np.ndarray  # largest weight of a term; 0 for common terms
    least_rare: float


def build_index(rows: list, n_entries: int, mean_words: float, frequency: dict[int, int]) -> Index:
    """``rows``: (item_id, words, n_question, kind). Statistics are those of all entries but bridges, of this index or not."""
    entry, term, tf, lengths = [], [], [], []
    for i, (_, words, _, _) in enumerate(rows):
        distinct, counts = np.unique(np.array(words, dtype=np.int64), return_counts=True)
        entry.append(np.full(len(distinct), i))
        term.append(distinct)
        tf.append(counts)
        lengths.append(np.full(len(distinct), len(words)))
    entry, term, tf, lengths = (np.concatenate(x) for x in (entry, term, tf, lengths))
    df = np.array([frequency.get(t, 1) for t in term.tolist()], dtype=np.float64)
    weight = np.log(1 + (n_entries - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean_words))
    weight = weight / np.bincount(entry, weights=weight)[entry]
    terms, ids = np.unique(term.view(np.uint64), return_inverse=True)
    order = np.lexsort((entry, ids))
    entry, ids, weight, df = entry[order], ids[order], weight[order], df[order]
    posting_at = np.searchsorted(ids, np.arange(len(terms) + 1))
    blocks = entry // BLOCK_ENTRIES
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])]))
    block_weight = np.maximum.reduceat(weight, first)
    # Common terms: the most frequent ones, as long as they make up at most half of what a candidate
    # needs in any entry. The other half has to come from rare terms.
    mass, common = np.zeros(len(rows)), np.zeros(len(terms), dtype=bool)
    for t in np.argsort(-df[posting_at[:-1]], kind="stable"):
        where = slice(posting_at[t], posting_at[t + 1])
        if (mass[entry[where]] + weight[where]).max() <= LEAST_SCORE / 2:
            mass[entry[where]] += weight[where]
            common[t] = True
    arrays = [np.array(w, dtype=np.int64).view(np.uint64) for _, w, _, _ in rows]
    return Index(
        items=[r[0] for r in rows],
        kinds=[r[3] for r in rows],
        questions=[trigrams(w[: r[2]]) for w, r in zip(arrays, rows, strict=True)],
        answers=[trigrams(w[r[2] :]) for w, r in zip(arrays, rows, strict=True)],
        lengths=[(gram_length(r[2]), gram_length(len(w) - r[2])) for w, r in zip(arrays, rows, strict=True)],
        terms=terms,
        posting_entry=entry,
        posting_weight=weight,
        block_at=np.searchsorted(ids[first], np.arange(len(terms) + 1)),
        block_posting_at=np.concatenate([first, [len(entry)]]),
        block_of=blocks[first],
        block_weight=block_weight,
        rare_weight=np.where(common, 0.0, np.maximum.reduceat(weight, posting_at[:-1])),
        least_rare=LEAST_SCORE - float(mass.max()),
    )


# --- queries ----------------------------------------------------------------------------------


def _ranges(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges at[w]..at[w + 1] of ``which``, and the place in ``which`` of each."""
    n = at[which + 1] - at[which]
    owner = np.repeat(np.arange(len(which)), n)
    return np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), owner


def search(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, entry, score) of every pair that reaches LEAST_SCORE; input: distinct (passage, term) rows.

    Block-max WAND over a batch of passages. Pivot: passages whose rare terms can't make up what
    common terms leave open are skipped. Blocks: the block maxima of a passage's terms bound the score
    of all entries of a block, and only the postings of blocks whose bound reaches the threshold are
    read. Both bounds are never below the score, so nothing above the threshold is lost.
    """
    slack = 1e-9
    rare = np.bincount(passage, weights=index.rare_weight[term]) if len(passage) else np.empty(0)
    open_passage = rare >= index.least_rare - slack
    keep = open_passage[passage]
    passage, term = passage[keep], term[keep]
    none = np.empty(0, dtype=np.int64)
    if not len(passage):
        return none, none, np.empty(0)
    n_blocks = int(index.block_of.max()) + 1
    at, owner = _ranges(index.block_at, term)
    _, where = np.unique(passage[owner] * n_blocks + index.block_of[at], return_inverse=True)
    bound = np.bincount(where, weights=index.block_weight[at])
    opened = bound[where] >= LEAST_SCORE - slack
    if not opened.any():
        return none, none, np.empty(0)
    from_passage = passage[owner[opened]]
    at, owner = _ranges(index.block_posting_at, at[opened])
    pair, where = np.unique(from_passage[owner] * len(index.items) + index.posting_entry[at], return_inverse=True)
    score = np.bincount(where, weights=index.posting_weight[at], minlength=len(pair))
    good = score >= LEAST_SCORE - slack
    return pair[good] // len(index.items), pair[good] % len(index.items), score[good]


def overlap(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


_MATCHES = "doc_id long, item_id {}, score double, question_overlap double, answer_overlap double"
_FOUND = _MATCHES + ", kind int"


def _find(shared, item_type: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            best: dict[tuple, tuple] = {}
            for row, end, words, doc in words_of(batch.column(1)):
                first = np.searchsorted(doc, np.arange(end - row + 1))
                n_words = np.diff(first)
                n_passages = np.maximum(1, -(-(n_words - ENTRY_WORDS) // ENTRY_WORDS)) * (n_words > 0)
                passage_at = np.concatenate([[0], np.cumsum(n_passages)])
                ids = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
                known = np.flatnonzero(index.terms[ids] == words)
                step = (known - first[doc[known]]) // ENTRY_WORDS
                pairs = []
                for back in (0, 1):  # a word lies in the passage that starts at its step, and the one before
                    ok = (step - back >= 0) & (step - back < n_passages[doc[known]])
                    pairs.append((passage_at[doc[known]] + step - back)[ok] * len(index.terms) + ids[known][ok])
                distinct = np.unique(np.concatenate(pairs))
                passages, entries, scores = search(index, distinct // len(index.terms), distinct % len(index.terms))
                for p, e, score in zip(passages.tolist(), entries.tolist(), scores.tolist(), strict=True):
                    d = int(np.searchsorted(passage_at, p, side="right")) - 1
                    start = first[d] + (p - passage_at[d]) * ENTRY_WORDS
                    passage = words[start : min(start + 2 * ENTRY_WORDS, first[d + 1])]
                    # A part of one or two words is a run of that length, and so are the passage's runs then.
                    q, a = (
                        overlap(part, mix(run_hashes(passage, n)))
                        for part, n in zip((index.questions[e], index.answers[e]), index.lengths[e], strict=True)
                    )
                    if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP:
                        key = (row + d, e)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[d] for d, _ in best], pa.int64()),
                    pa.array([index.items[e] for _, e in best], item_type),
                    *(pa.array([v[i] for v in best.values()], pa.float64()) for i in range(3)),
                    pa.array([index.kinds[e] for _, e in best], pa.int32()),
                ],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "kind"],
            )

    return find


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str | None = None,
    answer_col: str | None = None,
    item_text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per (document, item) whose passage passes retrieval and verification, with its best scores.

    Items with a question and an answer column use them; a lone text is compared as a whole. Words are
    lower-cased runs of letters and digits, over whole texts. The items are cut into indexes of INDEX_ENTRIES entries, each broadcast for one pass over the documents, so what
    is broadcast is bounded; statistics are those of all items. Documents are neither shuffled nor collected.

    Null or empty texts and items, and items under ``least_words`` words (1: every item counts), match nothing. Repeated
    documents or items are matched alike; rows with a null id appear with a null id. Other columns
    are ignored. No documents or no items in, no rows out.
    """
    spark = docs.sparkSession
    item = items.select(
        F.col(item_col).alias("item_id"),
        *(
            [F.col(question_col).cast("string").alias("question"), F.col(answer_col or question_col).cast("string").alias("answer")]
            if question_col
            else [F.col(item_text_col).cast("string").alias("text")]
        ),
    )
    if question_col is None:

        def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                parts = [split_question(t or "") for t in batch["text"]]
                yield pd.DataFrame({"item_id": batch["item_id"], "question": [p[0] for p in parts], "answer": [p[1] for p in parts]})

        kind = item.schema["item_id"].dataType.simpleString()
        item = item.mapInPandas(parted, f"item_id {kind}, question string, answer string")
    elif answer_col is None:
        item = item.withColumn("answer", F.lit(""))
    kind = item.schema["item_id"].dataType.simpleString()
    entries = item.mapInPandas(_entries(max(1, least_words)), f"item_id {kind}, words array<long>, n_question int, kind int")
    entries = cut_lineage(entries.withColumn("shard_key", F.xxhash64("item_id", "words")))
    counted = entries.filter(F.col("kind") != BRIDGE)
    n, mean_words = counted.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    schema = _MATCHES.format(kind)
    if not n:
        return spark.createDataFrame([], schema)
    n_indexes = -(-entries.count() // INDEX_ENTRIES)
    frequency = counted.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    texts = id_and_text(docs, id_col, text_col)
    found = None
    for k in range(n_indexes):
        mine = entries.filter(F.pmod("shard_key", F.lit(n_indexes)) == k)
        rows = [(r["item_id"], r["words"], r["n_question"], r["kind"]) for r in mine.orderBy("item_id", "shard_key").collect()]
        if not rows:
            continue
        own = mine.select(F.explode("words").alias("term")).distinct()
        df = {r["term"]: r["df"] for r in frequency.join(own, "term").collect()}
        index = build_index(rows, n, mean_words, df)
        # A plain tuple: executors without a copy of this package can read it.
        shared = spark.sparkContext.broadcast(tuple(getattr(index, f.name) for f in fields(Index)))
        item_type = to_arrow_type(item.schema["item_id"].dataType)
        part = cut_lineage(texts.mapInArrow(_find(shared, item_type), _FOUND.format(kind)))  # the matches only
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # An item with several entries gives one row; bridges give figures only if nothing else matches.
    columns = ("score", "question_overlap", "answer_overlap")
    whole = found.groupBy("doc_id", "item_id").agg(
        *(F.coalesce(F.max(F.when(F.col("kind") != BRIDGE, F.col(c))), F.max(c)).alias(c) for c in columns),
        F.bool_or(F.col("kind") != TAIL).alias("evidence"),
    )
    return whole.filter("evidence").drop("evidence")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match; all columns stay. Rows without an id can't be named and stay.

    Null or empty texts match nothing and stay. Rows that repeat an id go together. No rows in, none out.
    """
    name = fresh_name(docs, "_contaminated_id")
    bad = cut_lineage(contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(broadcast_if_small(bad), F.col(id_col).cast("long") == F.col(name), "left_anti")


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "item_id",
        F.round("score", 6).alias("score"),
        F.round("question_overlap", 6).alias("question_overlap"),
        F.round("answer_overlap", 6).alias("answer_overlap"),
    )
