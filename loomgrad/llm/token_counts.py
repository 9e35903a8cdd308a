"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrad.llm.common import read_table
from loomgrad.session import cut_lineage

#: Byte-level BPE ranks: lines of base64 token and rank. A path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into pieces before byte pairs merge (a fixed value of its format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one bucket of the suffix sums.
BUCKET = 1024
#: Characters of a text that are encoded at once. Longer texts are cut where a piece surely ends.
CHUNK_CHARS = 100_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def load_encoding(vocabulary: str, pattern: str = PATTERN):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in parts whose token counts add up to the whole's.

    A part ends before a space that stands between a letter and a letter: every piece of the pattern
    that holds such a space begins with it. Where there is none, the part goes on.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_count_column(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of each whole text; special tokens' strings are ordinary text, null counts 0.

    The vocabulary file is read by each task at its path, which every executor must have.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(vocabulary, pattern)
        for texts in batches:
            yield pd.Series(
                [0 if t is None else sum(len(encoding.encode_ordinary(c)) for c in chunks(t)) for t in texts], dtype="int64"
            )

    return count(text)


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(tokens, documents): how many rows of ``docs`` encode to each length. Exact, over whole texts.

    Null and empty texts have length 0. Repeated rows count each. No rows in, no rows out.
    """
    counted = docs.select(token_count_column(F.col(text_col).cast("string"), vocabulary).alias("tokens"))
    return counted.groupBy("tokens").agg(F.count(F.lit(1)).alias("documents"))


def context_report(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: what a context limit of L tokens means for the corpus.

    tokens, documents: the histogram. documents_longer, tokens_longer: documents of more than L tokens,
    and their tokens. tokens_within: tokens of documents of at most L. tokens_truncated: all tokens if
    each document is cut to its first L. documents_total, tokens_total: the corpus. quantile: the share
    of documents of at most L tokens. A limit between two lengths follows from the row below it.

    Suffix sums run over buckets of BUCKET lengths first, then within each, so the histogram is not
    sorted by one task. It is stored first: texts are encoded once. An empty histogram gives no rows.
    """
    rows = cut_lineage(histogram).select(
        "tokens", "documents", (F.col("tokens") * F.col("documents")).alias("mass"), F.floor(F.col("tokens") / BUCKET).alias("bucket")
    )
    per_bucket = rows.groupBy("bucket").agg(F.sum("documents").alias("d"), F.sum("mass").alias("m"))
    # One row per BUCKET lengths: a text of a billion tokens makes at most a million of them.
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bucket.select(
        "bucket",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("m").over(after), F.lit(0)).alias("m_after"),
        F.sum("d").over(every).alias("documents_total"),
        F.sum("m").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("d_in", F.coalesce(F.sum("documents").over(inside), F.lit(0))).withColumn(
        "m_in", F.coalesce(F.sum("mass").over(inside), F.lit(0))
    )
    longer, mass = F.col("d_in") + F.col("d_after"), F.col("m_in") + F.col("m_after")
    return summed.join(offsets, "bucket").select(
        "tokens",
        "documents",
        longer.alias("documents_longer"),
        mass.alias("tokens_longer"),
        (F.col("tokens_total") - mass).alias("tokens_within"),
        (F.col("tokens_total") - mass + longer * F.col("tokens")).alias("tokens_truncated"),
        "documents_total",
        "tokens_total",
        ((F.col("documents_total") - longer) / F.col("documents_total")).alias("quantile"),
    )


def quantile_lengths(report: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(share, tokens): the least length that at least that share of documents doesn't exceed."""
    return report.agg(
        *[F.min(F.when(F.col("quantile") >= q - 1e-12, F.col("tokens"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    ).select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("tokens")) for i, q in enumerate(quantiles)])).alias("r")).select("r.*")


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = context_report(length_histogram(read_table(spark, sf_dir, "documents")))
    return report.withColumn("quantile", F.round("quantile", 9))
