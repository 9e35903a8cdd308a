"""Exact deduplication by 128-bit content hash with a byte comparison (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import WHITE_SPACE, broadcast_if_small, id_and_text, read_table
from loomgrad.session import materialise


def content_hash_128(normalised: Column) -> Column:
    return F.unhex(F.md5(normalised))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = content_hash_128,
) -> DataFrame:
    """One row per input row: its group of equal texts and the row of it that stays.

    Texts are equal when identical after deleting white space. Rows are grouped by the content hash
    *and* the bytes themselves, so the hash decides where rows meet and the bytes decide whether they
    are equal: colliding hashes never merge texts. The longest original (code points), then the
    smallest id stays.

    Skew: digests of the rows are stored, and only texts whose hash repeats are compared. While the list
    of those hashes is short it is broadcast, and unique texts never move; a longer one is joined. Copies
    collapse before the shuffle (partial aggregation), and the answer returns to the rows by a join on
    short digests, whose hot keys adaptive execution splits.

    Null text counts as empty; all empty texts form one group. A null id loses against any other id.
    Rows that repeat both the id and the length of the row that stays are all marked kept. Other
    columns are ignored. No rows in, no rows out.
    """
    base = id_and_text(docs, id_col, text_col)
    normal = base.select("doc_id", F.length("text").alias("n_chars"), F.translate("text", WHITE_SPACE, "").alias("normal"))
    digest = F.unhex(F.sha2("normal", 256)).alias("sha")
    keyed = normal.withColumn("h", content_hash(F.col("normal")))
    rows = materialise(keyed.select("doc_id", "n_chars", "h", digest))
    repeated = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("h"))
    by_bytes = (
        keyed.join(broadcast_if_small(repeated), "h", "left_semi")
        .groupBy("h", "normal", "n_chars")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    )
    groups = (
        by_bytes.select("h", digest, "n_chars", "n", "first_id")
        .groupBy("h", "sha")
        .agg(
            F.sum("n").alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("first_id").isNull().alias("b"), F.col("first_id").alias("c"))).alias("best"),
        )
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["h", "sha"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("best.c")) & (F.col("n_chars") == -F.col("best.a")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
