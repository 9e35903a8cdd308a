"""Small tables with the hard cases, and brute-force forms of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor sit amet " * 4000


def edge_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, 1, "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, 1, "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, 1, "x"),
        (3, "", "en", None, 0, None, None),
        (4, None, None, None, None, None, None),
        (None, "a text without an id", "en", "b", 20, 2, "y"),
        (None, None, None, None, None, None, None),
        (5, " \t\n\x0b\x0c\r ", "fr", "b", 7, 3, "z"),
        (6, LONG, "en", "c", len(LONG), 4, "w"),
        (7, LONG, "en", "c", len(LONG), 4, "w"),
        (8, "one", "de", "c", 3, 5, "v"),
        (9, "naïve café über señor 東京 😀", "es", "d", 24, 6, "u"),
        (10, "12345 67890 !!! ???", "en", "d", 19, 7, "t"),
        (-11, "a b c d the quick brown fox", "en", "d", 19, 7, "t"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, fp string"
    )


def empty_documents(spark: SparkSession) -> DataFrame:
    return edge_documents(spark).limit(0)


def documents(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
