"""Learning tables built from the given tables, and the same tables as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.operators.validate import assemble


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression: the value of an order from its lines. Lines are grouped before the join."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"),
        F.count(F.lit(1)).alias("lines"),
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    features = [F.col("qty") / 100, F.col("price") / 100000, F.col("discount") * 10, F.col("lines") / 4]
    return assemble(joined, features, F.col("o_totalprice") / 100000, "o_orderkey")


ORDER_VALUE_SQL = """
SELECT o_orderkey AS id, o_totalprice / 100000 AS target, qty / 100 AS x0, price / 100000 AS x1, discount * 10 AS x2, lines::DOUBLE / 4 AS x3
FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, avg(l_discount) AS discount, count(*) AS lines
                  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


def doc_label(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Binary, imbalanced: a document's label from its length, words, mean word length and lines."""
    words = F.length("text") - F.length(F.translate("text", " ", "")) + 1
    documents = _read(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", words.alias("words"), (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("lines")
    )
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), F.col(label).alias("label"))
    joined = labels.join(documents, F.col("labelled") == F.col("doc_id"))
    features = [F.col("n_chars") / 1000, F.col("words") / 100, F.col("n_chars") / F.col("words") / 10, F.col("lines") / 10]
    return assemble(joined, features, "label", "doc_id")


def doc_label_sql(label: str = "quality") -> str:
    return f"""
SELECT doc_id AS id, label::DOUBLE AS target, n_chars::DOUBLE / 1000 AS x0, words::DOUBLE / 100 AS x1, n_chars::DOUBLE / words / 10 AS x2, lines::DOUBLE / 10 AS x3
FROM (SELECT d.doc_id, n_chars, length(text) - length(replace(text, ' ', '')) + 1 AS words,
             length(text) - length(replace(text, chr(10), '')) AS lines, {label} AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def vec_label(spark: SparkSession, sf_dir: str, features: int = 64) -> DataFrame:
    """Wide: whether an embedding has label 3."""
    rows = _read(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"),
        F.slice(F.col("embedding").cast("array<double>"), 1, features).alias("features"),
        (F.col("label") == 3).cast("double").alias("target"),
    )


def vec_label_sql(features: int) -> str:
    columns = ", ".join(f"embedding[{j + 1}]::DOUBLE AS x{j}" for j in range(features))
    return f"SELECT vec_id AS id, (label = 3)::INT::DOUBLE AS target, {columns} FROM embeddings"


def event_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large and narrow: whether an event is an error."""
    rows = _read(spark, sf_dir, "events")
    features = [F.col("value") / 100, F.hour("ts") / 24, (F.col("user_id") % 10) / 10]
    return assemble(rows, features, (F.col("event_type") == "error").cast("double"), "event_id")


EVENT_FLAG_SQL = """
SELECT event_id AS id, (event_type = 'error')::INT::DOUBLE AS target, value / 100 AS x0, hour(ts)::DOUBLE / 24 AS x1, (user_id % 10)::DOUBLE / 10 AS x2
FROM events"""
