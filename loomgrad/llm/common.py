"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import loomgrad.session  # noqa: F401  functions travel to the executors by value

WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null becomes empty): other columns cannot clash or be read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Rows of an Arrow batch of texts. At Spark's default of 10,000 a batch of 2 kB texts is 20 MB, held several
#: times by each worker and by the executor that feeds it.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use_small_batches(spark: SparkSession) -> None:
    """Have tasks pass texts in batches of BATCH_ROWS rows, unless the session asks for fewer or for another number."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a stored list of ids that are broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``stored``, a table of few narrow columns that is already written, as a broadcast if it has at most ``rows`` rows."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def unsigned_hex(value: Column) -> Column:
    """The 64 bits of a long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
