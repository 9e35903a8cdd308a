"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of documents.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages are written
as Parquet into the shared checkpoint folder and read again, so a lost executor never repeats one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrad.llm import decontamination, language_id, mixing, sharding, simhash
from loomgrad.llm.common import BATCH_SETTING, read_table, use_small_batches
from loomgrad.session import materialise

N_SHARDS = 40
#: Near the observed mixture: rare sources, languages and layouts gain a little.
MIX_TEMPERATURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` as predicted; later stages mix by that.

    Profiles and least scores are counted from every labelled row. Null or letterless texts go;
    repeated rows and rows without an id are judged alike; a table without labels identifies nothing, so
    all goes; an empty table stays empty.
    """
    use_small_batches(spark)
    return language_id.keep_recognised(docs, "lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of similar five-word shingle sets (0.8 or more).

    Null, empty and wordless texts are copies of each other; of rows that repeat an id one stays; rows
    without an id stay; an empty table stays empty.
    """
    use_small_batches(spark)
    return simhash.keep_one_per_component(docs, shingle_words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null or empty texts hold none and stay, as do rows without an id; an empty table, or an empty
    benchmark, changes nothing.
    """
    use_small_batches(spark)
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic weights.

    Null margins are a value of their own; null or empty texts hold no tokens and go; rows that repeat an
    id are sampled together; an empty table stays empty.
    """
    return mixing.sample_to_targets(docs, MIX_TEMPERATURE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, shard and slot of every remaining document.

    Null texts count as empty; every repeated row gets a slot; rows without an id are ordered by their text; no rows in, no rows out.
    """
    return sharding.shard_by_size(docs, N_SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages use n-gram ranks, SimHash components, BM25 and a placement heap: none is plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, batch_rows = read_table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(BATCH_SETTING, batch_rows)  # the stages above have ended, and the last one needs no small batches
    return STAGES[-1][1](spark, docs, sf_dir)
