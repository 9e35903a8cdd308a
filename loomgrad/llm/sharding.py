"""Sharding by longest processing time: groups that must stay together, largest first, to the lightest shard."""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import id_and_text, read_table
from loomgrad.operators.ranking import rank_in_groups
from loomgrad.session import materialise

RANK_BUCKETS = 1024
ROW_OVERHEAD = 16


def plan_longest_first(sizes: np.ndarray, counts: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest-processing-time placement of ``counts`` groups of each of the distinct ``sizes`` on ``n_shards`` shards.

    Returns (size, start, shard) rows: groups of a size with ranks from ``start`` on, up to the next
    start of that size, go to ``shard``. The loads are those of a plain heap, which takes one group after
    the other, largest first, to the least-loaded shard: equal groups w fill the smallest of the loads
    L[s] + k * w, so a size with many groups takes all that lie under a level at once, and only the
    rest goes through the heap. The work follows sizes and shards, not groups.
    """
    loads = np.zeros(n_shards, dtype=np.int64)
    heap = [(0, s) for s in range(n_shards)]
    out_size, out_start, out_shard = array("q"), array("q"), array("i")
    order = np.argsort(-sizes, kind="stable")
    for size, count in zip(sizes[order].tolist(), counts[order].tolist(), strict=True):
        taken = [0] * n_shards
        rest = count
        if count > n_shards and size > 0:
            fits = lambda level: np.maximum(0, -((loads - level) // size))  # noqa: B023, E731  places under the level
            low, high = int(loads.min()), int(loads.max()) + size * count
            while high - low > 1 and high - low > size // 2:
                mid = (low + high) // 2
                low, high = (mid, high) if int(fits(mid).sum()) <= count else (low, mid)
            under = fits(low)
            taken, rest = under.tolist(), count - int(under.sum())
            heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(loads.tolist(), taken, strict=True))]
            heapq.heapify(heap)
        touched = {s for s in range(n_shards) if taken[s]} if rest < count else set()
        for _ in range(rest):
            load, s = heap[0]
            taken[s] += 1
            touched.add(s)
            heapq.heapreplace(heap, (load + size, s))
        start = 0
        for s in sorted(touched):
            out_size.append(size)
            out_start.append(start)
            out_shard.append(s)
            start += taken[s]
            loads[s] += taken[s] * size
    return np.array(out_size, dtype=np.int64), np.array(out_start, dtype=np.int64), np.array(out_shard, dtype=np.int32)


def shard_by_size(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, group_key, shard and slot of every row of ``docs``.

    Size: UTF-8 bytes plus 16. Rows of equal text form a group and share a shard; groups go, largest
    first, to the least-loaded shard. ``slot`` counts the rows of a shard from 0 without gaps, in an
    order that depends on ids only.

    The driver sees the histogram of exact group sizes, never groups: D distinct sizes need at least
    D * D / 2 bytes of text, so a hundred terabytes have at most 14 million of them. A size takes 16 bytes, and
    its places in the plan 20 bytes for each shard that gets groups of it, so at most ``n_shards`` times that.
    Ranks within a size and within a shard come from bucket counts, so no task holds a size or a shard.
    Texts are read once. A group larger than an even share makes its shard larger than the others: it has to stay together.

    Null text counts as empty and shares the group of empty texts. Repeated rows get a slot each.
    Rows without an id are ordered by their text. Other columns are ignored. No rows in, no rows out.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    base = materialise(
        id_and_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.unhex(F.md5("text")).alias("group_key"),
        )
    )
    groups = materialise(base.groupBy("group_key").agg(F.sum("size").alias("group_bytes")))
    histogram = groups.groupBy("group_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    planned = plan_longest_first(histogram["group_bytes"].to_numpy(), histogram["n"].to_numpy(), n_shards)
    placed = (
        spark.createDataFrame(pa.table(list(planned), names=["class_size", "start", "shard"]))
        .groupBy("class_size")  # at most one row for each shard
        .agg(F.sort_array(F.collect_list(F.struct("start", "shard"))).alias("homes"))
    )
    ranked = rank_in_groups(
        groups, ["group_bytes"], F.pmod(F.xxhash64("group_key"), F.lit(RANK_BUCKETS)), [F.col("group_key")], "group_rank"
    )
    home = F.element_at(F.filter("homes", lambda x: x["start"] <= F.col("group_rank")), -1)["shard"]
    homes = ranked.join(placed, F.col("group_bytes") == F.col("class_size")).select(F.col("group_key").alias("home_key"), home.alias("shard"))
    sharded = materialise(base.join(homes, F.col("group_key") == F.col("home_key")).drop("home_key"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("group_key")).otherwise(F.xxhash64("doc_id"))
    return rank_in_groups(
        sharded,
        ["shard"],
        F.pmod(own, F.lit(RANK_BUCKETS)),
        [F.col("doc_id"), F.col("text_crc32"), F.col("group_key")],
        "slot",
    )


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(read_table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
