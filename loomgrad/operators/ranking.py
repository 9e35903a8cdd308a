"""Exact ranks within groups when one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "rank",
    bucket_leads: bool = True,
) -> DataFrame:
    """Add ``out``: the gapless rank (from 0) of each row among the rows with equal ``keys``.

    A plain ``row_number`` over a large group is one task. Here each group is cut by ``bucket``;
    the few counts per (group, bucket) give every bucket its offset, and ``row_number`` runs inside
    (group, bucket) only. With ``bucket_leads`` the resulting order is (bucket, order), equal to a
    plain ``row_number`` over those columns. Null keys form a group of their own.
    """
    keys = list(keys)
    marked = df.withColumn("_lg_bucket", bucket)
    counts = marked.groupBy(*keys, "_lg_bucket").agg(F.count(F.lit(1)).alias("_lg_n"))
    before = Window.partitionBy(*keys).orderBy("_lg_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_lg_k{i}") for i, k in enumerate(keys)],
        F.col("_lg_bucket").alias("_lg_b"),
        F.coalesce(F.sum("_lg_n").over(before), F.lit(0)).alias("_lg_offset"),
    )
    within = Window.partitionBy(*keys, "_lg_bucket").orderBy(*order)
    ranked = marked.withColumn("_lg_row", F.row_number().over(within) - 1)
    same = F.col("_lg_bucket").eqNullSafe(F.col("_lg_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_lg_k{i}"))
    joined = ranked.join(offsets, same)
    return joined.withColumn(out, (F.col("_lg_row") + F.col("_lg_offset")).cast("long")).drop(
        "_lg_row", "_lg_offset", "_lg_bucket", "_lg_b", *[f"_lg_k{i}" for i in range(len(keys))]
    )
