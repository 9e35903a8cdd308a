"""Assembling and validating labelled tables: id bigint, features array<double>, target double."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgrad.functions.vectors import array_is_finite, is_finite


def assemble(df: DataFrame, feature_cols: Sequence[str | Column], target_col: str | Column, id_col: str | Column) -> DataFrame:
    """id, features, target from named columns or expressions; numbers are cast to double."""
    if not feature_cols:
        raise ValueError("at least one feature column is needed")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_column(id_col).cast("bigint").alias("id"),
        F.array(*[as_column(c).cast("double") for c in feature_cols]).alias("features"),
        as_column(target_col).cast("double").alias("target"),
    )


def drop_feature(df: DataFrame, position: int) -> DataFrame:
    """``df`` without the feature at ``position`` (from 0)."""
    if position < 0:
        raise ValueError("the position must not be negative")
    return df.withColumn("features", F.filter("features", lambda x, i: i != position))


@dataclass(frozen=True)
class TableFacts:
    rows: int
    features: int


def fact_columns() -> list[Column]:
    """What :func:`check_facts` needs, as aggregates: they fit into any pass over the table."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("features")).alias("least_features"),
        F.max(F.size("features")).alias("most_features"),
        F.count_if(~array_is_finite(F.col("features"))).alias("bad_features"),
        F.count_if(~is_finite(F.col("target"))).alias("bad_targets"),
        F.count_if(~F.coalesce(F.col("target").isin(0.0, 1.0), F.lit(False))).alias("not_binary"),
    ]


def table_facts(df: DataFrame) -> DataFrame:
    """One row: n_rows, least and most features, rows with a bad feature or target, targets not 0 or 1."""
    return df.agg(*fact_columns())


def validate_training_table(df: DataFrame, binary: bool = False, caller: str = "fit") -> TableFacts:
    """Raise ValueError unless the table is fit for training; one aggregate for all checks.

    Needed: rows, equally many features (at least one) in all of them, and no null, NaN or infinite
    value; with ``binary`` also targets of 0 or 1 only.
    """
    return check_facts(table_facts(df).first(), binary, caller)


def check_facts(facts: Row, binary: bool = False, caller: str = "fit") -> TableFacts:
    """As :func:`validate_training_table`, of :func:`fact_columns` that are already there."""
    if not facts["n_rows"]:
        raise ValueError(f"{caller}: the table is empty")
    if facts["least_features"] is None or facts["least_features"] < 1:
        raise ValueError(f"{caller}: every row needs at least one feature")
    if facts["least_features"] != facts["most_features"]:
        raise ValueError(f"{caller}: rows have {facts['least_features']} to {facts['most_features']} features")
    if facts["bad_features"] or facts["bad_targets"]:
        raise ValueError(f"{caller}: {facts['bad_features']} rows have a feature and {facts['bad_targets']} a target that isn't finite")
    if binary and facts["not_binary"]:
        raise ValueError(f"{caller}: {facts['not_binary']} targets are neither 0 nor 1")
    return TableFacts(facts["n_rows"], facts["least_features"])


def class_profile(df: DataFrame, target: str = "target") -> DataFrame:
    """rows, positives (target >= 0.5), positive_rate and the accuracy of always saying the larger class 0."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target) >= 0.5).alias("positives"))
    rate = F.col("positives") / F.nullif(F.col("n_rows"), F.lit(0))
    return counted.select("n_rows", "positives", rate.alias("positive_rate"), (F.lit(1.0) - rate).alias("majority_accuracy"))


def check_threshold(threshold: float) -> float:
    if not math.isfinite(threshold) or not 0.0 < threshold < 1.0:
        raise ValueError("the threshold must lie between 0 and 1, both excluded")
    return float(threshold)


def classify(probability: Column, threshold: float = 0.5) -> Column:
    """Whether the probability reaches the threshold."""
    return probability >= F.lit(check_threshold(threshold))
