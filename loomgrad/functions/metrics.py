"""Regression and classification metrics as aggregates, optionally per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAMP = 1e-12


def mse(prediction: Column, target: Column) -> Column:
    return F.avg(F.pow(prediction - target, F.lit(2.0)))


def rmse(prediction: Column, target: Column) -> Column:
    return F.sqrt(mse(prediction, target))


def mae(prediction: Column, target: Column) -> Column:
    return F.avg(F.abs(prediction - target))


def r_squared(prediction: Column, target: Column) -> Column:
    """1 - residual / total sum of squares; 0 where all targets are equal."""
    total = F.var_pop(target) * F.count(target)
    return F.when(F.min(target) == F.max(target), 0.0).otherwise(
        F.lit(1.0) - F.sum(F.pow(target - prediction, F.lit(2.0))) / F.nullif(total, F.lit(0.0))
    )


def within_tolerance_ratio(prediction: Column, target: Column, tolerance: float = 0.1) -> Column:
    """Share of rows with |p - t| <= tolerance * max(|t|, 1)."""
    if not math.isfinite(tolerance) or tolerance < 0:
        raise ValueError("the tolerance must be finite and not negative")
    near = F.abs(prediction - target) <= F.lit(float(tolerance)) * F.greatest(F.abs(target), F.lit(1.0))
    return F.avg(near.cast("double"))


def binary_cross_entropy(probability: Column, target: Column) -> Column:
    """Mean over rows, probabilities clamped away from 0 and 1."""
    p = F.greatest(F.lit(CLAMP), F.least(F.lit(1.0 - CLAMP), probability))
    return F.avg(-(target * F.ln(p) + (F.lit(1.0) - target) * F.ln(F.lit(1.0) - p)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def class_rates(predicted: Column, expected: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1_score of two boolean columns; a rate without rows is 0."""
    tp, fp = F.count_if(predicted & expected), F.count_if(predicted & ~expected)
    fn, n = F.count_if(~predicted & expected), F.count(F.lit(1))
    # 2PR / (P + R) equals 2TP / (2TP + FP + FN), and both are 0 without true positives.
    return {
        "accuracy": _ratio(F.count_if(predicted == expected), n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def _aggregate(df: DataFrame, group_cols: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    if group_cols:
        return df.groupBy(*group_cols).agg(*[c.alias(name) for name, c in metrics.items()])
    no_rows = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("metrics need at least one row")).cast("double"))
    return df.agg(*[F.coalesce(no_rows, c).alias(name) for name, c in metrics.items()])


def regression_metrics(
    df: DataFrame, prediction: str = "prediction", target: str = "target", tolerance: float = 0.1, group_cols: Sequence[str] = ()
) -> DataFrame:
    """mse, rmse, mae, r_squared, within_tolerance_ratio: one row, or one per group. No rows: an error."""
    p, t = F.col(prediction), F.col(target)
    metrics = {
        "mse": mse(p, t),
        "rmse": rmse(p, t),
        "mae": mae(p, t),
        "r_squared": r_squared(p, t),
        "within_tolerance_ratio": within_tolerance_ratio(p, t, tolerance),
    }
    return _aggregate(df, group_cols, metrics)


def binary_metrics(
    df: DataFrame, probability: str = "probability", target: str = "target", threshold: float = 0.5, group_cols: Sequence[str] = ()
) -> DataFrame:
    """binary_cross_entropy, accuracy, precision, recall, f1_score: one row, or one per group.

    A row is predicted positive at ``threshold``; it is expected positive at 0.5. No rows: an error.
    """
    p, t = F.col(probability), F.col(target)
    rates = class_rates(p >= F.lit(float(threshold)), t >= 0.5)
    return _aggregate(df, group_cols, {"binary_cross_entropy": binary_cross_entropy(p, t), **rates})


METRIC_COLUMNS = ("binary_cross_entropy", "accuracy", "precision", "recall", "f1_score")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str] = METRIC_COLUMNS, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """folds, and mean and sample standard deviation (0 for one fold) of each metric."""
    parts = [F.count(F.lit(1)).alias("folds")]
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return per_fold.groupBy(*group_cols).agg(*parts)
