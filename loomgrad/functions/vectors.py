"""Expressions over the ``features`` array: guards, affine maps and linear outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many features are written out one by one (generated code); more use higher-order functions.
UNROLLED = 64


def is_finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def array_is_finite(values: Column) -> Column:
    return F.coalesce(F.forall(values, is_finite), F.lit(False))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def checked(features: Column, n_features: int) -> Column:
    """``features``, or an error at run time where the count is wrong or a value isn't finite."""
    good = (F.size(features) == n_features) & array_is_finite(features)
    message = F.lit(f"scoring needs {n_features} finite features in every row")
    return F.when(F.coalesce(good, F.lit(False)), features).otherwise(F.raise_error(message).cast("array<double>"))


def affine(features: Column, base: Sequence[float], centre: Sequence[float], factor: Sequence[float], scale: Sequence[float]) -> Column:
    """base + (x - centre) * factor / scale of each feature."""
    if len(base) <= UNROLLED:
        return F.array(
            *[
                F.lit(float(b)) + (features[j] - F.lit(float(c))) * F.lit(float(f)) / F.lit(float(s))
                for j, (b, c, f, s) in enumerate(zip(base, centre, factor, scale, strict=True))
            ]
        )
    rows = F.arrays_zip(
        features.alias("x"), literal_array(base).alias("b"), literal_array(centre).alias("c"), literal_array(factor).alias("f"), literal_array(scale).alias("s")
    )
    return F.transform(rows, lambda r: r["b"] + (r["x"] - r["c"]) * r["f"] / r["s"])


def linear_output(features: Column, weights: Sequence[float], bias: float) -> Column:
    """bias + sum of weight * feature; an error at run time if the result isn't finite."""
    if len(weights) <= UNROLLED:
        z = F.lit(float(bias))
        for j, w in enumerate(weights):
            z = z + F.lit(float(w)) * features[j]
    else:
        products = F.zip_with(features, literal_array(weights), lambda x, w: x * w)
        z = F.aggregate(products, F.lit(float(bias)), lambda total, p: total + p)
    return F.when(is_finite(z), z).otherwise(F.raise_error(F.lit("the linear output isn't finite")).cast("double"))
