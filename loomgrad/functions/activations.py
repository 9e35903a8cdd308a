"""Activations, their derivatives and the cross-entropy of a logit, as column expressions on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one() -> Column:
    return F.lit(1.0)


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow on either side."""
    return F.when(z >= 0, _one() / (_one() + F.exp(-z))).otherwise(F.exp(z) / (_one() + F.exp(z)))


def sigmoid_derivative(output: Column) -> Column:
    """From the sigmoid's output."""
    return output * (_one() - output)


def tanh(z: Column) -> Column:
    return F.tanh(z)


def tanh_derivative(output: Column) -> Column:
    """From the output of tanh."""
    return _one() - output * output


def relu(z: Column) -> Column:
    return F.greatest(F.lit(0.0), z)


def relu_derivative(z: Column) -> Column:
    """From the input."""
    return F.when(z > 0, 1.0).otherwise(0.0)


def leaky_relu(z: Column, slope: float = 0.01) -> Column:
    return F.when(z > 0, z).otherwise(F.lit(float(slope)) * z)


def leaky_relu_derivative(z: Column, slope: float = 0.01) -> Column:
    return F.when(z > 0, 1.0).otherwise(F.lit(float(slope)))


def prelu(z: Column, alpha: float | Column) -> Column:
    """The slope left of zero is required; it may be a column."""
    return F.when(z > 0, z).otherwise((alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * z)


def prelu_derivative(z: Column, alpha: float | Column) -> Column:
    return F.when(z > 0, 1.0).otherwise(alpha if isinstance(alpha, Column) else F.lit(float(alpha)))


def elu(z: Column, alpha: float = 1.0) -> Column:
    return F.when(z > 0, z).otherwise(F.lit(float(alpha)) * (F.exp(z) - 1.0))


def elu_derivative(z: Column, output: Column, alpha: float = 1.0) -> Column:
    """From the input and the output."""
    return F.when(z > 0, 1.0).otherwise(output + F.lit(float(alpha)))


def bce_from_logit(z: Column, target: Column) -> Column:
    """Binary cross-entropy of sigmoid(z) against the target, without computing the sigmoid."""
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))
