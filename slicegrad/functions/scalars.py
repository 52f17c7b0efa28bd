"""Numeric column expressions used by the losses and activations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log1pexp(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow for large positive ``x``."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def signed_label(label: Column) -> Column:
    """Map a label from {0, 1} to {-1, +1}."""
    return F.lit(2.0) * label - F.lit(1.0)


def logistic_coef(score: Column, label: Column) -> Column:
    """Derivative of the logistic loss with respect to the score."""
    y = signed_label(label)
    return -y / (F.lit(1.0) + F.exp(y * score))


def hinge_coef(score: Column, label: Column) -> Column:
    """Subgradient of the hinge loss; active only where the margin is strictly below one."""
    y = signed_label(label)
    return F.when(y * score < 1.0, -y).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dsigmoid(activation: Column) -> Column:
    """Derivative of the sigmoid, given the activation (not its input)."""
    return activation * (F.lit(1.0) - activation)


def total(columns: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, columns)


def largest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def softmax_stages(names: list[str]) -> list[dict[str, Column]]:
    """Projections to make before the softmax of the columns ``names``: maximum, shifted powers, norm.

    Each is used by many later columns, so each is a projection of its own; written out in place they would be repeated
    in every class, and the expression would grow with the cube of their number.
    """
    powers = [f"_power{k}" for k in range(len(names))]
    return [
        {"_top": largest([F.col(name) for name in names])},
        {power: F.exp(F.col(name) - F.col("_top")) for power, name in zip(powers, names)},
        {"_norm": total([F.col(power) for power in powers])},
    ]


def staged(df: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    """``df`` with the columns of each stage added, one projection after the other."""
    return reduce(DataFrame.withColumns, stages, df)


def softmax(classes: int) -> list[Column]:
    """Softmax after :func:`softmax_stages`; shifted by the row maximum so it cannot overflow."""
    return [F.col(f"_power{k}") / F.col("_norm") for k in range(classes)]


def log_sum_exp() -> Column:
    """Logarithm of the sum of powers, after :func:`softmax_stages`."""
    return F.col("_top") + F.log("_norm")


def pick(columns: list[Column], label: Column) -> Column:
    """The column whose position equals ``label``, a chain of one test per column."""
    choice = F.when(label == 0, columns[0])
    for position, column in enumerate(columns[1:], start=1):
        choice = choice.when(label == position, column)
    return choice
