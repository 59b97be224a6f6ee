"""Scalar mathematics of complexities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column | float, width: float) -> Column:
    """Whole widths in the distance of two values."""
    return F.floor(F.abs(a - b) / width).cast("bigint")


def rescaled(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """Linear map of one range onto another; the lower end where the first is a point."""
    return F.coalesce(to_low + F.try_divide((x - low) * (to_high - to_low), high - low), to_low)


def rescaled_by_mean(x: Column, top: Column, low: Column, mean: Column, high: Column) -> Column:
    """0..top onto low..high so that the middle meets the mean: two lines."""
    half = top / 2
    return F.when(x <= half, low + (mean - low) * x / half).otherwise(mean + (high - mean) * (x - half) / half)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def control_flow_complexity(concepts: Column, steps: Column, suffix: Column) -> Column:
    """Fixed coefficients of the linear model, then a sigmoid, to four places."""
    x = F.lit(0.39399354) + 0.16434003 * (concepts + 2) + 0.01391854 * steps + 0.05685927 * (F.length(suffix) + 1)
    return F.round(sigmoid((x - 2) * 5), 4)


def expression_complexity(length: Column, violations: Column) -> Column:
    """Fixed coefficients; not rounded."""
    return 1 / (1 + F.exp(-(0.18549906 * length - 0.01883239 * violations)))
