"""Numeric column functions shared by cleaning, features and scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threatspark.schemas import ANOMALY_SIGMOID_SCALE


def log1p_clipped(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value.cast("double")) == F.lit(float("inf")), F.lit(False))


def is_missing(value: Column, floating: bool) -> Column:
    return (value.isNull() | F.isnan(value)) if floating else value.isNull()


def rate(amount: Column, duration_us: Column) -> Column:
    """Amount per second; 0 for a zero duration."""
    return F.when(duration_us > 0, amount / (duration_us / F.lit(1_000_000.0))).otherwise(F.lit(0.0))


def variation(mean: Column, std: Column, sentinel: float | None = -1.0) -> Column:
    """Coefficient of variation, with a sentinel where the mean is not positive."""
    other = F.lit(sentinel).cast("double")
    return F.when(mean > 0, std / mean).otherwise(other)


def anomaly_probability(score: Column, threshold: float, scale: float = ANOMALY_SIGMOID_SCALE) -> Column:
    """Raw score (lower is stranger) to [0, 1]; 0.5 at the threshold."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(threshold) - score) / F.lit(scale)))
