"""Scores, ratios and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    c = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def importance(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(3)), F.lit(1)), F.lit(5))


def ratio_or_percent(c: Column) -> Column:
    """Numbers over 1 and up to 100 are percent; the rest is clamped."""
    return clamp(F.when((c > 1) & (c <= 100), c / 100).otherwise(c))


def level(c: Column) -> Column:
    r = ratio_or_percent(c)
    return F.when(r >= 0.85, "excellent").when(r >= 0.7, "strong").when(r >= 0.5, "moderate").when(r >= 0.3, "weak").otherwise("low")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid_vector(a: Column, size: int) -> Column:
    """Of the right length, finite throughout and not zero."""
    return F.coalesce((F.size(a) == size) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(a, lambda x: x != 0), F.lit(False))


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("double") / norm(a)).cast("float"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.timestamp_diff("MILLISECOND", start, end), F.lit(0))
