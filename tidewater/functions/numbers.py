"""Rounding, ratios and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 where the total is 0."""
    return F.when(total > 0, F.bround(part * 100.0 / total, 0)).otherwise(F.lit(0.0)).cast("int")


def ratio2(part: Column, total: Column) -> Column:
    """Percent to two digits; 0 where the total is 0."""
    return F.when(total > 0, F.bround(part * 100.0 / total, 2)).otherwise(F.lit(0.0))


def mean_tenths(total: Column, count: Column) -> Column:
    """Mean of tenths to one digit, halves away from zero, by whole numbers: 0-based totals are sums of tenths."""
    return F.when(count > 0, F.floor((2 * total + count) / (2 * count)).cast("double") / 10)


def truthy(value: Column) -> Column:
    """Null where a number is 0 or a string is empty, as in a chain of alternatives where these count as missing."""
    return F.when(value.cast("string").isin("", "0", "0.0", "0.00"), None).otherwise(value)


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[truthy(v) for v in values])


def decay(days: Column, rate: float = 0.01) -> Column:
    """Weight of an event so many days ago; future ones and null weigh 1."""
    return F.coalesce(F.exp(-F.lit(rate) * F.greatest(F.lit(0), days)), F.lit(1.0))


def daily_decay(score: Column, rate: float = 0.01, floor: float = 0.01) -> Column:
    return F.greatest(score * F.exp(F.lit(-rate)), F.lit(floor))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + F.lit(1e-9)
    return dot / (norm(a) * norm(b))
