"""Scalar building blocks: presence, safe arithmetic, bands and quantisers. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def clean(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(present(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or anything is missing."""
    return F.when(b != 0, F.try_divide(a, b))


def band(v: Column, lo: float, hi: float) -> Column:
    """0..100 across [lo, hi], clamped; falling where hi < lo; 50 where they are equal; NULL where v is missing."""
    if lo == hi:
        return F.when(present(v), F.lit(50.0))
    return F.when(present(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))) * 100)


def mean_present(*cs: Column) -> Column:
    """Mean of the values that are there; NULL if none is."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.when(n > 0, total / n)


def weighted_present(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean with the weights renormalised over the parts that are there; NULL where none weighs."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def log_band(v: Column, width: float) -> Column:
    """Number of the multiplicative band of a positive value."""
    return F.when(v > 0, F.floor(F.log(v) / F.log(F.lit(1 + width))))


def step(v: Column, size: float) -> Column:
    return F.round(v / size) * size


def three_figures(v: Column) -> Column:
    """Rounded to three significant figures."""
    power = F.pow(F.lit(10.0), 2 - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).when(v.isNotNull(), F.round(v * power) / power)


def fraction(percent: Column) -> Column:
    return percent / 100


def age_days(as_of: Column, at: Column) -> Column:
    return F.datediff(F.to_date(as_of), F.to_date(at))
