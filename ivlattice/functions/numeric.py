"""Column helpers where null, NaN and infinity differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 31_536_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for an ordinary number, false for null, NaN and the infinities."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def if_finite(c: str | Column) -> Column:
    return F.when(finite(c), col(c))


def nan_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(float("nan")))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def years_between(later: str | Column, earlier: str | Column) -> Column:
    """Exact microsecond difference in years of 365 days."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6) / F.lit(YEAR_SECONDS)


def decay_weight(age_seconds: str | Column, half_life: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * col(age_seconds) / F.lit(half_life))


def bucket_index(c: str | Column, width: float) -> Column:
    """Whole-number bucket; group on it and multiply by the width afterwards."""
    return F.floor(col(c) / F.lit(width))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation at ``x`` over ascending array ``xs``; null outside or when empty."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda v: v <= x))
    lo = F.greatest(below, F.lit(1))
    hi = F.least(lo + 1, n)
    x0, x1 = F.try_element_at(xs, lo), F.try_element_at(xs, hi)
    y0, y1 = F.try_element_at(ys, lo), F.try_element_at(ys, hi)
    inside = (n > 0) & (x >= F.try_element_at(xs, F.lit(1))) & (x <= F.try_element_at(xs, F.greatest(n, F.lit(1))))
    slope = F.coalesce(F.try_divide(y1 - y0, x1 - x0), F.lit(0.0))
    return F.when(inside, y0 + (x - x0) * slope)


def interpolate_clamped(x: Column, xs: Column, ys: Column) -> Column:
    """As ``interpolate``, but flat beyond either end."""
    n = F.greatest(F.size(xs), F.lit(1))
    kept = F.least(F.greatest(x, F.try_element_at(xs, F.lit(1))), F.try_element_at(xs, n))
    return interpolate(kept, xs, ys)
