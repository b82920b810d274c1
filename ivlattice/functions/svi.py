"""Raw SVI total variance and its no-arbitrage function as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ivlattice.functions.numeric import finite

FLOOR = 1e-12


def total_variance(k: Column, a: Column, b: Column, rho: Column, m: Column, sigma: Column) -> Column:
    return a + b * (rho * (k - m) + F.sqrt((k - m) * (k - m) + sigma * sigma))


def durrleman(k: Column, a: Column, b: Column, rho: Column, m: Column, sigma: Column) -> Column:
    """g(k); a slice is free of butterfly arbitrage where it is not negative."""
    r = F.sqrt((k - m) * (k - m) + sigma * sigma)
    w = F.greatest(total_variance(k, a, b, rho, m, sigma), F.lit(FLOOR))
    first = b * (rho + (k - m) / r)
    second = b * sigma * sigma / (r * r * r)
    return (1 - k * first / (2 * w)) * (1 - k * first / (2 * w)) - first * first / 4 * (1 / w + 0.25) + second / 2


def in_domain(a: Column, b: Column, rho: Column, m: Column, sigma: Column) -> Column:
    ok = finite(a) & finite(b) & finite(rho) & finite(m) & finite(sigma)
    return ok & (b >= 0) & (F.abs(rho) < 1) & (sigma > 0) & (a + b * sigma * F.sqrt(1 - rho * rho) >= -FLOOR)


def from_ssvi(theta: Column, rho: Column, phi: Column) -> Column:
    """struct<a, b, rho, m, sigma> of an SSVI slice."""
    return F.struct(
        (theta * (1 - rho * rho) / 2).alias("a"),
        (theta * phi / 2).alias("b"),
        rho.alias("rho"),
        (-rho / phi).alias("m"),
        (F.sqrt(1 - rho * rho) / phi).alias("sigma"),
    )
