"""Black-76 on forwards, as columns (whole-stage codegen) and as NumPy for Arrow kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ivlattice.functions.numeric import finite

# The published double-precision rational form of the normal CDF (Hart 1968, West 2005).
CDF_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631000502
DEGENERATE = 1e-12
PRICE_SLACK = 1e-8


def _horner(x, coefficients):
    acc = None
    for c in coefficients:
        acc = c if acc is None else acc * x + c
    return acc


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(SQRT_TWO_PI)


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    lit = lambda cs: [F.lit(c) for c in cs]
    near = e * _horner(a, lit(CDF_NUMERATOR)) / _horner(a, lit(CDF_DENOMINATOR))
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))) / F.lit(SQRT_TWO_PI)
    tail = F.when(a > 37, F.lit(0.0)).when(a < CDF_SPLIT, near).otherwise(far)
    return F.when(F.isnan(x), x).when(x > 0, 1 - tail).otherwise(tail)


def _terms(f: Column, k: Column, t: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    dead = (t <= DEGENERATE) | (v <= DEGENERATE)
    s = F.when(~dead, v * F.sqrt(t))
    d1 = F.log(F.try_divide(f, k)) / s + s / 2
    return dead, s, d1, d1 - s


def price(f: Column, k: Column, t: Column, v: Column, cp: Column, r: float = 0.0) -> Column:
    """Price of a call (cp = 1) or put (cp = -1); intrinsic at the bounds; fails on F or K <= 0."""
    dead, _, d1, d2 = _terms(f, k, t, v)
    disc = F.exp(F.lit(-r) * t)
    live = disc * cp * (f * norm_cdf(cp * d1) - k * norm_cdf(cp * d2))
    intrinsic = disc * F.greatest(cp * (f - k), F.lit(0.0))
    return F.when((f <= 0) | (k <= 0), F.raise_error(F.lit("forward and strike must be positive")).cast("double")).when(dead, intrinsic).otherwise(live)


def vega(f: Column, k: Column, t: Column, v: Column, r: float = 0.0) -> Column:
    dead, _, d1, _ = _terms(f, k, t, v)
    return F.when(dead, F.lit(0.0)).otherwise(F.exp(F.lit(-r) * t) * f * norm_pdf(d1) * F.sqrt(t))


def delta(f: Column, k: Column, t: Column, v: Column, cp: Column, r: float = 0.0) -> Column:
    dead, _, d1, _ = _terms(f, k, t, v)
    return F.when(dead, F.when(cp * (f - k) > 0, cp.cast("double")).otherwise(F.lit(0.0))).otherwise(F.exp(F.lit(-r) * t) * cp * norm_cdf(cp * d1))


def priced(df: DataFrame, f: str, k: str, t: str, v: str, cp: str, r: float = 0.0) -> DataFrame:
    """``df`` with price, delta, gamma, vega and theta, computed in steps.

    Each step is a projection of its own, so that shared terms are computed once and
    the generated code stays small; null where an input is not a positive number.
    """
    c = F.col
    good = finite(f) & finite(k) & finite(t) & finite(v) & (c(f) > 0) & (c(k) > 0)
    out = df.withColumns({"__dead": (c(t) <= DEGENERATE) | (c(v) <= DEGENERATE), "__good": good, "__disc": F.exp(F.lit(-r) * c(t))})
    out = out.withColumn("__s", F.when(c("__good") & ~c("__dead"), c(v) * F.sqrt(c(t))))
    out = out.withColumn("__d1", F.when(c("__s").isNotNull(), F.log(c(f) / c(k)) / c("__s") + c("__s") / 2))
    out = out.withColumns({"__x1": c(cp) * c("__d1"), "__x2": c(cp) * (c("__d1") - c("__s")), "__pdf": norm_pdf(c("__d1"))})
    out = out.withColumns({"__n1": norm_cdf(c("__x1")), "__n2": norm_cdf(c("__x2"))})
    money = c(cp) * (c(f) - c(k))
    zero = F.lit(0.0)
    live = lambda x, dead: F.when(c("__good") & c("__dead"), dead).when(c("__good"), x)
    out = out.withColumns(
        {
            "price": live(c("__disc") * c(cp) * (c(f) * c("__n1") - c(k) * c("__n2")), c("__disc") * F.greatest(money, zero)),
            "delta": live(c("__disc") * c(cp) * c("__n1"), F.when(money > 0, c(cp).cast("double")).otherwise(zero)),
            "gamma": live(c("__disc") * c("__pdf") / (c(f) * c("__s")), zero),
            "vega": live(c("__disc") * c(f) * c("__pdf") * F.sqrt(c(t)), zero),
        }
    )
    theta = -c("__disc") * c(f) * c("__pdf") * c(v) / (2 * F.sqrt(c(t))) + F.lit(r) * c("price")
    return out.withColumn("theta", live(theta, zero)).drop("__dead", "__good", "__disc", "__s", "__d1", "__x1", "__x2", "__pdf", "__n1", "__n2")


# ---- NumPy twins, for kernels that already run on Arrow batches ----


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    with np.errstate(all="ignore"):
        e = np.exp(-a * a / 2)
        near = e * _horner(a, CDF_NUMERATOR) / _horner(a, CDF_DENOMINATOR)
        far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / SQRT_TWO_PI
    tail = np.where(a > 37, 0.0, np.where(a < CDF_SPLIT, near, far))
    return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - tail, tail))


def np_price(f, k, t, v, cp, r: float = 0.0) -> np.ndarray:
    f, k, t, v, cp = np.broadcast_arrays(*(np.asarray(a, float) for a in (f, k, t, v, cp)))
    with np.errstate(all="ignore"):
        disc = np.exp(-r * t)
        dead = (t <= DEGENERATE) | (v <= DEGENERATE)
        s = np.where(dead, np.nan, v * np.sqrt(np.maximum(t, 0)))
        d1 = np.log(f / k) / s + s / 2
        live = disc * cp * (f * np_norm_cdf(cp * d1) - k * np_norm_cdf(cp * (d1 - s)))
    return np.where(dead, disc * np.maximum(cp * (f - k), 0.0), live)


def np_implied_vol(p, f, k, t, cp, r: float = 0.0) -> np.ndarray:
    """Implied volatility of many prices at once, by bracketed bisection with Newton steps.

    NaN where an input is not finite, F, K or t is not positive or the price is
    outside its bounds; exactly 0 at or below intrinsic value.
    """
    p, f, k, t, cp = np.broadcast_arrays(*(np.atleast_1d(np.asarray(a, float)) for a in (p, f, k, t, cp)))
    with np.errstate(all="ignore"):
        disc = np.exp(-r * t)
        intrinsic = disc * np.maximum(cp * (f - k), 0.0)
        upper = disc * np.where(cp > 0, f, k)
        bad = ~np.isfinite(p + f + k + t + cp) | (f <= 0) | (k <= 0) | (t <= DEGENERATE) | (p < intrinsic - PRICE_SLACK) | (p > upper + PRICE_SLACK)
        flat = ~bad & (p <= intrinsic + PRICE_SLACK)
        out = np.where(flat, 0.0, np.nan)
        todo = np.flatnonzero(~bad & ~flat)
        if not len(todo):
            return out
        p, f, k, t, cp = (a[todo] for a in (p, f, k, t, cp))
        lo, hi = np.full(len(todo), DEGENERATE), np.full(len(todo), 5.0)
        for _ in range(10):
            short = np_price(f, k, t, hi, cp, r) < p
            if not short.any():
                break
            hi = np.where(short, hi * 2, hi)
        reached = np_price(f, k, t, hi, cp, r) >= p
        x = (lo + hi) / 2
        for _ in range(80):
            gap = np_price(f, k, t, x, cp, r) - p
            lo, hi = np.where(gap < 0, x, lo), np.where(gap < 0, hi, x)
            s = x * np.sqrt(t)
            slope = np.exp(-r * t) * f * np.exp(-((np.log(f / k) / s + s / 2) ** 2) / 2) / SQRT_TWO_PI * np.sqrt(t)
            step = x - gap / slope
            step = np.where(np.isfinite(step) & (step > lo) & (step < hi), step, (lo + hi) / 2)
            if np.max(np.abs(step - x)) < 1e-13:
                x = step
                break
            x = step
        out[todo] = np.where(reached, x, np.nan)
    return out


def implied_vol_udf():
    """Arrow-batched implied volatility: (price, F, K, t, cp) -> double."""
    @F.pandas_udf("double")
    def implied_vol(p: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, cp: pd.Series) -> pd.Series:
        return pd.Series(np_implied_vol(p, f, k, t, cp))

    return implied_vol
