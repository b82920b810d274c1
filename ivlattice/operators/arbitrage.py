"""Static-arbitrage checks of variance grids with window functions, and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions import black76
from ivlattice.functions.numeric import finite

NOISE = 1e-10


def calendar_breaches(grid: DataFrame, snap: list[str], k: str = "k", tau: str = "tau", w: str = "w") -> DataFrame:
    """Per snapshot: cells whose total variance falls below the maturity before, count, worst and sum."""
    before = F.lag(w).over(Window.partitionBy(*snap, k).orderBy(tau))
    gap = grid.withColumn("__d", F.col(w) - before)
    bad = F.col("__d") < -NOISE
    return gap.groupBy(*snap).agg(
        F.count_if(bad).alias("calendar"), F.coalesce(F.max(F.when(bad, -F.col("__d"))), F.lit(0.0)).alias("calendar_max"), F.coalesce(F.sum(F.when(bad, -F.col("__d"))), F.lit(0.0)).alias("calendar_sum")
    )


def butterfly_breaches(grid: DataFrame, snap: list[str], k: str = "k", tau: str = "tau", w: str = "w") -> DataFrame:
    """Per snapshot: convexity (butterfly) and slope (vertical) breaches of call prices across strikes.

    A slice with a variance that is negative or no number counts those cells only.
    """
    usable = finite(w) & (F.col(w) >= 0)
    slice_ = Window.partitionBy(*snap, tau)
    g = grid.withColumn("__bad", ~usable).withColumn("__skip", F.max("__bad").over(slice_))
    # undiscounted calls on a forward of one
    g = g.withColumns({"__one": F.lit(1.0), "__cp": F.lit(1), "__k": F.exp(k), "__v": F.when(~F.col("__skip"), F.sqrt(w))})
    g = black76.priced(g.select(*snap, tau, k, "__bad", "__one", "__cp", "__k", "__v"), "__one", "__k", "__one", "__v", "__cp").withColumnRenamed("price", "__c")
    order = slice_.orderBy(k)
    slope = (F.lead("__c").over(order) - F.col("__c")) / (F.lead("__k").over(order) - F.col("__k"))
    g = g.withColumn("__s", slope)
    g = g.withColumn("__ds", F.lead("__s").over(order) - F.col("__s"))
    vertical = F.greatest(F.col("__s"), F.lit(0.0)) + F.greatest(-1 - F.col("__s"), F.lit(0.0))
    is_vertical = (F.col("__s") > NOISE) | (F.col("__s") < -1 - NOISE)
    is_fly = F.col("__ds") < -NOISE
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    return g.groupBy(*snap).agg(
        F.count_if("__bad").alias("unusable"),
        F.count_if(is_fly).alias("butterfly"),
        F.coalesce(F.max(F.when(is_fly, -F.col("__ds"))), F.lit(0.0)).alias("butterfly_max"),
        total(is_fly, -F.col("__ds")).alias("butterfly_sum"),
        F.count_if(is_vertical).alias("vertical"),
        F.coalesce(F.max(F.when(is_vertical, vertical)), F.lit(0.0)).alias("vertical_max"),
        total(is_vertical, vertical).alias("vertical_sum"),
    )


def surface_check(grid: DataFrame, snap: list[str], **names: str) -> DataFrame:
    a, b = calendar_breaches(grid, snap, **names), butterfly_breaches(grid, snap, **names)
    j = a.join(b, snap)
    return j.withColumn("ok", (F.col("calendar") == 0) & (F.col("butterfly") == 0) & (F.col("vertical") == 0) & (F.col("unusable") == 0))


def market_rate(butterfly: Column, calendar: Column, n_slices: Column, n_k: int = 9) -> Column:
    """Share of possible breaches that occur, at most one."""
    return F.least(F.lit(1.0), F.try_divide(butterfly + calendar, n_slices * n_k + (n_slices - 1) * n_k))


def reliability(n_obs: Column, interpolated: Column, extrapolated: Column, rmse: Column, n_ref: float = 5.0, half_life: float = 0.05) -> Column:
    """Weight of a grid cell between 0 and 1."""
    origin = F.when(extrapolated, 0.0).when(interpolated, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(n_obs / n_ref, F.lit(1.0)) * origin * F.pow(F.lit(2.0), -rmse / half_life)))


def coverage(grid: DataFrame, axes: list[str], value: str) -> DataFrame:
    return grid.groupBy(*axes).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(F.col("interp_flag").cast("double")).alias("interpolated")
    )


def quality_summary(surfaces: DataFrame) -> DataFrame:
    """One row per snapshot from the parameter rows."""
    p = surfaces.filter("record_kind = 'param'")
    return p.groupBy("snap_date", "currency").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.avg("rmse").alias("rmse_mean"),
        F.max("rmse").alias("rmse_max"),
        F.sum("n_obs").alias("n_obs"),
        F.count_if(F.col("fit_method") == "ssvi").alias("n_ssvi"),
        F.bool_and("butterfly_ok").alias("butterfly_ok"),
        F.bool_and("calendar_ok").alias("calendar_ok"),
        F.sum("refit_attempts").alias("refits"),
    )


def surface_factors(grid: DataFrame, snap: list[str]) -> DataFrame:
    """Per snapshot and tenor: at-the-money volatility, curvature and 25-delta skew (null outside the sampled deltas)."""
    iv = F.sqrt(F.col("grid_w") / F.col("tau"))
    eps = 2.220446049250313e-16
    g = grid.withColumns({"__iv": iv, "__s": F.sqrt("grid_w")})
    g = g.withColumn("__d1", -F.col("grid_k") / F.greatest("__s", F.lit(eps)) + F.col("__s") / 2)
    g = g.withColumn("__call", black76.norm_cdf(F.col("__d1"))).withColumn("__put", F.col("__call") - 1)
    at = lambda m: F.max(F.when(F.col("moneyness") == m, F.col("__iv")))
    curve = lambda d: F.array_sort(F.collect_list(F.struct(F.col(d).alias("x"), F.col("__iv").alias("y"))))
    t = g.groupBy(*snap, "tau").agg(at(0.0).alias("atm_iv"), ((at(-1.0) + at(1.0)) / 2 - at(0.0)).alias("curvature"), curve("__put").alias("__p"), curve("__call").alias("__c"))
    from ivlattice.functions.numeric import interpolate

    xs = lambda c: F.transform(c, lambda v: v["x"])
    ys = lambda c: F.transform(c, lambda v: v["y"])
    skew = interpolate(F.lit(-0.25), xs("__p"), ys("__p")) - interpolate(F.lit(0.25), xs("__c"), ys("__c"))
    return t.withColumn("skew_25delta", skew).drop("__p", "__c")
