"""Variance slices straight from the market, and their quality on the domain they stand for.

A slice is one expiry of one snapshot: its strikes as an array of (k, w, n, scatter),
ascending in k, equal strikes collapsed to their mean before. The number of strikes
of an expiry bounds the array; everything else is joins, windows and array columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions.numeric import interpolate_clamped
from ivlattice.operators import arbitrage

NOISE = arbitrage.NOISE
LEAST_POINTS = 3
#: Places on an axis closer than this are one.
SAME = 1e-9


def slices(obs: DataFrame, snap: list[str], least: int = LEAST_POINTS) -> DataFrame:
    """``obs``: snap columns, expiry, tau, strike, index, iv (fraction). Slices with at least ``least`` strikes.

    k is measured from the median index of the slice, so calls and puts of a strike
    share it. Rows with a null or non-positive volatility must be filtered before.
    """
    forward = obs.groupBy(*snap, "expiry").agg(F.median("index").alias("forward"))
    strikes = obs.groupBy(*snap, "expiry", "tau", "strike").agg(
        F.avg(F.col("iv") * F.col("iv")).alias("v"), F.count(F.lit(1)).alias("n"), F.var_pop("iv").alias("scatter")
    )
    point = F.struct(F.log(F.col("strike") / F.col("forward")).alias("k"), (F.col("v") * F.col("tau")).alias("w"), "n", "scatter")
    s = strikes.join(forward, [*snap, "expiry"]).groupBy(*snap, "expiry", "tau", "forward").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return s.filter(F.size("points") >= least)


def ks(points: str | Column = "points") -> Column:
    return F.transform(points, lambda p: p["k"])


def ws(points: str | Column = "points") -> Column:
    return F.transform(points, lambda p: p["w"])


def shared_grid(s: DataFrame, lo: float = -0.4, hi: float = 0.4, n: int = 9) -> DataFrame:
    """Slices on ``n`` shared values of k (columns i, k, w), flat beyond their ends."""
    at = F.lit(lo) + F.lit(hi - lo) * F.col("i") / F.lit(float(n - 1))
    g = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", at)
    return g.withColumn("w", interpolate_clamped(F.col("k"), ks(), ws()))


def native_points(s: DataFrame, snap: list[str]) -> DataFrame:
    return s.select(*snap, "tau", F.inline("points")).select(*snap, "tau", "k", "w")


def domain_quality(s: DataFrame, snap: list[str], n: int = 9) -> DataFrame:
    """Checks of the slices where they have quotes: never beyond a slice's own ends.

    Butterfly and vertical breaches on native points; calendar deficits of each two
    neighbouring maturities on ``n`` points of the interval that both cover. A pair
    without such an interval is counted as insufficient. One row per snapshot with
    at least two slices.
    """
    order = Window.partitionBy(*snap).orderBy("tau")
    pairs = s.select(*snap, "tau", ks().alias("x1"), ws().alias("y1")).withColumns({"x2": F.lead("x1").over(order), "y2": F.lead("y1").over(order)}).filter(F.col("x2").isNotNull())
    pairs = pairs.withColumns({"a": F.greatest(F.get("x1", F.lit(0)), F.get("x2", F.lit(0))), "b": F.least(F.element_at("x1", -1), F.element_at("x2", -1))})
    widths = pairs.groupBy(*snap).agg(F.min(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("least_overlap"), F.count_if(F.col("b") <= F.col("a")).alias("insufficient"), F.count(F.lit(1)).alias("pairs"))
    p = pairs.filter("b > a").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = p.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.lit(float(n - 1)))
    p = p.withColumns({"short": interpolate_clamped(F.col("x"), F.col("x1"), F.col("y1")), "long": interpolate_clamped(F.col("x"), F.col("x2"), F.col("y2"))})
    p = p.withColumn("gap", F.when(F.col("short") - F.col("long") > NOISE, F.col("short") - F.col("long")).otherwise(0.0))
    relative = F.col("gap") / F.greatest((F.col("short") + F.col("long")) / 2, F.lit(NOISE))
    calendar = p.groupBy(*snap).agg(
        F.count_if(F.col("gap") > 0).alias("calendar"),
        F.max("gap").alias("calendar_max"),
        F.sum("gap").alias("calendar_sum"),
        F.max(relative).alias("relative_max"),
        F.sum(relative).alias("relative_sum"),
    )
    fly = arbitrage.butterfly_breaches(native_points(s, snap), snap)
    out = widths.join(calendar, snap, "left").join(fly, snap, "left")
    out = out.withColumn("calendar", F.coalesce("calendar", F.lit(0).cast("long")))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("calendar_max", "calendar_sum", "relative_max", "relative_sum")})
    return out.withColumn("ok", (F.col("butterfly") == 0) & (F.col("vertical") == 0) & (F.col("calendar") == 0) & (F.col("insufficient") == 0))


def quality_channels(grid: DataFrame, width: float = 0.05) -> DataFrame:
    """Per cell of ``shared_grid``: log1p of its observations, interpolated, extrapolated, rmse and weight."""
    inside = F.filter("points", lambda p: F.abs(p["k"] - F.col("k")) <= width)
    n = F.aggregate(inside, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    first, last = F.element_at("points", 1)["k"], F.element_at("points", -1)["k"]
    beyond = (F.col("k") < first - SAME) | (F.col("k") > last + SAME)
    on_strike = F.exists("points", lambda p: F.abs(p["k"] - F.col("k")) < SAME)
    scatter = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["scatter"]) / F.size("points")
    g = grid.withColumns({"cell_n_obs": n, "extrap": beyond, "interp": ~beyond & ~on_strike, "rmse": F.sqrt(F.greatest(scatter, F.lit(0.0)))})
    return g.withColumns({"log_n_obs": F.log1p("cell_n_obs"), "weight": arbitrage.reliability(F.col("cell_n_obs"), F.col("interp"), F.col("extrap"), F.col("rmse"))})


def nearest_slices(s: DataFrame, snap: list[str], tenor_days: tuple[int, ...]) -> DataFrame:
    """Per snapshot and tenor the slice nearest in maturity, the shorter one on ties, with its variance at the money."""
    t = s.withColumn("tenor", F.explode(F.array(*[F.lit(x) for x in tenor_days])))
    gap = F.abs(F.col("tau") - F.col("tenor") / F.lit(365.0))
    row = F.struct("tau", interpolate_clamped(F.lit(0.0), ks(), ws()).alias("atm_w"), (gap >= SAME).alias("interp"))
    return t.groupBy(*snap, "tenor").agg(F.min_by(row, F.struct(gap, "tau")).alias("r")).select(*snap, "tenor", "r.*")


def residuals(obs: DataFrame, s: DataFrame, snap: list[str]) -> DataFrame:
    """Per slice the root mean square distance of its raw volatilities from the slice's own curve."""
    j = obs.select(*snap, "expiry", "strike", "iv").join(s, [*snap, "expiry"])
    fitted = F.sqrt(interpolate_clamped(F.log(F.col("strike") / F.col("forward")), ks(), ws()) / F.col("tau"))
    return j.groupBy(*snap, "expiry").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(fitted - F.col("iv"), 2))).alias("rmse"))


def reasons(snapshots: DataFrame, s: DataFrame, grid: DataFrame, snap: list[str], cells: int = 9) -> DataFrame:
    """The first structural reason against each snapshot's surface, ``ok`` if there is none.

    In order: surface_missing (no slice), surface_parameter_rows (fewer than two),
    surface_grid_cell_count, surface_grid_values (negative or no number),
    surface_grid_axes (k of a slice not strictly increasing).
    """
    rising = F.forall(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.get(ks(), i) > F.get(ks(), i - 1))
    n = s.groupBy(*snap).agg(F.count(F.lit(1)).alias("n_slices"), F.bool_and(rising).alias("rising"))
    g = grid.groupBy(*snap).agg(F.count(F.lit(1)).alias("n_cells"), F.bool_and(F.coalesce((F.col("w") >= 0) & ~F.isnan("w"), F.lit(False))).alias("good"))
    j = snapshots.join(n, snap, "left").join(g, snap, "left")
    reason = (
        F.when(F.col("n_slices").isNull(), "surface_missing")
        .when(F.col("n_slices") < 2, "surface_parameter_rows")
        .when(F.coalesce("n_cells", F.lit(0)) != F.col("n_slices") * cells, "surface_grid_cell_count")
        .when(~F.col("good"), "surface_grid_values")
        .when(~F.col("rising"), "surface_grid_axes")
        .otherwise("ok")
    )
    return j.select(*snap, reason.alias("reason"))


#: What ``coherence`` looks at, in order.
RULES = ("list length", "values", "weights", "flags", "interpolated share", "extrapolated share", "lookahead")


def coherence(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` with ``breaches``: the RULES that a daily row breaks, in order.

    A row has arrays w, n_obs, interp, extrap, rmse and weight of one length, a list of
    soft flags that its cells must imply, the shares of interpolated and extrapolated
    cells, and the times snap_ts and max_source_ts. A null list breaks the first rule.
    """
    lists = ("w", "n_obs", "interp", "extrap", "rmse", "weight")
    length = F.lit(True)
    for c in lists:
        length = length & F.coalesce(F.size(c) == cells, F.lit(False))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    values = F.forall("w", lambda x: number(x) & (x >= 0)) & F.forall("n_obs", lambda x: x >= 0) & F.forall("rmse", lambda x: number(x) & (x >= 0))
    weights = F.forall("weight", lambda x: number(x) & (x >= 0) & (x <= 1))
    share = lambda c: F.size(F.filter(c, lambda x: x)) / F.size(c)
    flags = F.array_compact(
        F.array(
            F.when(F.exists("n_obs", lambda x: x < F.col("n_reference")), F.lit("low_observation_support")),
            F.when(F.exists("interp", lambda x: x), F.lit("interpolated_grid_cells")),
            F.when(F.exists("extrap", lambda x: x), F.lit("extrapolated_grid_cells")),
        )
    )
    kept = (
        length,
        values,
        weights,
        flags == F.col("flags"),
        F.abs(share("interp") - F.col("interp_fraction")) <= 1e-12,
        F.abs(share("extrap") - F.col("extrap_fraction")) <= 1e-12,
        F.col("max_source_ts") <= F.col("snap_ts"),
    )
    broken = [F.when(~F.coalesce(k, F.lit(i == len(kept) - 1)), F.lit(name)) for i, (k, name) in enumerate(zip(kept, RULES))]
    return rows.withColumn("breaches", F.array_compact(F.array(*broken)))
