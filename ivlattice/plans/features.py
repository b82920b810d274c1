"""Daily feature rows, their audit, and supervised windows over the domain tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice.functions import flags
from ivlattice.functions.calendar import calendar_features, snap_ts
from ivlattice.functions.numeric import finite
from ivlattice.operators import arbitrage, bars, folds, market, pca, repair, svifit
from ivlattice.plans import market as domain
from ivlattice.plans.registry import Catalogue
from ivlattice.session import durable, table

query = Catalogue()
CELLS = len(svifit.TENOR_DAYS) * len(svifit.MONEYNESS)


def grid_vectors(surfaces: DataFrame) -> DataFrame:
    """One row per snapshot: the grid as arrays, maturity-major, with a reason where it is not usable.

    The first reason that applies: surface_grid_cell_count, surface_grid_duplicates,
    surface_grid_null, surface_grid_values. Soft faults are listed in
    ``quality_flags`` in a fixed order.
    """
    key = ["snap_date", "currency"]
    g = surfaces.filter("record_kind = 'grid'")
    cells = g.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("tau", "moneyness").alias("n_distinct"),
        F.count_if(F.col("grid_w").isNull() | F.col("grid_k").isNull()).alias("n_null"),
        F.count_if(~finite("grid_w") | (F.col("grid_w") < 0)).alias("n_bad"),
        F.array_sort(F.collect_list(F.struct("tau", "moneyness", "grid_w", "grid_k", "cell_n_obs", "interp_flag"))).alias("c"),
    )
    reason = (
        F.when(F.col("n") != CELLS, "surface_grid_cell_count").when(F.col("n_distinct") != CELLS, "surface_grid_duplicates").when(F.col("n_null") > 0, "surface_grid_null").when(F.col("n_bad") > 0, "surface_grid_values")
    )
    p = surfaces.filter("record_kind = 'param'").groupBy(*key).agg(
        F.bool_and("butterfly_ok").alias("butterfly_ok"), F.bool_and("calendar_ok").alias("calendar_ok"), F.avg("rmse").alias("fit_rmse"), F.sum("n_obs").alias("n_obs"), F.count(F.lit(1)).alias("n_slices")
    )
    take = lambda f: F.transform("c", lambda x: x[f])
    v = cells.join(p, key, "left").select(
        *key,
        reason.alias("reason"),
        take("grid_w").alias("grid_w"),
        take("grid_k").alias("grid_k"),
        take("cell_n_obs").alias("grid_n_obs"),
        take("interp_flag").alias("grid_interp"),
        "butterfly_ok",
        "calendar_ok",
        "fit_rmse",
        "n_obs",
        "n_slices",
    )
    interpolated = F.size(F.filter("grid_interp", lambda x: x))
    soft = flags.flag_list(
        ("butterfly", ~F.col("butterfly_ok")),
        ("calendar", ~F.col("calendar_ok")),
        ("low_support", F.exists("grid_n_obs", lambda x: x < 5)),
        ("interpolated", interpolated > 0),
    )
    return v.withColumn("quality_flags", soft)


def daily_features(spark: SparkSession, d: str, surfaces: DataFrame) -> DataFrame:
    """One wide row per (snap_date, currency) that has a usable surface.

    Optional inputs never fail a day: what is missing or too old is null and marked
    as unavailable.
    """
    key = ["snap_date", "currency"]
    usable = grid_vectors(surfaces).filter("reason is null").drop("reason")
    days = usable.select(*key)
    f = arbitrage.surface_factors(surfaces.filter("record_kind = 'grid'"), key)
    at = lambda c, n: F.max(F.when(F.abs(F.col("tau") - n / 365.0) < 1e-9, F.col(c))).alias(f"{c}_{n}d")
    wide = f.groupBy(*key).agg(*[at(c, n) for n in svifit.TENOR_DAYS for c in ("atm_iv", "skew_25delta", "curvature")])
    wide = wide.withColumn("atm_term_slope_7_180", (F.col("atm_iv_180d") - F.col("atm_iv_7d")) / (173 / 365.0))
    perpetual = table(spark, d, "ohlc").filter("instrument like '%-PERPETUAL'")
    rv = bars.realized(bars.daily_bars(perpetual, "instrument", 3_600, need=6), "instrument")
    rv = rv.select(
        F.col("day").alias("snap_date"), F.split_part("instrument", F.lit("-"), F.lit(1)).alias("currency"), "return_1d", "log_range", *[c for c in rv.columns if c.startswith("rv_")], "jump_flag", F.col("last_ts").alias("rv_ts")
    )
    out = usable.join(wide, key, "left").join(market.with_lineage(days.join(rv, key, "left"), "underlying", "rv_ts"), key, "left")
    out = out.join(market.dvol_level(days, table(spark, d, "dvol")), key, "left")
    out = out.join(market.funding_level(days, table(spark, d, "funding")), key, "left")
    out = out.join(market.futures_basis(days, table(spark, d, "trades_futures")), key, "left")
    out = out.join(domain.open_interest_of(spark, d, days), key, "left")
    out = out.join(market.option_volumes(table(spark, d, "trades_options")), key, "left")
    out = out.withColumn("volume_available", F.col("options_volume").isNotNull())
    spreads = {f"iv_rv_spread_{n}d": F.col(f"atm_iv_{n}d") - F.col("rv_parkinson_22d") for n in svifit.TENOR_DAYS}
    sources = [c for c in out.columns if c.endswith("_source_ts")]
    out = out.withColumns(spreads | {"snap_ts": snap_ts("snap_date"), "max_source_ts": F.greatest(*[F.col(c) for c in sources])})
    return out.select("*", *calendar_features("snap_date"))


def market_bundle_of(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    """Everything the market says about each (snap_date, currency) but its surface; what is missing or too old is null and marked."""
    key = ["snap_date", "currency"]
    out = market.dvol_level(days, table(spark, d, "dvol"))
    out = out.join(market.funding_level(days, table(spark, d, "funding")), key, "left")
    out = out.join(market.futures_basis(days, table(spark, d, "trades_futures")), key, "left")
    out = out.join(domain.open_interest_of(spark, d, days), key, "left")
    out = out.join(market.option_volumes(table(spark, d, "trades_options")), key, "left")
    out = out.withColumn("volume_available", F.col("options_volume").isNotNull())
    sources = [c for c in out.columns if c.endswith("_source_ts")]
    return out.withColumns({"snap_ts": snap_ts("snap_date"), "max_source_ts": F.greatest(*[F.col(c) for c in sources])})


_BUNDLE = f"""SELECT day, currency, dvol, dvol_change_5d, dvol_available, funding_8h, funding_available, futures_basis, futures_basis IS NOT NULL AS basis_available, aggregate_oi, aggregate_oi IS NOT NULL AS oi_available,
 options_volume, put_call_ratio, options_volume IS NOT NULL AS volume_available FROM ({domain.SQL["dvol_features"]}) JOIN ({domain.SQL["funding_features"]}) USING (day, currency) JOIN ({domain.SQL["basis_features"]}) USING (day, currency)
 JOIN ({domain.SQL["open_interest"]}) USING (day, currency) LEFT JOIN ({domain.SQL["option_volumes"]}) USING (day, currency)"""
_BUNDLE_DIGITS = {"dvol_change_5d": 9, "futures_basis": 9, "aggregate_oi": 6, "options_volume": 6, "put_call_ratio": 9}


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    return market_bundle_of(spark, d, domain._days(spark, d))


@query(_BUNDLE)
def market_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Every day with option trades beside all optional sources."""
    b = _bundle(spark, d).withColumns({c: F.round(c, n) for c, n in _BUNDLE_DIGITS.items()})
    marks = [f"{c}_available" for c in ("dvol", "funding", "basis", "oi", "volume")]
    return b.select(F.col("snap_date").cast("string").alias("day"), "currency", "dvol", "funding_8h", *_BUNDLE_DIGITS, *marks)


@query(f"""WITH b AS ({_BUNDLE}), u AS (UNPIVOT (SELECT dvol, dvol_change_5d, funding_8h, futures_basis, aggregate_oi, options_volume, put_call_ratio FROM b) ON COLUMNS(*) INTO NAME feature VALUE x)
SELECT feature, count(x) AS n, round(avg(x), 6) AS mean FROM u WHERE isfinite(x) GROUP BY feature""")
def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Days with an ordinary number, and their mean, of each numeric feature that a window would take."""
    b = _bundle(spark, d)
    chosen = folds.scalar_features(b.schema, {"snap_date", "currency"})
    numeric = [c for c in chosen if not c.endswith(("_available", "_age_s"))]
    u = b.select(*[F.col(c).cast("double") for c in numeric]).unpivot([], numeric, "feature", "x").filter(finite("x"))
    return u.groupBy("feature").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query(f"""WITH b AS (SELECT day::DATE AS day, currency, dvol, funding_8h, options_volume FROM ({_BUNDLE})),
w AS (SELECT *, list({{'d': day, 'v': options_volume, 'ok': dvol IS NOT NULL AND funding_8h IS NOT NULL AND options_volume IS NOT NULL}}) OVER a AS past, count(*) OVER c AS n FROM b
 WINDOW a AS (PARTITION BY currency ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), c AS (PARTITION BY currency ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)),
e AS (SELECT min(day) AS s, max(day) + 1 AS stop FROM b),
f AS (SELECT i AS fold_id, s AS train_start, (s + to_months(CAST(2 + i AS INTEGER)))::DATE AS train_end, (s + to_months(CAST(3 + i AS INTEGER)))::DATE AS validation_end, (s + to_months(CAST(4 + i AS INTEGER)))::DATE AS test_end, stop FROM e, (SELECT unnest(range(20)) AS i))
SELECT fold_id, CASE WHEN day < train_end THEN 'train' WHEN day < validation_end THEN 'validation' ELSE 'test' END AS split, currency, strftime(day, '%Y-%m-%d') AS day, len(list_filter(past, lambda x: x.ok)) AS n_complete, round(past[1].v, 6) AS oldest_volume, round(options_volume, 6) AS target
FROM w JOIN f ON day >= train_start AND day < test_end AND test_end <= stop WHERE n = 4""")
def bundle_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three days of features before each target day, in the folds that the target's date falls into."""
    b = durable(_bundle(spark, d).select("snap_date", "currency", "dvol", "funding_8h", "options_volume"))
    w = folds.lookback(b, ["currency"], "snap_date", ["dvol", "funding_8h", "options_volume"], length=3, horizon=1)
    days = b.select(F.col("snap_date").alias("day"))
    m = folds.manifest(days, folds.folds(days, fit_months=2, val_months=1, test_months=1, step_months=1)).withColumnRenamed("day", "snap_date")
    x = w.join(m, "snap_date")
    oldest = F.round(F.col("inputs")[0]["options_volume"], 6)
    return x.select("fold_id", "split", "currency", F.col("snap_date").cast("string").alias("day"), F.size(F.filter("mask", lambda v: v)).cast("long").alias("n_complete"), oldest.alias("oldest_volume"), F.round("options_volume", 6).alias("target"))


@query(f"""WITH b AS (SELECT day::DATE AS day, currency FROM ({_BUNDLE})), w AS (SELECT count(*) OVER (PARTITION BY currency ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS n FROM b)
SELECT 'last input' AS rule, count(*) AS n FROM w WHERE n = 4""")
def window_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Windows that end a day before their target, held against a horizon of two days: each breaks the last rule and no other."""
    b = durable(_bundle(spark, d).select("snap_date", "currency", "dvol"))
    w = folds.lookback(b, ["currency"], "snap_date", ["dvol"], length=3, horizon=1)
    return folds.window_breaches(w, "snap_date", 3, 2)


@query(domain._FOLDS + "SELECT fold_id, train_end >= train_start + 600 AS inside FROM folds")
def component_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The folds for which components fitted on the first 600 days have seen training days only."""
    days = domain._order_days(spark, d)
    first = days.agg(F.min("day")).first()[0]
    plan = folds.folds(days)
    assert folds.fold_breaches(plan).isEmpty()
    return folds.fit_range_inside(plan, str(first), str(first + timedelta(days=600)))


@query()
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return daily_features(spark, d, domain.surfaces(spark, d))


@query()
def feature_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every day with option trades: accepted or rejected, with the reason."""
    days = domain._days(spark, d)
    g = grid_vectors(domain.surfaces(spark, d)).select("snap_date", "currency", "reason", F.concat_ws(",", "quality_flags").alias("detail"))
    j = days.join(g.withColumn("seen", F.lit(True)), ["snap_date", "currency"], "left")
    reason = F.when(F.col("seen").isNull(), "surface_missing").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("detail") != "", "surface_quality_warning").otherwise("ok")
    status = F.when(F.col("seen").isNull() | F.col("reason").isNotNull(), "rejected").otherwise("accepted")
    return j.select("snap_date", "currency", status.alias("status"), reason.alias("reason_code"), "detail")


@query()
def feature_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = daily_features(spark, d, domain.surfaces(spark, d))
    return folds.leaks(rows, "snap_ts", [c for c in rows.columns if c.endswith("_source_ts")])


@query()
def supervised_windows(spark: SparkSession, d: str) -> DataFrame:
    """Look-back windows of grid and features; the target date alone decides the split."""
    rows = durable(daily_features(spark, d, domain.surfaces(spark, d)).select("snap_date", "currency", "grid_w", "dvol", "funding_8h", "return_1d"))
    w = folds.lookback(rows, ["currency"], "snap_date", ["dvol", "funding_8h", "return_1d"], length=3, horizon=1)
    plan = folds.folds(rows.select(F.col("snap_date").alias("day")), fit_months=2, val_months=1, test_months=1, step_months=1)
    m = folds.manifest(rows.select(F.col("snap_date").alias("day")), plan).withColumnRenamed("day", "snap_date")
    target = rows.select("snap_date", "currency", F.col("grid_w").alias("target_grid"))
    return w.join(target, ["snap_date", "currency"]).join(m.drop("tune_hyperparameters"), "snap_date").select("fold_id", "split", "currency", "snap_date", "inputs", "mask", "target_grid")


@query()
def grid_component_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each usable grid on the components fitted to the first two thirds of the days."""
    g = durable(grid_vectors(domain.surfaces(spark, d)).filter("reason is null").select("snap_date", "currency", "grid_w"))
    if g.isEmpty():
        return g.select("snap_date", "currency", F.array().cast("array<double>").alias("scores"))
    cut = g.agg(F.percentile_approx(F.unix_date("snap_date"), 2 / 3).alias("cut"))
    c = pca.fit(g.join(cut, F.unix_date("snap_date") <= F.col("cut")), "grid_w", 3)
    return g.select("snap_date", "currency", c.scores("grid_w").alias("scores"))


@query()
def repaired_slices(spark: SparkSession, d: str) -> DataFrame:
    """Repaired variance of six slices each, on the grid of the closed-form queries."""
    s = domain._slices(spark, d).withColumn("snap", F.expr("s_suppkey div 6"))
    return repair.repair_surfaces(s.select("snap", "s_suppkey", "i", "k", "w"), ["snap"], "s_suppkey", "i", "k", "w")


QUERIES, SQL = query.QUERIES, query.SQL
