"""Columns, relational operators, kernels and contracts."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ivlattice import config, contracts
from ivlattice.functions import black76, instrument
from ivlattice.functions.calendar import calendar_features, feature_day, snap_ts
from ivlattice.functions.numeric import finite, interpolate, interpolate_clamped
from ivlattice.operators import asof, bars, folds, median, options, pca, snapwindow, svifit
from ivlattice.session import hour_text, utc_day

UTC = dt.timezone.utc


def test_finite_and_days(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [False, False, False, True]
    t = spark.sql("select timestamp'1969-12-31 23:30:00' a, timestamp'2024-02-29 23:59:59.999999' b")
    assert tuple(t.select(utc_day("a"), utc_day("b")).first()) == (-1, 19782)
    assert t.select(hour_text(F.lit(19782 * 24 + 5))).first()[0] == "2024-02-29 05:00:00"


def test_interpolation(spark):
    r = spark.range(1).select(
        *[interpolate(F.lit(x), F.array(*map(F.lit, [0.0, 1.0, 3.0])), F.array(*map(F.lit, [0.0, 10.0, 30.0]))).alias(f"a{i}") for i, x in enumerate([-1.0, 0.0, 0.5, 2.0, 3.0, 4.0])],
        interpolate_clamped(F.lit(9.0), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(5.0), F.lit(7.0))).alias("c"),
        interpolate(F.lit(1.0), F.array().cast("array<double>"), F.array().cast("array<double>")).alias("e"),
    ).first()
    assert tuple(r) == (None, 0.0, 5.0, 20.0, 30.0, None, 7.0, None)


def test_instruments(spark):
    names = ["BTC-8APR22-40000-C", "ETH-29FEB24-1750-P", "VLR-2SEP24-7.5-C", "BTC-24JUN22", "BTC-PERPETUAL", "BTC-31JUN22-1-C", "BTC", None, "BTC-8APR22-40000-X", "BTC-8ANF22-1-C", "BTC-8XYZ22", "BTC-8APR22-", "BTC-8APR22-1-C-", "-8APR22"]
    got = [r.i for r in spark.createDataFrame([(n,) for n in names], "n string").select(instrument.parse("n").alias("i")).collect()]
    assert got[0].kind == "option" and got[0].strike == 40000 and got[0].expiry.strftime("%Y-%m-%d %H:%M") == "2022-04-08 08:00"
    assert got[2].strike == 7.5 and got[3].kind == "future" and got[3].strike is None and got[4].kind == "perpetual" and got[4].expiry is None
    assert got[5:] == [None] * 9
    with pytest.raises(Exception, match="unknown instrument"):
        spark.createDataFrame([("nonsense",)], "n string").select(instrument.parse_or_raise("n")).collect()


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 28),), (dt.date(2024, 3, 29),), (dt.date(2024, 5, 31),)], "d date")
    assert [tuple(r) for r in df.select(*calendar_features("d")).collect()] == [(3, 1, 1), (4, 28, 91), (4, 28, 28)]
    t = spark.sql("select timestamp_micros(1711699500000000) a, timestamp_micros(1711699500000001) b")  # 2024-03-29 08:05:00
    assert tuple(t.select(feature_day("a"), feature_day("b")).first()) == (dt.date(2024, 3, 29), dt.date(2024, 3, 30))
    assert df.select(F.unix_seconds(snap_ts("d"))).first()[0] % 86400 == 8 * 3600 + 300


@settings(max_examples=60, deadline=None)
@given(st.floats(10, 1e5), st.floats(0.5, 2), st.floats(0.01, 3), st.floats(0.05, 3), st.sampled_from([1, -1]))
def test_implied_volatility_round_trip(f, m, t, v, cp):
    p = black76.np_price(f, f * m, t, v, cp)
    s = v * math.sqrt(t)
    if abs(math.log(m)) < 3 * s and s < 4:
        assert abs(float(black76.np_implied_vol(p, f, f * m, t, cp)[0]) - v) < 1e-6


def test_implied_volatility_bounds():
    iv = black76.np_implied_vol([10.0, 9.0, 200.0, np.nan, 10.0 + 5e-9], 110.0, [100.0] * 5, 1.0, 1)
    assert iv[0] == 0.0 and np.isnan(iv[1:4]).all() and iv[4] == 0.0


def test_normal_cdf():
    x = np.linspace(-9, 9, 1001)
    assert np.max(np.abs(black76.np_norm_cdf(x) - [0.5 * math.erfc(-v / math.sqrt(2)) for v in x])) < 1e-14


def test_priced_columns_equal_numpy(spark):
    rows = [(100.0, 90.0, 0.5, 0.6, 1), (100.0, 120.0, 0.1, 0.3, -1), (100.0, 90.0, 0.0, 0.6, 1), (100.0, 90.0, 0.5, None, 1), (-1.0, 90.0, 0.5, 0.6, 1)]
    out = black76.priced(spark.createDataFrame(rows, "f double, k double, t double, v double, cp int"), "f", "k", "t", "v", "cp").collect()
    for r, row in zip(rows[:3], out):
        assert abs(row.price - float(black76.np_price(*r))) < 1e-12
    assert out[2].delta == 1.0 and out[2].vega == 0.0 and out[3].price is None and out[4].price is None


def test_exact_median_and_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=5001).round(2)
    rows = [("a", float(v)) for v in x] + [("b", 1.0), ("b", 2.0), ("c", float("nan")), ("c", None), ("d", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in median.exact_median(df, ["g"], "v").collect()}
    assert got == {"a": float(np.median(x)), "b": 1.5, "d": 5.0}
    small = spark.createDataFrame([("a", v) for v in [1.0, 1.0, 1.0, 2.0, None]] + [("b", 7.0)], "g string, v double")
    flags = sorted((r.g, r.v is None, r.v, r.is_outlier) for r in median.mad_outliers(small, ["g"], "v", 5.0).collect())
    assert [f[3] for f in flags if f[0] == "a" and not f[1]] == [False, False, False, True] and not flags[-1][3]


def test_snap_window_equals_the_loop(spark):
    rng = np.random.default_rng(5)
    base = dt.datetime(2024, 3, 1, tzinfo=UTC)
    rows = [(i, f"g{rng.integers(3)}", base + dt.timedelta(seconds=int(rng.integers(0, 6 * 86400)))) for i in range(120)]
    rows += [(900, "g0", dt.datetime(2024, 3, 1, 8, 5, tzinfo=UTC)), (901, "g0", dt.datetime(2024, 3, 1, 7, 5, tzinfo=UTC)), (902, "g0", None)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp")
    for b, s, m in ((60, 60, 360), (30, 45, 200), (60, 0, 360), (90, 60, 90)):
        got = {(r.snap_date, r.id, r.window_minutes) for r in snapwindow.snap_window(df, "ts", ["g"], b, s, m, least_rows=3).collect()}
        want = set()
        for k in range(8):
            day = dt.date(2024, 3, 1) + dt.timedelta(days=k)
            snap = dt.datetime(day.year, day.month, day.day, 8, 5, tzinfo=UTC)
            width = b
            while True:
                sel = [r for r in rows if r[2] is not None and snap - dt.timedelta(minutes=width) < r[2] <= snap]
                n = {g: sum(1 for r in sel if r[1] == g) for g in {r[1] for r in sel}}
                if (sel and min(n.values()) >= 3) or width >= m or s <= 0:
                    break
                width = min(width + s, m)
            want |= {(day, r[0], width) for r in sel}
        assert got == want, (b, s, m)


def test_asof(spark):
    rng = np.random.default_rng(9)
    at = lambda: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=int(rng.integers(0, 6000)))
    left = [(i, str(rng.choice(["a", "b"])), at()) for i in range(80)] + [(98, None, at()), (99, "a", None)]
    right = [(str(rng.choice(["a", "b", "c"])), at(), i) for i in range(60)] + [("a", None, 77)]
    a, b = spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v long")
    for age, strict in ((None, False), (3_600_000_000, False), (None, True)):
        got = {r.id: r.v for r in asof.asof_backward(a, b, ["k"], "t", "u", ["v"], ["v"], age, strict).collect()}
        for i, k, t in left:
            c = [(u, v) for x, u, v in right if t and u and x == k and (u < t if strict else u <= t)]
            best = max(c) if c else None
            if best and age and (t - best[0]).total_seconds() * 1e6 > age:
                best = None
            assert got[i] == (best[1] if best else None)


def test_parity_recovers_the_forward(spark):
    snap = dt.datetime(2024, 3, 1, 8, 4, tzinfo=UTC)
    fwd, rows = 50_000.0, []
    for i, k in enumerate((45_000.0, 50_000.0, 55_000.0)):
        for j, cp in enumerate((1, -1)):
            p = float(black76.np_price(fwd, k, 0.1, 0.6, cp))
            rows.append((2 * i + j, k, "C" if cp == 1 else "P", p, snap + dt.timedelta(seconds=j)))
    rows.append((20, 60_000.0, "C", 1.0, snap))
    rows.append((21, 60_000.0, "P", 1.0, snap - dt.timedelta(seconds=61)))
    df = spark.createDataFrame(rows, "ingest_seq long, strike double, cp string, usd_premium double, source_ts timestamp").withColumn("cell", F.lit(1))
    r = options.parity_pairs(df, ["cell"]).first()
    assert r.n_pairs == 3 and abs(r.parity_forward - fwd) < 1e-6


def test_folds_known_answer(spark):
    days = spark.sql("select explode(sequence(date'2021-01-01', date'2022-12-31', interval 1 day)) day")
    f = sorted(tuple(r) for r in folds.folds(days).collect())
    assert len(f) == 3 and [r[5] for r in f] == [True, True, False]
    assert f[0][2:5] == (dt.date(2022, 5, 1), dt.date(2022, 7, 1), dt.date(2022, 9, 1))
    m = folds.manifest(days, folds.folds(days))
    assert m.groupBy("fold_id", "day").count().filter("count > 1").count() == 0
    assert folds.folds(days.limit(0)).count() == 0


def test_lookback_needs_every_day(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 6, 7, 8, 9, 10)]
    df = spark.createDataFrame([("k", d, float(d.day)) for d in days], "k string, day date, x double")
    out = {r.day.day: [i.x for i in r.inputs] for r in folds.lookback(df, ["k"], "day", ["x"], length=2, horizon=2).collect()}
    assert out == {4: [1.0, 2.0], 9: [6.0, 7.0], 10: [7.0, 8.0]}


def test_daily_bars_need_all_candles(spark):
    rows = []
    for h in range(24):
        t = dt.datetime(2024, 1, 1, 8, tzinfo=UTC) + dt.timedelta(hours=h)
        rows.append((t, "X", 100.0, 110.0 if h == 5 else 101.0, 90.0 if h == 7 else 99.0, 100.0 + h, h))
    df = spark.createDataFrame(rows, "ts timestamp, instrument string, open double, high double, low double, close double, ingest_seq long")
    b = bars.daily_bars(df, "instrument", 3600).collect()
    assert len(b) == 1 and b[0].day == dt.date(2024, 1, 2) and (b[0].high, b[0].low, b[0].close) == (110.0, 90.0, 123.0)
    r = bars.realized(bars.daily_bars(df, "instrument", 3600), "instrument").first()
    assert abs(r.log_range - math.log(110 / 90)) < 1e-12 and r.return_1d is None and r.rv_parkinson_5d is None
    assert bars.daily_bars(df.filter("ingest_seq <> 3"), "instrument", 3600).count() == 0


def test_svi_fit_recovers_a_known_smile():
    p = np.array([0.04, 0.15, -0.3, 0.05, 0.15])
    k, tau = np.linspace(-1, 1, 25), 0.5
    iv = np.sqrt(svifit.variance(p, k) / tau)
    got = svifit.fit_slice(k, iv, tau, np.ones(25), 10.0)
    assert np.max(np.abs(svifit.variance(got, k) - svifit.variance(p, k))) < 1e-5
    assert svifit.lowest_g(np.array([0.0686, 1.6679, 0.1458, -0.7368, 0.7163]), -5, 5) < 0


def test_surfaces(spark):
    rows = []
    for tau_d in (7, 30, 90, 180):
        tau = tau_d / 365
        for k in np.linspace(-0.6, 0.6, 9):
            w = svifit.variance(np.array([0.01 + 0.05 * tau, 0.1, -0.1, 0.0, 0.2]), np.array([k]))[0]
            rows.append((dt.date(2024, 1, 1), "BTC", dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(days=tau_d), tau, float(k), float(np.sqrt(w / tau)), 1.0))
    df = spark.createDataFrame(rows, "snap_date date, currency string, expiry timestamp, tau double, k double, iv double, vega double")
    out = svifit.build_surfaces(df).collect()
    params, grid = [r for r in out if r.record_kind == "param"], [r for r in out if r.record_kind == "grid"]
    assert len(params) == 4 and len(grid) == 54 and all(r.rmse < 1e-3 and r.butterfly_ok and r.calendar_ok for r in params)
    assert {r.interp_flag for r in grid} == {True, False}
    assert svifit.build_surfaces(df.filter("tau < 0.05")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    c = pca.fit(df, "v", 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(c.axes @ vt[:2].T), np.eye(2), atol=1e-8) and np.allclose(c.ratio, (s**2 / (s**2).sum())[:2])
    got = {r.id: r.s for r in df.select("id", c.scores("v").alias("s")).collect()}
    assert np.allclose(got[3], (x[3] - x.mean(0)) @ c.axes.T)


def test_contracts_name_what_is_broken(spark):
    q = contracts.Contract("t", "a long, b double", frozenset({"b"}), {"a > 0": "a > 0"}, frozenset({"b"}))
    df = spark.createDataFrame([(1, 1.0), (-1, float("nan")), (None, None)], "a long, b double")
    assert q.breaches(df) == {"a is null": 1, "b is not finite": 1, "a > 0": 1}
    with pytest.raises(contracts.ContractError, match="a > 0"):
        q.validate(df)
    with pytest.raises(contracts.ContractError, match="unknown"):
        q.validate(df.withColumn("c", F.lit(1)))
    assert q.validate(df.limit(1)).count() == 1


def test_settings(tmp_path):
    assert config.load(config.Curation, tmp_path / "none.yaml") == config.Curation()
    (tmp_path / "c.yaml").write_text("window_minutes: 30\n")
    assert config.load(config.Curation, tmp_path / "c.yaml").window_minutes == 30
    (tmp_path / "d.yaml").write_text("windows: 30\n")
    with pytest.raises(ValueError, match="unknown"):
        config.load(config.Curation, tmp_path / "d.yaml")
    with pytest.raises(ValueError):
        config.Curation(window_minutes=400)


@pytest.mark.parametrize(
    "k, w",
    [
        (np.linspace(-1, 1, 5), [[0.5223, 0.0748, 0.4493, 1.7387, 4.0282]]),
        (np.array([0.0, 0.5, 1.0]), [[0.0044, 1.23, 18.0]]),
        (np.linspace(-1, 1, 9), [[0.05] * 9, [0.03] * 9, [0.09] * 9]),
    ],
)
def test_repair_removes_arbitrage(k, w):
    from ivlattice.operators import repair

    w = np.array(w)
    assert repair.breaches(k, w) > 1e-10
    fixed = repair.repair_grid(k, w)
    assert repair.breaches(k, fixed) <= 1e-8 and np.isfinite(fixed).all()


def test_repair_leaves_a_clean_grid_alone():
    from ivlattice.operators import repair

    k = np.linspace(-1, 1, 9)
    w = np.stack([svifit.variance(np.array([0.01 + 0.05 * t, 0.1, -0.1, 0.0, 0.2]), k) for t in (0.1, 0.3, 0.6)])
    assert np.array_equal(repair.repair_grid(k, w), w)


def test_registered_functions(spark):
    from ivlattice.functions.register import register

    assert len(register(spark)) == 5
    r = spark.sql(
        "select svi_w(0.1D, 0.04D, 0.15D, -0.3D, 0.05D, 0.15D) w, svi_g(0.1D, 0.04D, 0.15D, -0.3D, 0.05D, 0.15D) g, "
        "implied_vol(black76_price(100D, 90D, 0.5D, 0.6D, 1D), 100D, 90D, 0.5D, 1D) v, parse_instrument('BTC-8APR22-40000-C').strike k"
    ).first()
    p = np.array([0.04, 0.15, -0.3, 0.05, 0.15])
    assert abs(r.w - svifit.variance(p, np.array([0.1]))[0]) < 1e-12 and abs(r.g - svifit.durrleman(p, np.array([0.1]))[0]) < 1e-12
    assert abs(r.v - 0.6) < 1e-9 and r.k == "40000"


def test_implied_volatility_of_every_contract(spark):
    from pathlib import Path

    from ivlattice.plans import market

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test tables here")
    rows = market.QUERIES["implied_volatility_repriced"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()
    worth = lambda r: max(0.0, r.cp * (r.f - r.k))
    assert all(abs(r.repriced - r.price) < 1e-7 * r.f if r.iv > 0 else r.price - worth(r) < 1e-7 * r.f for r in rows)


def test_bounded_outliers_equal_the_general_ones(spark):
    rng = np.random.default_rng(8)
    rows = [("ab"[i % 2] if i % 11 else None, float(rng.normal()) * (20 if i % 17 == 0 else 1)) for i in range(200)] + [("c", 5.0), ("d", 1.0), ("d", 1.0), ("d", 2.0), ("e", float("nan")), ("e", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, v double")
    got = [{r.id: r.is_outlier for r in median.mad_outliers(df, ["k"], "v", 3.0, bounded=b).collect()} for b in (False, True)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and sum(got[0].values()) > 3
