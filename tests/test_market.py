"""Slices of the market and their quality, snapshot joins, windows, sinks and moments on known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ivlattice.contracts import ContractError
from ivlattice.operators import asof, folds, marketgrid, pca, relational
from ivlattice.sources import tables

UTC = dt.timezone.utc
DAY = dt.date(2024, 1, 5)


def slices(spark, rows):
    """(tau, [(k, w), ...]) of one snapshot."""
    spec = "s int, tau double, expiry int, forward double, points array<struct<k:double,w:double,n:long,scatter:double>>"
    return spark.createDataFrame([(1, tau, i, 100.0, [(k, w, 1, 0.0) for k, w in p]) for i, (tau, p) in enumerate(rows)], spec)


def test_equal_strikes_collapse_to_their_mean(spark):
    obs = [(1, 9, 0.5, 100.0, 100.0, 0.4), (1, 9, 0.5, 100.0, 100.0, 0.6), (1, 9, 0.5, 110.0, 100.0, 0.5), (1, 9, 0.5, 120.0, 100.0, 0.5), (1, 8, 0.2, 100.0, 100.0, 0.5)]
    s = marketgrid.slices(spark.createDataFrame(obs, "s int, expiry int, tau double, strike double, index double, iv double"), ["s"]).collect()
    assert len(s) == 1 and [(round(p.k, 6), round(p.w, 6), p.n) for p in s[0].points] == [(0.0, 0.13, 2), (round(float(np.log(1.1)), 6), 0.125, 1), (round(float(np.log(1.2)), 6), 0.125, 1)]


def test_calendar_deficit_on_the_shared_interval(spark):
    short, long = [(-0.2, 0.05), (0.0, 0.05), (0.2, 0.05)], [(-0.1, 0.04), (0.0, 0.04), (0.3, 0.04)]
    q = marketgrid.domain_quality(slices(spark, [(0.1, short), (0.2, long)]), ["s"]).first()
    assert q.calendar == 9 and q.insufficient == 0 and not q.ok
    assert q.least_overlap == pytest.approx(0.3) and q.calendar_max == pytest.approx(0.01) and q.calendar_sum == pytest.approx(0.09) and q.relative_max == pytest.approx(0.01 / 0.045)


def test_slices_without_a_shared_interval_are_insufficient(spark):
    q = marketgrid.domain_quality(slices(spark, [(0.1, [(-0.3, 0.05), (-0.2, 0.05), (-0.1, 0.05)]), (0.2, [(0.1, 0.04), (0.2, 0.04), (0.3, 0.04)])]), ["s"]).first()
    assert (q.insufficient, q.pairs, q.calendar, q.least_overlap, q.ok) == (1, 1, 0, 0.0, False)
    assert marketgrid.domain_quality(slices(spark, [(0.1, [(0.0, 0.1), (0.1, 0.1), (0.2, 0.1)])]), ["s"]).count() == 0


def test_channels_and_nearest_slices(spark):
    s = slices(spark, [(7 / 365, [(-0.4, 0.02), (0.0, 0.01), (0.2, 0.02)]), (60 / 365, [(-0.4, 0.05), (0.0, 0.04), (0.4, 0.05)])])
    c = {(round(r.tau, 4), r.i): r for r in marketgrid.quality_channels(marketgrid.shared_grid(s)).collect()}
    first = round(7 / 365, 4)
    assert [c[first, i].extrap for i in range(9)] == [False] * 7 + [True] * 2
    assert [c[first, i].interp for i in (0, 1, 4, 5)] == [False, True, False, True] and c[first, 8].weight == 0 and c[first, 4].log_n_obs == pytest.approx(np.log(2))
    n = {r.tenor: (round(r.tau * 365), r.interp) for r in marketgrid.nearest_slices(s, ["s"], (7, 30, 90)).collect()}
    assert n == {7: (7, False), 30: (7, True), 90: (60, True)}


def test_reasons_in_order(spark):
    s = slices(spark, [(0.1, [(0.0, 0.1), (0.1, 0.1), (0.2, 0.1)]), (0.2, [(0.0, 0.1), (0.1, float("nan")), (0.2, 0.1)])])
    snaps = spark.createDataFrame([(1,), (2,)], "s int")
    grid = marketgrid.shared_grid(s)
    told = lambda s, g: {r.s: r.reason for r in marketgrid.reasons(snaps, s, g, ["s"]).collect()}
    assert told(s, grid) == {1: "surface_grid_values", 2: "surface_missing"}
    assert told(s, grid.filter("i > 0"))[1] == "surface_grid_cell_count" and told(s.filter("tau < 0.15"), grid)[1] == "surface_parameter_rows"
    flat = slices(spark, [(0.1, [(0.0, 0.1), (0.1, 0.1), (0.2, 0.1)]), (0.2, [(0.0, 0.1), (0.0, 0.1), (0.2, 0.1)])])
    assert told(flat, marketgrid.shared_grid(flat))[1] == "surface_grid_axes"


def test_coherence_names_what_is_broken(spark):
    at = lambda h: dt.datetime(2024, 1, 5, h, tzinfo=UTC)
    good = {"w": [0.1, 0.2], "n_obs": [5, 5], "interp": [True, False], "extrap": [False, False], "rmse": [0.0, 0.1], "weight": [0.5, 1.0], "flags": ["interpolated_grid_cells"], "interp_fraction": 0.5, "extrap_fraction": 0.0, "n_reference": 5, "snap_ts": at(8), "max_source_ts": at(7)}
    cases = [
        ({}, []),
        ({"w": [0.1]}, ["list length"]),
        ({"w": None}, ["list length", "values"]),
        ({"w": [0.1, float("nan")]}, ["values"]),
        ({"rmse": [0.0, -1.0]}, ["values"]),
        ({"weight": [0.5, 1.5]}, ["weights"]),
        ({"n_obs": [4, 5]}, ["flags"]),
        ({"interp_fraction": 0.6}, ["interpolated share"]),
        ({"extrap": [False, True]}, ["flags", "extrapolated share"]),
        ({"max_source_ts": at(9)}, ["lookahead"]),
        ({"max_source_ts": None}, []),
    ]
    spec = "w array<double>, n_obs array<int>, interp array<boolean>, extrap array<boolean>, rmse array<double>, weight array<double>, flags array<string>, interp_fraction double, extrap_fraction double, n_reference int, snap_ts timestamp, max_source_ts timestamp"
    df = spark.createDataFrame([tuple((good | c).values()) for c, _ in cases], spec)
    assert [r.breaches for r in marketgrid.coherence(df.coalesce(1), 2).collect()] == [b for _, b in cases]


def test_snapshot_join_equals_the_general_one(spark):
    rng = np.random.default_rng(5)
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=int(m))
    right = [(["a", "b", None][rng.integers(3)], at(rng.integers(0, 20 * 1440)) if i % 9 else None, float(i), i) for i in range(60)] + [("a", dt.datetime(2024, 1, 3, 8, 5, tzinfo=UTC), -1.0, 900), ("a", dt.datetime(2024, 1, 3, 8, 5, tzinfo=UTC), -2.0, 901)]
    r = spark.createDataFrame(right, "k string, ts timestamp, v double, seq long")
    cells = spark.createDataFrame([(k, dt.date(2024, 1, d), d) for k in ("a", "b", "c") for d in range(1, 25)], "k string, snap_date date, id int")
    from ivlattice.functions.calendar import snap_ts

    for age in (None, 86_400_000_000):
        slow = asof.asof_backward(cells.withColumn("snap", snap_ts("snap_date")), r, ["k"], "snap", "ts", ["v"], ["seq"], age).drop("snap")
        fast = asof.at_snapshots(cells, r, ["k"], "ts", ["v"], ["seq"], max_age_us=age)
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_rows_beside_one_row_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 99), ("c", 98)], "k string, v int")
    per = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, m double")
    got = relational.beside(df, per, ["k"], "left").collect()
    assert len(got) == 52 and {(r.k, r.m) for r in got} == {("a", 1.0), (None, 2.0), ("c", None)} and got[0].asDict().keys() == {"k", "v", "m"}


def test_window_and_fold_rules(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d), float(d)) for d in (1, 2, 3, 4, 6, 7, 8, 9)], "k string, day date, x double")
    w = folds.lookback(rows, ["k"], "day", ["x"], length=2, horizon=1)
    assert w.count() == 4 and folds.window_breaches(w, "day", 2, 1).count() == 0
    assert {r.rule: r.n for r in folds.window_breaches(w, "day", 3, 1).collect()} == {"input count": 4, "consecutive days": 4, "last input": 4}
    d = lambda m: dt.date(2024, m, 1)
    f = spark.createDataFrame([(0, d(1), d(3), d(4), d(5)), (1, d(1), d(3), d(4), d(4)), (2, d(2), d(5), d(6), d(7))], "fold_id long, train_start date, train_end date, validation_end date, test_end date")
    assert {r.rule: r.n for r in folds.fold_breaches(f).collect()} == {"order of ranges": 1, "growing training": 1, "one start": 1}
    assert [r.inside for r in folds.fit_range_inside(f, "2024-01-01", "2024-04-01").orderBy("fold_id").collect()] == [False, False, False]
    assert [r.inside for r in folds.fit_range_inside(f, "2024-02-01", "2024-03-01").orderBy("fold_id").collect()] == [True, True, True]


def test_scalar_features_by_kind(spark):
    df = spark.createDataFrame([], "snap_date date, a double, b boolean, c string, dvol_source_ts timestamp, n long, g array<double>, left long")
    assert folds.scalar_features(df.schema, {"left"}) == ["a", "b", "n"]


def test_manifest_keeps_its_contract_and_units_are_fetched_again(spark, tmp_path):
    at = str(tmp_path / "m")
    row = lambda split: spark.createDataFrame([(0, DAY, split, True)], "fold_id long, day date, split string, tune_hyperparameters boolean")
    tables.write_manifest(row("train"), at)
    with pytest.raises(ContractError):
        tables.write_manifest(row("nonsense"), at)
    assert spark.read.parquet(at).first().split == "train"
    m = lambda *x: spark.createDataFrame([(v,) for v in x], "month string")
    assert sorted(r.month for r in tables.to_fetch(m("1", "2", "3", "4"), m("1", "2"), "month").collect()) == ["2", "3", "4"]
    assert sorted(r.month for r in tables.to_fetch(m("1"), m(), "month").collect()) == ["1"]


def test_days_without_rows_lose_their_folder(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3)], "snap_date date, v int")
    tables.write_days(rows, at)
    tables.replace_days(rows.filter("v = 2").withColumn("v", F.lit(9)), at, rows.filter("v > 1").select("snap_date"))
    assert sorted((r.snap_date.day, r.v) for r in spark.read.parquet(at).collect()) == [(1, 1), (2, 9)]
    (tmp_path / "t" / "snap_date=what").mkdir()
    (tmp_path / "t" / "other").mkdir()
    assert sorted(r.snap_date.day for r in tables.partition_days(spark, at).collect()) == [1, 2]


def test_moments_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1e-3, (200, 3)) + 1e6
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(7)
    m = pca.moments(df, "v").orderBy("i").toPandas()
    want = np.cov(x.T, bias=True)
    assert np.allclose(np.stack(m["covariance"].to_numpy()), want, rtol=1e-4, atol=1e-12) and np.allclose(m["mean"], x.mean(0), rtol=1e-14)
