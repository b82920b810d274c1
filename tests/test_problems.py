"""The general numbered operators against brute force and on their defined edge cases."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ivlattice.operators import badrows, deliveries, knownat, regulargrid, sortedruns, spikes, trailing
from ivlattice.operators.shardedtime import tiled


# ---- p1 ----


def test_deliveries_keep_one_of_each(spark):
    rows = [("a", 3, 1.0), ("a", 1, 2.0), ("a", 2, None), ("b", 9, 1.0), (None, 4, 1.0), (None, 5, 1.0)]
    df = spark.createDataFrame(rows, "id string, seq long, v double")
    gone = {r.seq for r in deliveries.surplus_copies(df, [F.col("id")], ["seq"], "seq").collect()}
    assert gone == {2, 3}
    kept = {r.seq for r in deliveries.first_deliveries(df, [F.col("id")], ["seq"], "seq").collect()}
    assert kept == {1, 4, 5, 9}
    assert deliveries.surplus_copies(df.limit(0), [F.col("id")], ["seq"], "seq").count() == 0


def test_deliveries_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 5, 7), ("a", 2, 6, 8)], "id string, seq long, k0 int, rank int")
    out = deliveries.first_deliveries(df, [F.col("id")], ["seq"], "seq").collect()
    assert [tuple(r) for r in out] == [("a", 1, 5, 7)]


# ---- p2 ----


def _series(n, seed=1):
    rng = np.random.default_rng(seed)
    return 60 * np.exp(np.cumsum(rng.normal(0, 0.003, n)) + rng.normal(0, 0.01, n))


def _flags(spark, values, source="X", **kw):
    rows = [("iv", source, int(i) * 60_000_000, str(i), i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "kind string, source string, at long, record string, row_key long, value double")
    lim = {"iv": spikes.Limits(2.0, 1000.0, 0.045)}
    return {r.row_key: r.flag for r in spikes.flag_readings(df, lim, **kw).collect()}


def test_spikes_stuck_and_impossible_values(spark):
    v = _series(400).tolist()
    v[50] *= 2.5
    v[120], v[121] = v[120] * 0.3, v[121] * 0.3
    v[200] = -5.0
    v[201] = 99999.99
    v[300:310] = [v[300]] * 10
    v[350:357] = [v[350]] * 7
    v[10] = None
    v[11] = float("nan")
    want = {50: "spike", 120: "spike", 121: "spike", 200: "out_of_range", 201: "out_of_range", **{i: "stuck" for i in range(300, 310)}}
    assert _flags(spark, v) == want
    # many small tiles with halos give the same flags
    assert _flags(spark, v, size=100, cell_us=600_000_000) == want


def test_lasting_changes_are_no_spikes(spark):
    v = np.concatenate([_series(60, 2), _series(60, 3) * 2.2, _series(60, 4)])
    assert _flags(spark, v) == {}


def test_copies_share_flags_and_count_once(spark):
    v = _series(60)
    rows = [("iv", "X", int(i) * 1000, str(i), i, float(x)) for i, x in enumerate(v)]
    rows[30] = (*rows[30][:5], float(v[30] * 3))
    rows += [(*rows[30][:4], 1000 + j, rows[30][5]) for j in range(3)]
    rows += [(*rows[40][:4], 2000 + j, rows[40][5]) for j in range(20)]
    df = spark.createDataFrame(rows, "kind string, source string, at long, record string, row_key long, value double")
    got = {r.row_key: r.flag for r in spikes.flag_readings(df, {"iv": spikes.Limits(2, 1000, 0.045)}).collect()}
    assert got == {k: "spike" for k in (30, 1000, 1001, 1002)}


def test_short_and_empty_series(spark):
    assert _flags(spark, [50.0]) == {}
    assert _flags(spark, [-1.0]) == {0: "out_of_range"}
    df = spark.createDataFrame([], "kind string, source string, at long, record string, row_key long, value double")
    assert spikes.flag_readings(df, {}).count() == 0


def test_tiles_cover_rows_once_with_halos(spark):
    rng = random.Random(2)
    at = sorted(rng.randint(0, 10_000) for _ in range(500))
    df = spark.createDataFrame([("A", t, i) for i, t in enumerate(at)] + [("B", 5, 900), (None, 5, 901), ("B", None, 902)], "s string, at long, id long")
    out = tiled(df, ["s"], "at", 50, 60, 20).collect()
    core = [r for r in out if r["__core"]]
    assert sorted(r.id for r in core) == sorted([*range(500), 900])
    tiles = {}
    for r in core:
        if r.s == "A":
            tiles.setdefault(r["__tile"], []).append(r.id)
    for t, ids in tiles.items():
        seen = {r.id for r in out if r.s == "A" and r["__tile"] == t}
        assert set(range(max(0, min(ids) - 20), min(500, max(ids) + 21))) <= seen or len(tiles) == 1 or any(len(x) < 20 for x in tiles.values())


# ---- p3 ----

GOOD = "deribit,BTC-5JUL24-7.5-P,1719184246891636,1719184246932678,put,7.50,1720166400000,1,,0.1,+2,1e1,.5,3.,4,5,-6,SYN,1,2,3,4,5,6"


def change(i, value):
    f = GOOD.split(",")
    f[i] = value
    return ",".join(f)


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None),
        (GOOD + "\r", None),
        (GOOD + "\r\r", "value"),
        ('"' + GOOD.replace(",", '","') + '"', None),
        (change(17, '"a, ""b"""'), None),
        (change(17, '"a" b'), "quoting"),
        (change(17, 'a "b"'), "quoting"),
        (change(17, ' "b"'), "quoting"),
        (change(0, '"open'), "quoting"),
        (GOOD + ",", "columns"),
        (GOOD.replace(",", ";"), "columns"),
        ("", "columns"),
        (None, "columns"),
        (change(1, " BTC-5JUL24-7.5-P "), None),
        (change(1, "BTC-05JUL24-7.5-P"), None),
        (change(1, "BTC-31JUN24-7.5-P"), "value"),
        (change(1, "btc-5JUL24-7.5-P"), "value"),
        (change(1, "BTC-5JUL24-8-P"), "value"),
        (change(1, ""), "value"),
        (change(2, "0"), "value"),
        (change(2, "1.0"), "value"),
        (change(2, "-5"), "value"),
        (change(2, "１２"), "value"),
        (change(4, "call"), "value"),
        (change(4, "PUT"), "value"),
        (change(5, "0"), "value"),
        (change(6, "1720166400001"), "value"),
        (change(7, "nan"), "value"),
        (change(7, "inf"), "value"),
        (change(7, "1e999"), "value"),
        (change(7, "1 000"), "value"),
        (change(7, "1 000"), "value"),
        (change(7, "--"), "value"),
        (change(7, "0x10"), "value"),
        (change(7, "  "), None),
    ],
)
def test_reasons(line, reason):
    assert badrows.diagnose(line)[0] == reason
    if line is not None:
        _, doubt = badrows.bulk_parse(pa.array([line]))
        assert reason is None or doubt.all()
        if reason is None:
            plain = line.replace("+2", "2").replace(",.5", ",0.5").replace(",3.,", ",3,").replace('".5"', '"0.5"').replace('"3."', '"3"')
            assert not badrows.bulk_parse(pa.array([plain]))[1].any()


def test_bulk_equals_strict():
    rng = random.Random(4)
    lines = [change(rng.randint(0, 23), rng.choice(["1", "", "x", '"q"', '"', " 2 ", "-1e-3", "1e400"])) for _ in range(300)] + [GOOD] * 300
    rng.shuffle(lines)
    strict = [badrows.diagnose(x) for x in lines]
    got = {}
    for start, n, records, reasons in badrows.parse_block(pa.array(lines)):
        for i, (reason, record) in enumerate(zip(reasons, records.to_pylist())):
            got[start + i] = (reason, record)
    assert [got[i] for i in range(len(lines))] == strict


def test_only_doubtful_lines_are_left_to_the_strict_reader(monkeypatch):
    plain = change(10, "2").replace(",.5", ",0.5").replace(",3.,", ",3,")
    lines = [plain] * 500
    for i in range(0, 500, 25):
        lines[i] = plain + ","
    seen = []
    monkeypatch.setattr(badrows, "diagnose", lambda x, strict=badrows.diagnose: seen.append(x) or strict(x))
    told = [r for *_, reasons in badrows.parse_block(pa.array(lines)) for r in reasons]
    assert len(seen) == 20 and told == ["columns" if i % 25 == 0 else None for i in range(500)]


def test_headers_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, "exchange"), (2, 2, GOOD), (3, 3, "x"), (4, None, None)], "line_id long, line_no int, raw_line string")
    assert {(r.line_id, r.reason) for r in badrows.broken_lines(df).collect()} == {(3, "columns"), (4, "columns")}
    assert [r.line_id for r in badrows.loaded_lines(df).collect()] == [2]
    assert badrows.parse_lines(df.limit(0)).count() == 0


# ---- p4 ----


def test_known_at(spark):
    rng = random.Random(6)
    pick = lambda: rng.choice(["a"] * 8 + ["b", None])
    events = [(i, pick(), rng.choice([None, *range(0, 1000)])) for i in range(300)]
    changes = [(pick(), rng.choice([None, *range(0, 1000)]), rng.randint(0, 60), i) for i in range(200)]
    e = spark.createDataFrame(events, "event_id long, entity string, at long")
    c = spark.createDataFrame(changes, "entity string, known long, valid long, seq long")
    want = {}
    for i, x, t in events:
        seen = [(v, s) for y, k, v, s in changes if t is not None and x is not None and x == y and k is not None and k <= t]
        if seen:
            want[i] = max(seen)[1]
    for bucket in (50, 300, 10_000):
        assert {r.event_id: r.known_seq for r in knownat.known_at(e, c, bucket).collect()} == want
    assert knownat.known_at(e.limit(0), c).count() == 0
    assert knownat.known_at(e, c.limit(0)).count() == 0


# ---- p5 ----


def test_trailing_totals(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice([*range(0, 40), *range(300, 330)]), rng.choice([None, rng.random()])) for _ in range(200)] + [("c", 5, 1.0), (None, 1, 1.0), ("d", 3, None)]
    got = {(r.entity, r.day): r for r in trailing.trailing_totals(spark.createDataFrame(rows, "entity string, day long, value double"), (3, 10), tile=16).collect()}
    want = {}
    for e in "abc":
        own = [(d, v) for x, d, v in rows if x == e and v is not None]
        for day in range(min(d for d, _ in own), max(d for d, _ in own) + 1):
            want[(e, day)] = tuple(sum(v for d, v in own if day - w < d <= day) for w in (3, 10)) + tuple(sum(1 for d, _ in own if day - w < d <= day) for w in (3, 10))
    assert set(got) == set(want)
    for k, (s3, s10, n3, n10) in want.items():
        r = got[k]
        assert (r.n3, r.n10) == (n3, n10) and abs(r.sum3 - s3) < 1e-9 and abs(r.sum10 - s10) < 1e-9
        assert (r.avg3 is None) == (n3 == 0) and (n10 == 0 or abs(r.avg10 - s10 / n10) < 1e-9)


def test_trailing_sums_are_exact_with_digits(spark):
    rng = random.Random(9)
    rows = [("a", rng.randint(0, 50), rng.randint(1, 10**9) / 10**4) for _ in range(500)]
    df = spark.createDataFrame(rows, "entity string, day long, value double").repartition(7)
    got = {r.day: (r.sum5, r.avg5) for r in trailing.trailing_totals(df, (5,), tile=16, digits=4, most=20).collect()}
    for day, (s, avg) in got.items():
        own = [round(v * 10**4) for _, d, v in rows if day - 5 < d <= day]
        assert s == sum(own) / 10**4 and avg == s / len(own)


# ---- p7 ----


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_regular_grid(spark, width):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([*range(-20, 30), *range(90, 110)]), rng.choice([None, rng.random()]), i) for i, _ in enumerate(range(60))] + [("c", 3, None, 1), ("d", 3, 1.0, 1), (None, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "source string, slot long, value double, order long")
    got = {(r.source, r.slot): (r.value, r.missing) for r in regulargrid.regular_grid(df, width).collect()}
    want = {}
    for s in "abd":
        own = {}
        for _, t, v, o in sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: r[3]):
            own[t] = v
        last = None
        for t in range(min(own), max(own) + 1):
            last = own.get(t, last)
            want[(s, t)] = (last, t not in own)
    assert got == want
    missing = {(r.source, r.slot) for r in regulargrid.missing_slots(df, width).collect()}
    assert missing == {k for k, (_, m) in want.items() if m}
    with_null = {(r.source, r.slot) for r in regulargrid.missing_slots(df, width, need_value=False).collect()}
    assert ("c", 3) not in with_null and with_null <= missing | {k for k in with_null}
    assert regulargrid.missing_slots(df.limit(0), width).count() == 0


@pytest.mark.parametrize("partitions", [2, 8])
def test_frames_are_bounded_whatever_the_partitions(spark, partitions):
    """Whole keys in frames of at most ``most`` rows and the rest of one key; a long key in parts where that is allowed."""
    rows = [(i % 7 if i % 3 else 99, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        whole = sortedruns.in_runs(df, ["k"], lambda f: f.groupby("k").agg(n=("v", "size"), size=("v", lambda _: len(f))).reset_index(), "k long, n long, size long", most=200).collect()
        assert {r.k: r.n for r in whole} == {k: sum(x == k for x, _ in rows) for k in (*range(7), 99)} and len(whole) == 8
        assert all(r["size"] < 200 + 286 for r in whole if r.k != 99)

        def cut(batches):
            for f, goes_on in sortedruns.cut_frames(batches, 200):
                yield pd.DataFrame({"n": [len(f)], "last": [f["k"].iloc[-1]], "goes_on": [goes_on]})

        parts = sortedruns.placed(df, ["k"], ["v"]).mapInPandas(cut, "n long, last long, goes_on boolean").collect()
        assert sum(r.n for r in parts) == 3000 and max(r.n for r in parts) == 200 and any(r.goes_on and r["last"] == 99 for r in parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cuts_at_the_edges_of_batches():
    key = [1] * 6 + [2] * 2
    for size in range(1, 9):
        for most in range(1, 9):
            rows = pd.DataFrame({sortedruns.KEY: key, "v": range(8)})
            parts = [rows.iloc[i : i + size] for i in range(0, 8, size)]
            for batches in (parts, [pa.RecordBatch.from_pandas(p, preserve_index=False) for p in parts]):
                got = [(list(f["v"].to_numpy()), goes_on) for f, goes_on in sortedruns.cut_frames(iter(batches), most)]
                assert [v for f, _ in got for v in f] == list(range(8)) and all(len(f) == most for f, _ in got[:-1])
                assert [g for _, g in got] == [f[-1] not in (5, 7) for f, _ in got]
            whole = [list(f["v"]) for f in sortedruns.whole_keys(iter(parts), most)]
            assert whole == [list(range(6)), [6, 7]] if most <= 6 else whole == [list(range(8))]


def test_known_at_over_cut_frames(spark):
    """An entity's day longer than a frame goes on with its best version."""
    rng = random.Random(16)
    events = [(i, "a" if i % 4 else "b", rng.randint(0, 500)) for i in range(400)]
    changes = [("a" if i % 3 else "b", rng.randint(0, 500), rng.randint(0, 60), i) for i in range(120)]
    e = spark.createDataFrame(events, "event_id long, entity string, at long")
    c = spark.createDataFrame(changes, "entity string, known long, valid long, seq long")
    want = {i: max(seen)[1] for i, x, t in events if (seen := [(v, s) for y, k, v, s in changes if x == y and k <= t])}
    for most in (1, 7, 50):
        assert {r.event_id: r.known_seq for r in knownat.known_at(e, c, 300, most).collect()} == want


def test_day_of_symbol():
    assert badrows.symbol_parts("BTC-29FEB24-1-C")[0] == dt.date(2024, 2, 29)
    assert badrows.symbol_parts("BTC-29FEB23-1-C") is None


def test_filled_series_of_candles_and_trades(spark, tmp_path):
    from ivlattice.plans import problems

    at = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute, tzinfo=dt.timezone.utc)
    ohlc = [(at(1, 5), "F", 1.0, 9), (at(1, 20), "F", 2.0, 1), (at(1, 20), "F", 3.0, 2), (at(1, 23), "F", None, 3), (at(3, 0), "F", 4.0, 4)]
    trades = [(at(1, 22, 1), " x", 5.0, 1), (at(1, 22, 2), "X", None, 2), (at(2, 0), "X", None, 3), (at(2, 1), "x ", 6.0, 4), (at(4, 0), "X", 7.0, 5)]
    spark.createDataFrame(ohlc, "ts timestamp, instrument string, close double, ingest_seq long").write.parquet(f"{tmp_path}/ohlc.parquet")
    spark.createDataFrame(trades, "ts timestamp, instrument string, price_btc double, ingest_seq long").write.parquet(f"{tmp_path}/trades_options.parquet")
    got = lambda name: sorted(tuple(r) for r in problems.QUERIES[name](spark, str(tmp_path)).collect())
    day = lambda n: f"2024-01-0{n} 00:00:00"
    assert got("p7_filled_ohlc_daily") == [("F", day(1), 3.0, False), ("F", day(2), 3.0, True), ("F", day(3), 4.0, False)]
    assert got("p7_filled_trades_daily") == [("X", day(1), 5.0, False), ("X", day(2), 6.0, False), ("X", day(3), 6.0, True), ("X", day(4), 7.0, False)]
    hours = got("p7_filled_trades")
    assert len(hours) == 51 and hours[:4] == [("X", f"2024-01-01 {h}:00:00", 5.0, h == 23) for h in (22, 23)] + [("X", day(2), 5.0, False), ("X", "2024-01-02 01:00:00", 6.0, False)]
    assert all(r[2:] == (6.0, True) for r in hours[4:-1]) and hours[-1] == ("X", day(4), 7.0, False)
