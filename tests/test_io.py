"""Sources, sinks and streaming."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ivlattice import contracts
from ivlattice.operators import badrows
from ivlattice.sources import tables
from ivlattice.streaming import collect

UTC = dt.timezone.utc
SNAPS = [
    {"snap_ts": "2024-01-01T08:00:00+00:00", "currency": "BTC", "index_price": 1.0, "book_summary": [{"instrument_name": "A", "open_interest": 5.0, "volume": 1.0}, {"instrument_name": "B", "open_interest": -1.0}, {"open_interest": 2.0}]},
    {"snap_ts": "2024-01-01T09:00:00+00:00", "currency": "BTC", "index_price": 1.0, "book_summary": [{"instrument_name": "A", "open_interest": 7.0, "volume": None}]},
    {"snap_ts": "nonsense", "currency": "BTC", "book_summary": [{"instrument_name": "A", "open_interest": 9.0}]},
]


def test_snapshots_batch_and_stream_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, SNAPS), "{broken"]))
    batch = tables.collected_interest(tables.read_snapshots(spark, str(tmp_path / "in")))
    rows = {(r.instrument, r.open_interest) for r in batch.collect()}
    assert rows == {("A", 5.0), ("A", 7.0)}
    live = collect.stream_interest(spark, str(tmp_path / "in")).withColumn("snap_date", F.to_date("source_ts"))
    q = collect.write_stream_days(live, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert {(r.instrument, r.open_interest) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == rows


def test_stream_keeps_one_copy_and_totals_days(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m, tzinfo=UTC)
    rows = [("a", t(7), 1.0), ("a", t(7), 1.0), ("b", t(8, 5), 2.0), ("c", t(8, 6), 4.0)]
    spark.createDataFrame(rows, "id string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = collect.once_within(src, "ts", ["id"]).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("once").count() == 3
    q = collect.day_totals(src, "ts", [], "v").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(str(r.snap_date), r.total, r.n) for r in spark.table("totals").collect()} == {("2024-01-01", 4.0, 3), ("2024-01-02", 4.0, 1)}


def test_written_days_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, v: (dt.date(2024, 1, d), v)
    make = lambda rows: spark.createDataFrame(rows, "snap_date date, v long")
    tables.write_days(make([day(1, 1), day(1, 2), day(2, 3)]), path)
    tables.write_days(make([day(2, 9)]), path)
    assert {(r.snap_date.day, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (1, 2), (2, 9)}


def test_scan_of_absent_and_present_tables(spark, tmp_path):
    empty = tables.scan(spark, str(tmp_path / "none"), contracts.FUNDING)
    assert empty.count() == 0 and "interest_8h" in empty.columns
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, tzinfo=UTC), "X", 0.1, 0.2, 3.0, "2024-01")], "ts timestamp, instrument string, interest_1h double, interest_8h double, index_price double, month string")
    df.write.partitionBy("month").parquet(str(tmp_path / "f"))
    got = tables.scan(spark, str(tmp_path / "f"), contracts.FUNDING)
    assert got.count() == 1 and "month" not in got.columns
    raw = spark.read.parquet(str(tmp_path / "f"))
    plan = tables.between(raw, "ts", "2024-01-01", "2024-01-31", "month")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_csv_lines_round_trip(spark, tmp_path):
    good = "deribit,BTC-5JUL24-7.5-P,1,2,put,7.5,1720166400000,1,,0.1,2,10,.5,3,4,5,6,SYN,1,2,3,4,5,6"
    (tmp_path / "x.csv").write_text(",".join(badrows.COLUMNS) + "\n" + good + "\n" + "bad\n")
    lines = tables.read_lines(spark, str(tmp_path / "x.csv"))
    assert badrows.loaded_lines(lines).count() == 1 and [r.reason for r in badrows.broken_lines(lines).collect()] == ["columns"]
    (tmp_path / "z.csv").write_text(",".join(badrows.COLUMNS) + "\n" + good + "\n" + ",".join(badrows.COLUMNS) + "\n")
    again = tables.read_lines(spark, str(tmp_path / "z.csv"))
    assert badrows.loaded_lines(again).count() == 1 and [r.reason for r in badrows.broken_lines(again).collect()] == ["value"]
    (tmp_path / "y.csv").write_text(",".join(badrows.COLUMNS) + "\n" + good + "\n")
    assert tables.read_chain_csv(spark, str(tmp_path / "y.csv")).first().strike_price == 7.5


def test_manifest_and_most_liquid(spark):
    todo = spark.createDataFrame([("2024-01",), ("2024-02",)], "month string")
    assert [r.month for r in tables.unseen(todo, todo.limit(1), ["month"]).collect()] == ["2024-02"]
    s = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 2.0)], "instrument string, volume double")
    assert [r.instrument for r in tables.most_liquid(s, 2).collect()] == ["b", "c"]


def test_payload_pages_become_tables(spark):
    from ivlattice.sources import payloads

    trade = lambda i, block=None: {"timestamp": 1000 + i, "instrument_name": "BTC-8APR22-40000-C", "price": 0.05, "iv": 65.0, "amount": 1.0, "index_price": 45000.0, "trade_id": str(i), **({"block_trade_id": block} if block else {})}
    pages = spark.createDataFrame([(1, json.dumps({"trades": [trade(1), trade(2, "b")]})), (2, json.dumps({"trades": [trade(2), trade(3)]})), (3, "broken"), (4, None)], "page long, body string")
    got = {r.trade_id: r for r in payloads.trades(pages).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].block_flag and not got["3"].block_flag and got["1"].strike == 40000.0
    one = lambda body, **key: spark.createDataFrame([(1, *key.values(), json.dumps(body))], "page long, " + "".join(f"{k} string, " for k in key) + "body string")
    c = payloads.candles(one({"ticks": [0, 3600000], "open": [1.0, 2.0], "high": [3.0, 4.0], "low": [0.5, 1.0], "close": [2.0, 3.0], "volume": [1.0, 1.0]}, instrument="X"))
    assert c.count() == 2
    v = payloads.volatility_index(one({"data": [[0, 1, 2, 0.5, 1.5], [3600000, 1, 2, 0.5, 1.6]]}, currency="BTC")).collect()
    assert sorted(r.close for r in v) == [1.5, 1.6]
    f = payloads.funding(one([{"timestamp": 0, "interest_1h": 0.1, "interest_8h": 0.2, "index_price": 1.0}], instrument="P")).first()
    assert f.interest_8h == 0.2
    assert payloads.deliveries(one({"data": [{"date": "2024-01-01", "delivery_price": 5.0}], "records_total": 1}, index="i")).first().delivery_price == 5.0
    i = payloads.instruments(one([{"instrument_name": "A", "kind": "option", "expiration_timestamp": 0, "strike": 1.0, "option_type": "put"}])).first()
    assert i.cp == "P" and i.creation_ts is None


def test_batches_of_one_day_all_stay_and_a_replay_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, hour in (("a", 8), ("b", 9)):
        line = SNAPS[0] | {"snap_ts": f"2024-01-01T0{hour}:00:00+00:00", "book_summary": [{"instrument_name": name, "open_interest": 1.0}]}
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(line))
    live = collect.collected_interest(collect.stream_snapshots(spark, str(tmp_path / "in"), per_batch=1)).withColumn("snap_date", F.to_date("source_ts"))
    out = str(tmp_path / "out")
    assert collect.write_stream_days(live, out, str(tmp_path / "ck")).awaitTermination(60)
    names = lambda: sorted(r.instrument for r in spark.read.parquet(out).collect())
    assert names() == ["a", "b"]
    again = spark.read.parquet(f"{out}/batch_id=1")
    collect.write_batch(spark.createDataFrame(again.collect(), again.schema), out, 1, ["snap_date"])
    assert names() == ["a", "b"]
    collect.compact_days(spark, out, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from ivlattice import session

    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(SimpleNamespace(sparkContext=sc, conf=conf))
