"""The general numbered problems as queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice.functions import black76
from ivlattice.operators import badrows, deliveries, knownat, regulargrid, spikes, trailing
from ivlattice.session import clean_name, day_text, floor_div, hour_text, micros, table, utc_day, utc_hour


def _trade_key(column: str = "trade_id"):
    return F.lower(F.trim(column))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    trades, funding = table(spark, d, "trades_options"), table(spark, d, "funding")
    a = deliveries.surplus_copies(trades, [_trade_key()], ["ingest_seq", "ingest_ts"], "ingest_seq")
    b = deliveries.surplus_copies(funding, [F.col("instrument"), F.col("ts")], ["ingest_seq", "ingest_ts"], "ingest_seq")
    return a.select(F.lit("trades_options").alias("table_name"), "ingest_seq").unionByName(b.select(F.lit("funding").alias("table_name"), "ingest_seq"))


def p1_kept_trades(spark: SparkSession, d: str) -> DataFrame:
    kept = deliveries.first_deliveries(table(spark, d, "trades_options"), [_trade_key()], ["ingest_seq", "ingest_ts"], "ingest_seq")
    return kept.select("ingest_seq", "trade_id", clean_name("instrument").alias("instrument"), "price_btc", "iv", "amount")


# Bounds of a volatility in percent and of an option price in coins, with the least scatter of their logarithms.
LIMITS = {
    "iv": spikes.Limits(low=2.0, high=1000.0, floor=0.035),
    "mark_iv": spikes.Limits(low=2.0, high=1000.0, floor=0.035),
    "price_btc": spikes.Limits(low=0.0, high=10.0, floor=0.12, offset=0.002, stuck=False),
}


def _contract(name: str) -> tuple[float, float, float]:
    """(strike, +1 or -1, expiry in microseconds) of an option's name; NaN if it isn't one."""
    parts = badrows.symbol_parts(name)
    if parts is None:
        return np.nan, np.nan, np.nan
    return parts[1], 1.0 if parts[2] == "call" else -1.0, np.datetime64(parts[0], "us").astype(float) + 8 * 3_600e6


def _price_level(g: pd.DataFrame, series: np.ndarray) -> np.ndarray:
    """What an option's price should be by its neighbours' volatility and its index, whose moves are genuine."""
    iv = g["iv"].to_numpy(float)
    iv = spikes.side_median(np.where((iv > 2) & (iv < 1000), iv, np.nan), series)
    index = g["index_price"].groupby(series).transform(lambda s: s.ffill().bfill()).to_numpy(float)
    names = g["source"].unique()
    about = pd.DataFrame([_contract(x) for x in names], index=names).loc[g["source"]].to_numpy(float)
    strike, cp, years = about[:, 0], about[:, 1], (about[:, 2] - g["at"].to_numpy()) / 31_536_000e6
    index = np.where(index > 0, index, strike)
    p = black76.np_price(index, strike, years, np.nan_to_num(iv, nan=70.0) / 100, cp) / index
    return np.where(np.isfinite(p), np.maximum(p, 0), 0.05)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades_options")
    about = [
        clean_name("instrument").alias("source"),
        micros("ts").alias("at"),
        F.coalesce(_trade_key(), F.concat(F.lit("#"), F.col("ingest_seq"))).alias("record"),
        F.col("ingest_seq").alias("row_key"),
    ]
    none = F.lit(None).cast("double")
    price = trades.select(F.lit("price_btc").alias("kind"), *about, F.col("price_btc").alias("value"), "iv", "index_price")
    iv = trades.select(F.lit("iv").alias("kind"), *about, F.col("iv").alias("value"), none.alias("iv"), none.alias("index_price"))
    quotes = table(spark, d, "tardis_sample").select(
        F.lit("mark_iv").alias("kind"),
        clean_name("symbol").alias("source"),
        F.col("timestamp").alias("at"),
        F.col("timestamp").cast("string").alias("record"),
        F.col("quote_id").alias("row_key"),
        F.col("mark_iv").alias("value"),
        none.alias("iv"),
        none.alias("index_price"),
    )
    rows = price.unionByName(iv).unionByName(quotes)
    return spikes.flag_readings(rows, LIMITS, {"price_btc": _price_level}, ["iv", "index_price"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    home = F.when(F.col("kind") == "mark_iv", "tardis_sample").otherwise("trades_options")
    return _flags(spark, d).select(home.alias("table_name"), "row_key", F.col("kind").alias("field_name"))


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy(F.col("kind").alias("field_name"), "flag").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.broken_lines(table(spark, d, "tardis_raw"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded_lines(table(spark, d, "tardis_raw"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades_options").filter("block_flag").select("ingest_seq", clean_name("instrument").alias("i"), micros("ts").alias("at"))
    ccy = F.split_part("i", F.lit("-"), F.lit(1))
    wanted = F.array(
        F.concat(F.lit("dvol|"), ccy),
        F.concat(F.lit("funding|"), ccy, F.lit("-PERPETUAL")),
        F.concat(F.lit("trades_futures|"), F.substring_index("i", "-", 2)),
    )
    events = trades.select(F.col("ingest_seq").alias("event_id"), "at", F.explode(wanted).alias("entity"))

    def changes(name: str, key: str, value: str) -> DataFrame:
        return (
            table(spark, d, name)
            .filter(F.col(value).isNotNull())
            .select(
                F.concat(F.lit(name + "|"), F.col(key)).alias("entity"),
                micros("ingest_ts").alias("known"),
                micros("ts").alias("valid"),
                F.col("ingest_seq").alias("seq"),
            )
        )

    known = changes("dvol", "currency", "close").unionByName(changes("funding", "instrument", "interest_8h")).unionByName(changes("trades_futures", "instrument", "price"))
    out = knownat.known_at(events, known)
    return out.select(F.col("event_id").alias("event_seq"), F.split_part("entity", F.lit("|"), F.lit(1)).alias("table_name"), F.col("known_seq"))


def _closes(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str) -> DataFrame:
        t = table(spark, d, name).select(F.concat(F.lit(name + "|"), F.col(key)).alias("entity"), utc_hour("ts").alias("hour"), "close", "ingest_seq")
        return trailing.hourly_latest(t, "entity", "hour", "close", "ingest_seq")

    both = of("ohlc", "instrument").unionByName(of("dvol", "currency"))
    return both.select("entity", floor_div(F.col("hour"), 24).alias("day"), F.col("close").alias("value"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "table_name": F.substring_index("entity", "|", 1),
            "entity": F.expr("substring(entity, instr(entity, '|') + 1)"),
            "day_utc": day_text(F.col("day")),
        }
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.trailing_totals(_closes(spark, d), digits=8)
    return _named(t.filter((F.col("n7") > 0) & (F.abs(F.try_divide("avg7", "avg30") - 1) >= 0.2))).select("table_name", "entity", "day_utc")


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = _named(trailing.trailing_totals(_closes(spark, d), digits=8))
    return t.select("table_name", "entity", "day_utc", "n7", "n30", "sum7", "sum30", "avg7", "avg30")


def _ohlc_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ohlc").select(F.col("instrument").alias("source"), utc_hour("ts").alias("slot"), F.col("close").alias("value"), F.col("ingest_seq").alias("order"))


def _trade_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trades_options").select(
        clean_name("instrument").alias("source"), utc_day("ts").alias("slot"), F.col("price_btc").alias("value"), F.struct(micros("ts").alias("t"), F.col("ingest_seq").alias("s")).alias("order")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    hours = regulargrid.missing_slots(_ohlc_readings(spark, d), width=24 * 32)
    days = regulargrid.missing_slots(_trade_readings(spark, d), width=256, need_value=False)
    a = hours.select(F.lit("ohlc").alias("table_name"), F.col("source").alias("instrument"), hour_text(F.col("slot")).alias("slot_start"))
    b = days.select(F.lit("trades_options").alias("table_name"), F.col("source").alias("instrument"), hour_text(F.col("slot") * 24).alias("slot_start"))
    return a.unionByName(b)


def p7_filled_ohlc(spark: SparkSession, d: str) -> DataFrame:
    g = regulargrid.regular_grid(_ohlc_readings(spark, d), width=24 * 32)
    return g.select(F.col("source").alias("instrument"), hour_text(F.col("slot")).alias("slot_start"), "value", "missing")


def p7_filled_ohlc_daily(spark: SparkSession, d: str) -> DataFrame:
    hour = F.struct(F.col("slot").alias("h"), F.col("order").alias("s"))
    days = _ohlc_readings(spark, d).select("source", "value", hour.alias("order"), floor_div(F.col("slot"), 24).alias("slot"))
    return _filled(days, 256, 24, need_value=True)


def _filled(readings: DataFrame, width: int, hours: int, need_value: bool) -> DataFrame:
    g = regulargrid.regular_grid(readings, width, need_value)
    return g.select(F.col("source").alias("instrument"), hour_text(F.col("slot") * hours).alias("slot_start"), "value", "missing")


def _priced_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades of which the last with a price gives a slot its value."""
    t = table(spark, d, "trades_options").withColumn("order", F.struct(micros("ts").alias("t"), F.col("ingest_seq").alias("s")))
    return t.select(clean_name("instrument").alias("source"), "ts", F.col("price_btc").alias("value"), F.when(F.col("price_btc").isNotNull(), F.col("order")).alias("order"))


def p7_filled_trades(spark: SparkSession, d: str) -> DataFrame:
    return _filled(_priced_trades(spark, d).withColumn("slot", utc_hour("ts")), 24 * 32, 1, need_value=False)


def p7_filled_trades_daily(spark: SparkSession, d: str) -> DataFrame:
    return _filled(_priced_trades(spark, d).withColumn("slot", utc_day("ts")), 256, 24, need_value=False)


QUERIES = {f.__name__: f for f in (p1_found, p1_kept_trades, p2_found, p2_flags, p3_found, p3_loaded, p4_found, p5_found, p5_trailing, p7_found, p7_filled_ohlc, p7_filled_ohlc_daily, p7_filled_trades, p7_filled_trades_daily)}

_CLOSES = """
WITH raw AS (
  SELECT 'ohlc' AS table_name, instrument AS entity, epoch_us(ts) // 3600000000 AS h, close, ingest_seq FROM ohlc WHERE close IS NOT NULL
  UNION ALL SELECT 'dvol', currency, epoch_us(ts) // 3600000000, close, ingest_seq FROM dvol WHERE close IS NOT NULL),
hourly AS (SELECT table_name, entity, h, arg_max(close, ingest_seq) AS close FROM raw GROUP BY ALL),
daily AS (SELECT table_name, entity, h // 24 AS day, sum(CAST(round(close * 1e8) AS HUGEINT)) AS s, count(*) AS n FROM hourly GROUP BY ALL),
span AS (SELECT table_name, entity, unnest(generate_series(min(day), max(day))) AS day FROM daily GROUP BY table_name, entity),
full_days AS (SELECT p.table_name, p.entity, p.day, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n FROM span p LEFT JOIN daily d USING (table_name, entity, day)),
roll AS (SELECT table_name, entity, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day_utc,
  CAST(sum(s) OVER w7 AS DOUBLE) / 1e8 AS s7, sum(n) OVER w7 AS c7, CAST(sum(s) OVER w30 AS DOUBLE) / 1e8 AS s30, sum(n) OVER w30 AS c30 FROM full_days
  WINDOW w7 AS (PARTITION BY table_name, entity ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY table_name, entity ORDER BY day ROWS 29 PRECEDING))
"""

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LINES = (
    r"""
WITH s AS (SELECT line_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS s FROM tardis_raw WHERE line_no > 1),
q AS (SELECT line_id, regexp_full_match(s, '(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*') AS quoted,
 list_transform(regexp_extract_all(s || ',', '("(?:[^"]|"")*"|[^",]*),', 1), lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS f FROM s),
p AS (SELECT line_id, quoted, f, TRY_CAST(regexp_extract(f[2], '-([0-9.]+)-[CP]$', 1) AS DOUBLE) AS k,
 try_strptime(regexp_extract(f[2], '-([0-9]{1,2}[A-Z]{3})[0-9]{2}-', 1) || '20' || regexp_extract(f[2], '([0-9]{2})-[0-9.]+-[CP]$', 1), '%d%b%Y') AS day FROM q),
r AS (SELECT line_id, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 24 THEN 'columns'
 WHEN NOT coalesce(regexp_full_match(f[2], '[A-Z]{3}-[0-9]{1,2}(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[0-9]{2}-[0-9]+(\.[0-9]+)?-[CP]') AND day IS NOT NULL
  AND regexp_full_match(f[3], '[0-9]+') AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[7], '[0-9]+') AND TRY_CAST(f[3] AS BIGINT) > 0 AND TRY_CAST(f[4] AS BIGINT) > 0
  AND f[5] = CASE WHEN f[2][-1] = 'C' THEN 'call' ELSE 'put' END AND regexp_full_match(f[6], 'NUMBER') AND TRY_CAST(f[6] AS DOUBLE) > 0 AND TRY_CAST(f[6] AS DOUBLE) = k
  AND TRY_CAST(f[7] AS BIGINT) = epoch_ms(day) + 28800000
  AND len(list_filter(f[8:17] || f[19:24], lambda x: x <> '' AND NOT (regexp_full_match(x, 'NUMBER') AND isfinite(TRY_CAST(x AS DOUBLE))))) = 0, false) THEN 'value' END AS reason FROM p)
"""
).replace("NUMBER", _NUMBER)

_PRICED = """SELECT upper(trim(instrument)) AS instrument, epoch_us(ts) // {step} AS slot, arg_max(price_btc, (epoch_us(ts), ingest_seq)) FILTER (WHERE price_btc IS NOT NULL) AS v, true AS seen
 FROM trades_options WHERE instrument IS NOT NULL AND ts IS NOT NULL GROUP BY ALL"""


def _filled_sql(slots: str, step: int) -> str:
    return f"""WITH o AS ({slots}), g AS (SELECT instrument, unnest(generate_series(min(slot), max(slot))) AS slot FROM o GROUP BY instrument)
SELECT instrument, strftime(make_timestamp(slot * {step}), '%Y-%m-%d %H:%M:%S') AS slot_start, last_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY slot) AS value, seen IS NULL AS missing
FROM g LEFT JOIN o USING (instrument, slot)"""


SQL = {
    "p3_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_loaded": _LINES
    + "SELECT line_id, "
    + ", ".join(f"{f'f[{i}]' if c in badrows.TEXT else f'TRY_CAST(f[{i}] AS BIGINT)' if c in badrows.WHOLE else f'TRY_CAST(f[{i}] AS DOUBLE)'} AS {c}" for i, c in enumerate(badrows.COLUMNS, 1))
    + " FROM r WHERE reason IS NULL",
    "p1_found": """
SELECT 'trades_options' AS table_name, ingest_seq FROM trades_options WHERE trade_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lower(trim(trade_id)) ORDER BY ingest_seq) > 1
UNION ALL SELECT 'funding', ingest_seq FROM funding WHERE instrument IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, ts ORDER BY ingest_seq) > 1""",
    "p1_kept_trades": """
SELECT ingest_seq, trade_id, upper(trim(instrument)) AS instrument, price_btc, iv, amount FROM trades_options
QUALIFY trade_id IS NULL OR row_number() OVER (PARTITION BY lower(trim(trade_id)) ORDER BY ingest_seq) = 1""",
    "p4_found": """
WITH ev AS (SELECT ingest_seq, ts, upper(trim(instrument)) AS i FROM trades_options WHERE block_flag),
k AS (SELECT 'dvol' AS table_name, currency AS e, ingest_ts, ts, ingest_seq FROM dvol WHERE close IS NOT NULL
  UNION ALL SELECT 'funding', instrument, ingest_ts, ts, ingest_seq FROM funding WHERE interest_8h IS NOT NULL
  UNION ALL SELECT 'trades_futures', instrument, ingest_ts, ts, ingest_seq FROM trades_futures WHERE price IS NOT NULL),
w AS (SELECT ingest_seq, ts, 'dvol' AS table_name, split_part(i, '-', 1) AS e FROM ev
  UNION ALL SELECT ingest_seq, ts, 'funding', split_part(i, '-', 1) || '-PERPETUAL' FROM ev
  UNION ALL SELECT ingest_seq, ts, 'trades_futures', split_part(i, '-', 1) || '-' || split_part(i, '-', 2) FROM ev)
SELECT w.ingest_seq AS event_seq, w.table_name, arg_max(k.ingest_seq, (k.ts, k.ingest_seq)) AS known_seq
FROM w JOIN k ON w.table_name = k.table_name AND w.e = k.e AND k.ingest_ts <= w.ts GROUP BY w.ingest_seq, w.table_name""",
    "p5_found": _CLOSES + "SELECT table_name, entity, day_utc FROM roll WHERE c7 > 0 AND abs((s7 / c7) / (s30 / c30) - 1) >= 0.2",
    "p5_trailing": _CLOSES + """SELECT table_name, entity, day_utc, CAST(c7 AS BIGINT) AS n7, CAST(c30 AS BIGINT) AS n30, s7 AS sum7, s30 AS sum30,
  CASE WHEN c7 > 0 THEN s7 / c7 END AS avg7, CASE WHEN c30 > 0 THEN s30 / c30 END AS avg30 FROM roll""",
    "p7_found": """
WITH o AS (SELECT 'ohlc' AS table_name, instrument, epoch_us(ts) // 3600000000 AS slot, 3600000000 AS step FROM ohlc WHERE close IS NOT NULL
  UNION SELECT 'trades_options', upper(trim(instrument)), epoch_us(ts) // 86400000000, 86400000000 FROM trades_options),
g AS (SELECT table_name, instrument, step, unnest(generate_series(min(slot), max(slot))) AS slot FROM o GROUP BY table_name, instrument, step)
SELECT table_name, instrument, strftime(make_timestamp(slot * step), '%Y-%m-%d %H:%M:%S') AS slot_start FROM g ANTI JOIN o USING (table_name, instrument, slot)""",
    "p7_filled_ohlc": """
WITH o AS (SELECT instrument, epoch_us(ts) // 3600000000 AS slot, arg_max(close, ingest_seq) AS v FROM ohlc WHERE close IS NOT NULL GROUP BY ALL),
g AS (SELECT instrument, unnest(generate_series(min(slot), max(slot))) AS slot FROM o GROUP BY instrument)
SELECT instrument, strftime(make_timestamp(slot * 3600000000), '%Y-%m-%d %H:%M:%S') AS slot_start,
  last_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY slot) AS value, v IS NULL AS missing FROM g LEFT JOIN o USING (instrument, slot)""",
    "p7_filled_ohlc_daily": _filled_sql("SELECT instrument, epoch_us(ts) // 86400000000 AS slot, arg_max(close, (epoch_us(ts) // 3600000000, ingest_seq)) AS v, true AS seen FROM ohlc WHERE close IS NOT NULL GROUP BY ALL", 86_400_000_000),
    "p7_filled_trades": _filled_sql(_PRICED.format(step=3_600_000_000), 3_600_000_000),
    "p7_filled_trades_daily": _filled_sql(_PRICED.format(step=86_400_000_000), 86_400_000_000),
}
