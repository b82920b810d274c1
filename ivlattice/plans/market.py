"""Curation, market features, folds and numerical columns over the domain tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice.functions import black76
from ivlattice.functions import svi as svi_columns
from ivlattice.functions.calendar import snap_ts
from ivlattice.functions.numeric import interpolate_clamped
from ivlattice.operators import arbitrage, bars, folds, market, options, pca, snapwindow, svifit
from ivlattice.operators.deliveries import first_deliveries
from ivlattice.plans.registry import Catalogue
from ivlattice.session import clean_name, durable, table

query = Catalogue()


def sql_cdf(x: str) -> str:
    """The normal CDF in SQL, by the same rational form as the columns."""
    poly = lambda cs, a: "(" + " + ".join(f"{c!r} * pow({a}, {len(cs) - 1 - i})" for i, c in enumerate(cs)) + ")"
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {poly(black76.CDF_NUMERATOR, a)} / {poly(black76.CDF_DENOMINATOR, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631"
    tail = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {black76.CDF_SPLIT} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


# ---- candles ----


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bars.daily_bars(table(spark, d, "ohlc"), "instrument", 3_600, need=6)


_BARS = """WITH v AS (SELECT instrument, ts, arg_max({'o': open, 'h': high, 'l': low, 'c': close}, ingest_seq) AS b FROM ohlc
 WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low AND isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) GROUP BY ALL),
k AS (SELECT instrument, ts, b, CAST((epoch_us(ts) + 3600000000 + 57300000000 - 1) // 86400000000 AS INTEGER) AS day FROM v),
bars AS (SELECT instrument, day, arg_min(b.o, ts) AS open, max(b.h) AS high, min(b.l) AS low, arg_max(b.c, ts) AS close, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 6)
"""


@query(_BARS + "SELECT instrument, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, open, high, low, close, n FROM bars")
def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("instrument", F.col("day").cast("string").alias("day"), "open", "high", "low", "close", "n")


@query(
    _BARS
    + """, r AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(close / first_value(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS ret FROM bars),
q AS (SELECT *, count(*) OVER w5 AS n5, avg(hl * hl) OVER w5 AS p5, avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co) OVER w5 AS g5, count(ret) OVER b5 AS nb, stddev_samp(ret) OVER b5 AS sd FROM r
 WINDOW w5 AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), b5 AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT instrument, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, round(ret, 9) AS return_1d, round(sqrt(365 * hl * hl / (4 * ln(2))), 9) AS rv_parkinson_1d,
 round(CASE WHEN n5 = 5 THEN sqrt(365 * p5 / (4 * ln(2))) END, 9) AS rv_parkinson_5d, round(CASE WHEN n5 = 5 THEN sqrt(365 * greatest(g5, 0)) END, 9) AS rv_garman_klass_5d,
 CASE WHEN nb = 5 AND ret IS NOT NULL THEN abs(ret) > 3 * sd END AS jump_flag FROM q"""
)
def realized_volatility(spark: SparkSession, d: str) -> DataFrame:
    r = bars.realized(_bars(spark, d), "instrument", horizons=(1, 5), jump_days=5)
    cols = ("return_1d", "rv_parkinson_1d", "rv_parkinson_5d", "rv_garman_klass_5d")
    return r.select("instrument", F.col("day").cast("string").alias("day"), *[F.round(c, 9).alias(c) for c in cols], "jump_flag")


@query(_BARS.replace("HAVING count(*) >= 6", "HAVING count(*) = 24") + "SELECT instrument, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, open, high, low, close FROM bars")
def daily_bars_full(spark: SparkSession, d: str) -> DataFrame:
    """Days with every bar that fits in, and no other."""
    b = bars.daily_bars(table(spark, d, "ohlc"), "instrument", 3_600)
    return b.select("instrument", F.col("day").cast("string").alias("day"), "open", "high", "low", "close")


@query(
    _BARS
    + """, r AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(close / first_value(close) OVER (PARTITION BY instrument ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS ret FROM bars),
q AS (SELECT *, count(*) OVER w AS n22, avg(hl * hl) OVER w AS p, avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co) OVER w AS g, count(ret) OVER b AS nb, stddev_samp(ret) OVER b AS sd FROM r
 WINDOW w AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 21 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument ORDER BY day RANGE BETWEEN 22 PRECEDING AND 1 PRECEDING))
SELECT instrument, strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, round(ret, 9) AS return_1d, round(CASE WHEN n22 = 22 THEN sqrt(365 * p / (4 * ln(2))) END, 9) AS rv_parkinson_22d,
 round(CASE WHEN n22 = 22 THEN sqrt(365 * greatest(g, 0)) END, 9) AS rv_garman_klass_22d, CASE WHEN nb = 22 AND ret IS NOT NULL THEN abs(ret) > 3 * sd END AS jump_flag FROM q"""
)
def realized_volatility_month(spark: SparkSession, d: str) -> DataFrame:
    """As realized_volatility with the 22-day horizon and jump window."""
    r = bars.realized(_bars(spark, d), "instrument")
    cols = ("return_1d", "rv_parkinson_22d", "rv_garman_klass_22d")
    return r.select("instrument", F.col("day").cast("string").alias("day"), *[F.round(c, 9).alias(c) for c in cols], "jump_flag")


@query("""WITH h AS (SELECT epoch_us(ts) // 3600000000 AS hour, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(hour AS BIGINT) AS hour, open, high, low, close, n, close / lag(close) OVER (ORDER BY hour) - 1 AS change FROM h""")
def hourly_candles(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from ivlattice.session import utc_hour

    t = table(spark, d, "events").select(utc_hour(F.col("ts").cast("timestamp")).alias("hour"), "ts", "value")
    h = t.groupBy("hour").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("n"))
    # one row per hour of the whole data: hundreds a month, so one ordered pass is bounded by time, not by events
    return h.withColumn("change", F.col("close") / F.lag("close").over(Window.orderBy("hour")) - 1)


# ---- market state ----


def _days(spark: SparkSession, d: str) -> DataFrame:
    """Every day and currency with an option trade."""
    t = table(spark, d, "trades_options").filter(F.col("ts").isNotNull())
    return t.select(F.to_date("ts").alias("snap_date"), F.split_part(clean_name("instrument"), F.lit("-"), F.lit(1)).alias("currency")).distinct()


_DAYS = """WITH days AS (SELECT DISTINCT (ts AT TIME ZONE 'UTC')::DATE AS snap_date, split_part(upper(trim(instrument)), '-', 1) AS currency, epoch_us(((ts AT TIME ZONE 'UTC')::DATE)::TIMESTAMP) + 29100000000 AS snap FROM trades_options)
"""


@query(
    _DAYS
    + """, g AS (SELECT currency, epoch_us(ts) + 3600000000 AS u, close / 100 AS v, ingest_seq FROM dvol WHERE close IS NOT NULL AND isfinite(close)),
a AS (SELECT d.snap_date, d.currency, arg_max(v, (u, ingest_seq)) AS dvol, max(u) AS u FROM days d JOIN g ON d.currency = g.currency AND u <= snap AND u >= snap - 7200000000 GROUP BY ALL),
b AS (SELECT d.snap_date, d.currency, arg_max(v, (u, ingest_seq)) AS old FROM days d JOIN g ON d.currency = g.currency AND u <= snap - 432000000000 AND u >= snap - 439200000000 GROUP BY ALL)
SELECT strftime(snap_date, '%Y-%m-%d') AS day, currency, dvol, round(dvol - old, 9) AS dvol_change_5d, (snap - u) / 1e6 AS dvol_age_s, u IS NOT NULL AS dvol_available FROM days LEFT JOIN a USING (snap_date, currency) LEFT JOIN b USING (snap_date, currency)"""
)
def dvol_features(spark: SparkSession, d: str) -> DataFrame:
    f = market.dvol_level(_days(spark, d), table(spark, d, "dvol"))
    return f.select(F.col("snap_date").cast("string").alias("day"), "currency", "dvol", F.round("dvol_change_5d", 9).alias("dvol_change_5d"), "dvol_age_s", "dvol_available")


@query(
    _DAYS
    + """, g AS (SELECT split_part(instrument, '-', 1) AS currency, epoch_us(ts) AS u, interest_8h AS v, ingest_seq FROM funding WHERE interest_8h IS NOT NULL AND isfinite(interest_8h)),
a AS (SELECT d.snap_date, d.currency, arg_max(v, (u, ingest_seq)) AS funding_8h, max(u) AS u FROM days d JOIN g ON d.currency = g.currency AND u <= snap AND u >= snap - 43200000000 GROUP BY ALL)
SELECT strftime(snap_date, '%Y-%m-%d') AS day, currency, funding_8h, (snap - u) / 1e6 AS funding_age_s, u IS NOT NULL AS funding_available FROM days LEFT JOIN a USING (snap_date, currency)"""
)
def funding_features(spark: SparkSession, d: str) -> DataFrame:
    f = market.funding_level(_days(spark, d), table(spark, d, "funding"))
    return f.select(F.col("snap_date").cast("string").alias("day"), "currency", "funding_8h", "funding_age_s", "funding_available")


@query("""WITH t AS (SELECT CAST((epoch_us(ts) + 57300000000 - 1) // 86400000000 AS INTEGER) AS day, split_part(upper(trim(instrument)), '-', 1) AS currency, right(upper(trim(instrument)), 1) AS cp, coalesce(amount, 0) AS amount FROM trades_options),
s AS (SELECT day, currency, sum(amount) FILTER (cp = 'C') AS c, sum(amount) FILTER (cp = 'P') AS p FROM t GROUP BY ALL)
SELECT strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, currency, round(coalesce(c, 0) + coalesce(p, 0), 6) AS options_volume, round(coalesce(p, 0) / nullif(c, 0), 9) AS put_call_ratio FROM s""")
def option_volumes(spark: SparkSession, d: str) -> DataFrame:
    v = market.option_volumes(table(spark, d, "trades_options"))
    return v.select(F.col("snap_date").cast("string").alias("day"), "currency", F.round("options_volume", 6).alias("options_volume"), F.round("put_call_ratio", 9).alias("put_call_ratio"))


@query(
    _DAYS
    + """, f AS (SELECT split_part(instrument, '-', 1) AS currency, instrument, epoch_us(strptime(split_part(instrument, '-', 2), '%d%b%y')) + 28800000000 AS expiry, epoch_us(ts) AS u, price, index_price, ingest_seq
 FROM trades_futures WHERE instrument NOT LIKE '%PERPETUAL' AND price > 0 AND index_price > 0),
l AS (SELECT d.snap_date, d.currency, f.instrument, f.expiry, snap, arg_max(price, (u, ingest_seq)) AS price, arg_max(index_price, (u, ingest_seq)) AS idx, max(u) AS u
 FROM days d JOIN f ON d.currency = f.currency AND u <= snap AND u >= snap - 86400000000 GROUP BY ALL),
b AS (SELECT snap_date, currency, arg_min({'x': (price / idx - 1) / ((expiry - snap) / 1e6 / 31536000.0), 'u': u}, (abs((expiry - snap) / 1e6 / 86400 - 30), instrument)) AS b FROM l WHERE expiry - snap >= 7 * 86400000000 GROUP BY ALL)
SELECT strftime(snap_date, '%Y-%m-%d') AS day, currency, round(b.x, 9) AS futures_basis, (snap - b.u) / 1e6 AS basis_age_s FROM days LEFT JOIN b USING (snap_date, currency)"""
)
def basis_features(spark: SparkSession, d: str) -> DataFrame:
    f = market.futures_basis(_days(spark, d), table(spark, d, "trades_futures"))
    return f.select(F.col("snap_date").cast("string").alias("day"), "currency", F.round("futures_basis", 9).alias("futures_basis"), "basis_age_s")


def _chain_interest(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tardis_sample").filter(F.length(F.trim("symbol")) > 0)
    chain = q.select(F.split_part(clean_name("symbol"), F.lit("-"), F.lit(1)).alias("currency"), clean_name("symbol").alias("instrument"), F.timestamp_micros("timestamp").alias("source_ts"), "open_interest", "quote_id")
    # one row per instrument and instant, so that "latest" is unique
    return chain.groupBy("currency", "instrument", "source_ts").agg(F.max_by("open_interest", "quote_id").alias("open_interest"))


def open_interest_of(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    one = _chain_interest(spark, d)
    return market.open_interest(days, one.limit(0), one)


@query(
    _DAYS
    + """, q AS (SELECT upper(trim(symbol)) AS i, timestamp AS u, open_interest, quote_id FROM tardis_sample),
l AS (SELECT d.snap_date, d.currency, q.i, arg_max({'oi': open_interest}, (u, quote_id)) AS b FROM days d JOIN q ON split_part(q.i, '-', 1) = d.currency AND u <= snap AND u >= snap - 29100000000 GROUP BY ALL)
SELECT strftime(days.snap_date, '%Y-%m-%d') AS day, currency, round(sum(b.oi), 6) AS aggregate_oi FROM days LEFT JOIN l USING (snap_date, currency) GROUP BY ALL"""
)
def open_interest(spark: SparkSession, d: str) -> DataFrame:
    return open_interest_of(spark, d, _days(spark, d)).select(F.col("snap_date").cast("string").alias("day"), "currency", F.round("aggregate_oi", 6).alias("aggregate_oi"))


@query(
    _DAYS
    + """, f AS (SELECT split_part(instrument, '-', 1) AS currency, instrument AS i, epoch_us(ts) AS u, (epoch_us(ts) // 86400000000) AS day, amount AS oi, ingest_seq FROM trades_futures WHERE amount >= 0),
a AS (SELECT currency, i, day, arg_max(oi, (u, ingest_seq)) AS oi FROM f WHERE u <= day * 86400000000 + 29100000000 GROUP BY ALL),
sa AS (SELECT currency, day, sum(oi) AS oi FROM a GROUP BY ALL),
q AS (SELECT upper(trim(symbol)) AS i, timestamp AS u, open_interest, quote_id FROM tardis_sample),
l AS (SELECT d.snap_date, d.currency, q.i, arg_max({'oi': open_interest}, (u, quote_id)) AS b FROM days d JOIN q ON split_part(q.i, '-', 1) = d.currency AND u <= snap AND u >= snap - 29100000000 GROUP BY ALL),
sb AS (SELECT snap_date, currency, sum(b.oi) AS oi FROM l GROUP BY ALL)
SELECT strftime(days.snap_date, '%Y-%m-%d') AS day, days.currency, round(coalesce(sa.oi, sb.oi), 6) AS aggregate_oi, sa.oi IS NOT NULL AS from_collected
FROM days LEFT JOIN sa ON sa.currency = days.currency AND sa.day = (snap - 29100000000) // 86400000000 LEFT JOIN sb ON sb.currency = days.currency AND sb.snap_date = days.snap_date"""
)
def open_interest_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A second source, here sizes of futures by instrument, beats the chain on the days it has; the chain fills the others."""
    f = table(spark, d, "trades_futures").filter("amount >= 0")
    f = f.groupBy(F.split_part("instrument", F.lit("-"), F.lit(1)).alias("currency"), "instrument", F.col("ts").alias("source_ts")).agg(F.max_by("amount", "ingest_seq").alias("open_interest"))
    o = market.open_interest(_days(spark, d), f, _chain_interest(spark, d))
    first = market.open_interest(_days(spark, d), f, f.limit(0)).select("snap_date", "currency", F.col("aggregate_oi").isNotNull().alias("from_collected"))
    return o.join(first, ["snap_date", "currency"]).select(F.col("snap_date").cast("string").alias("day"), "currency", F.round("aggregate_oi", 6).alias("aggregate_oi"), "from_collected")


# ---- curation ----


def _observations(spark: SparkSession, d: str) -> DataFrame:
    used = ("ingest_seq", "trade_id", "instrument", "expiry", "strike", "cp", "price_btc", "index_price", "iv", "amount", "block_flag", "ts")
    trades = first_deliveries(table(spark, d, "trades_options").select(*used), [F.lower(F.trim("trade_id"))], ["ingest_seq"], "ingest_seq")
    obs = snapwindow.snap_window(options.canonical_trades(trades), "source_ts", ["currency", "expiry"])
    # read several times from here on, and only the hours before each snapshot of the whole history
    return durable(options.add_tau(obs))


_OBS = """WITH t AS (SELECT * FROM trades_options QUALIFY row_number() OVER (PARTITION BY lower(trim(trade_id)) ORDER BY ingest_seq) = 1),
c AS (SELECT ingest_seq, split_part(n, '-', 1) AS currency, coalesce(expiry, ((strptime(split_part(n, '-', 2), '%d%b%y') + INTERVAL 8 HOUR) AT TIME ZONE 'UTC')) AS expiry, coalesce(strike, CAST(split_part(n, '-', 3) AS DOUBLE)) AS strike,
 upper(coalesce(cp, split_part(n, '-', 4))) AS cp, price_btc * index_price AS usd_premium, index_price, epoch_us(ts) // 1000 * 1000 AS u FROM (SELECT *, upper(trim(instrument)) AS n FROM t)),
p AS (SELECT *, CAST((u + 57300000000 - 1) // 86400000000 AS INTEGER) AS day FROM c),
w AS (SELECT *, day * 86400000000 + 29100000000 - u AS age, day * 86400000000 + 29100000000 AS snap FROM p WHERE day * 86400000000 + 29100000000 - u < 21600000000),
g AS (SELECT day, k, min(n) AS least_n FROM (SELECT day, currency, expiry, k, count(*) AS n FROM w, (SELECT unnest(range(6)) AS k) WHERE age // 3600000000 <= k GROUP BY ALL) GROUP BY ALL),
h AS (SELECT day, coalesce(min(CASE WHEN least_n >= 4 THEN k END), 5) AS k FROM g GROUP BY day),
obs AS (SELECT w.*, (epoch_us(expiry) - snap) / 1e6 / 31536000.0 AS tau FROM w JOIN h USING (day) WHERE age // 3600000000 <= h.k),
n AS (SELECT day, currency, expiry, strike, arg_max({'p': usd_premium, 'u': u}, (u, ingest_seq)) FILTER (cp = 'C') AS c, arg_max({'p': usd_premium, 'u': u}, (u, ingest_seq)) FILTER (cp = 'P') AS q FROM obs GROUP BY ALL),
pcp AS (SELECT day, currency, expiry, median(strike + c.p - q.p) AS f, count(*) AS n_pairs FROM n WHERE abs(c.u - q.u) <= 60000000 GROUP BY ALL)
"""


@query(_OBS + "SELECT strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, currency, epoch_ms(expiry) AS expiry_ms, round(f, 6) AS parity_forward, n_pairs FROM pcp")
def parity_forwards(spark: SparkSession, d: str) -> DataFrame:
    p = options.parity_pairs(_observations(spark, d), ["snap_date", "currency", "expiry"])
    return p.select(F.col("snap_date").cast("string").alias("day"), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.round("parity_forward", 6).alias("parity_forward"), "n_pairs")


_FORWARDS = """, cells AS (SELECT day, currency, expiry, snap, median(tau) AS tau, median(index_price) AS idx FROM obs GROUP BY ALL),
fu AS (SELECT split_part(instrument, '-', 1) AS currency, epoch_us(strptime(split_part(instrument, '-', 2), '%d%b%y')) + 28800000000 AS e, epoch_us(ts) AS u, price, ingest_seq FROM trades_futures WHERE instrument NOT LIKE '%PERPETUAL' AND price > 0),
a AS (SELECT cells.day, cells.currency, cells.expiry, arg_max(fu.price, (fu.u, fu.ingest_seq)) AS fut FROM cells JOIN fu ON fu.currency = cells.currency AND fu.e = epoch_us(cells.expiry) AND fu.u <= cells.snap GROUP BY ALL),
r AS (SELECT split_part(instrument, '-', 1) AS currency, epoch_us(ts) AS u, interest_1h AS i1, interest_8h AS i8, ingest_seq FROM funding),
b AS (SELECT s.day, s.currency, arg_max({'i8': i8, 'i1': i1}, (u, ingest_seq)) AS x FROM (SELECT DISTINCT day, currency, snap FROM cells) s JOIN r ON r.currency = s.currency AND u <= snap GROUP BY ALL)
SELECT strftime(DATE '1970-01-01' + cells.day, '%Y-%m-%d') AS day, currency, epoch_ms(expiry) AS expiry_ms,
 round(CASE WHEN n_pairs >= 1 AND f > 0 THEN f WHEN fut IS NOT NULL THEN fut ELSE idx * exp(coalesce(x.i8 * 1095, x.i1 * 8760, 0) * tau) END, 6) AS forward,
 CASE WHEN n_pairs >= 1 AND f > 0 THEN 'pcp' WHEN fut IS NOT NULL THEN 'future' ELSE 'index_carry' END AS fwd_method, CAST(CASE WHEN n_pairs >= 1 AND f > 0 THEN n_pairs ELSE 0 END AS BIGINT) AS n_pairs
FROM cells LEFT JOIN pcp USING (day, currency, expiry) LEFT JOIN a USING (day, currency, expiry) LEFT JOIN b USING (day, currency)"""


@query(_OBS + _FORWARDS)
def tiered_forwards(spark: SparkSession, d: str) -> DataFrame:
    f = options.forwards(_observations(spark, d), table(spark, d, "trades_futures"), table(spark, d, "funding"))
    return f.select(F.col("snap_date").cast("string").alias("day"), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.round("forward", 6).alias("forward"), "fwd_method", "n_pairs")


#: Trades of one contract are minutes apart here: with this gap parity has rows at every size of the tables.
WIDE_GAP_S = 7_200.0
_WIDE = _OBS.replace("<= 60000000 ", "<= 7200000000 ")


@query(_WIDE + "SELECT strftime(DATE '1970-01-01' + day, '%Y-%m-%d') AS day, currency, epoch_ms(expiry) AS expiry_ms, round(f, 6) AS parity_forward, n_pairs FROM pcp")
def parity_forwards_wide(spark: SparkSession, d: str) -> DataFrame:
    p = options.parity_pairs(_observations(spark, d), ["snap_date", "currency", "expiry"], WIDE_GAP_S)
    return p.select(F.col("snap_date").cast("string").alias("day"), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.round("parity_forward", 6).alias("parity_forward"), "n_pairs")


@query(_WIDE + _FORWARDS)
def tiered_forwards_wide(spark: SparkSession, d: str) -> DataFrame:
    """As tiered_forwards, with all three tiers taken."""
    f = options.forwards(_observations(spark, d), table(spark, d, "trades_futures"), table(spark, d, "funding"), gap_s=WIDE_GAP_S)
    return f.select(F.col("snap_date").cast("string").alias("day"), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.round("forward", 6).alias("forward"), "fwd_method", "n_pairs")


def curated(spark: SparkSession, d: str) -> DataFrame:
    """All observations with forward, volatility and flags; the kept ones are those not rejected."""
    obs = _observations(spark, d)
    fwd = options.forwards(obs, table(spark, d, "trades_futures"), table(spark, d, "funding"))
    placed = obs.join(fwd, ["snap_date", "currency", "expiry"], "left").withColumn("k", F.log(F.col("strike") / F.col("forward")))
    return options.cascade(options.cross_check(placed), ["snap_date", "currency", "expiry"])


#: Rows that may leave the curation; null sizes or premiums break its contract.
KEPT = "not rejected and usd_premium is not null and size is not null"


@query()
def curated_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = curated(spark, d).filter(KEPT)
    return q.select(
        F.col("snap_date").cast("string").alias("snap_date"), "currency", "expiry", "tau", "strike", "cp", "forward", "k", "iv_obs", "iv_source", "usd_premium", "size", "staleness_s", "quality_flags", "fwd_method"
    )


@query()
def quality_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return curated(spark, d).groupBy("quality_flags", "rejected", "iv_source").agg(F.count(F.lit(1)).alias("n"))


@query()
def chain_against_trades(spark: SparkSession, d: str) -> DataFrame:
    """Curated trade volatilities against the chain's marks, per expiry and moneyness bucket."""
    c = curated(spark, d).filter("not rejected")
    fwd = c.select("snap_date", "currency", "expiry", "forward").distinct()
    marks = options.latest_quotes(options.canonical_quotes(table(spark, d, "tardis_sample"))).join(fwd, ["snap_date", "currency", "expiry"])
    marks = marks.withColumn("k", F.log(F.col("strike") / F.col("forward"))).filter(F.col("iv_trade").isNotNull())
    cell = ["snap_date", "currency", "expiry"]
    return options.compare_buckets(options.bucket_marks(c, cell, "k", "iv_obs"), options.bucket_marks(marks, cell, "k", "iv_trade"), [*cell, "k_bucket"])


# ---- surfaces ----


def _surface_input(spark: SparkSession, d: str) -> DataFrame:
    c = curated(spark, d).filter(KEPT)
    return c.select("snap_date", "currency", "expiry", "tau", "k", F.col("iv_obs").alias("iv"), "vega")


def surfaces(spark: SparkSession, d: str) -> DataFrame:
    return durable(svifit.build_surfaces(_surface_input(spark, d)))


@query()
def surfaces_daily(spark: SparkSession, d: str) -> DataFrame:
    return surfaces(spark, d)


@query()
def surface_quality(spark: SparkSession, d: str) -> DataFrame:
    s = surfaces(spark, d)
    check = arbitrage.surface_check(s.filter("record_kind = 'grid'"), ["snap_date", "currency"], k="grid_k", w="grid_w")
    return arbitrage.quality_summary(s).join(check, ["snap_date", "currency"])


@query()
def surface_factors(spark: SparkSession, d: str) -> DataFrame:
    return arbitrage.surface_factors(surfaces(spark, d).filter("record_kind = 'grid'"), ["snap_date", "currency"])


@query()
def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    return arbitrage.coverage(surfaces(spark, d).filter("record_kind = 'grid'"), ["tau", "moneyness"], "cell_n_obs")


# ---- closed forms ----

_B76 = """SELECT p_partkey, p_retailprice AS f, p_retailprice * (0.7 + 0.02 * (p_partkey % 31)) AS k, 0.05 + 0.01 * p_size AS t, 0.2 + 0.05 * (p_partkey % 17) AS v, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS cp FROM part"""


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.col("p_retailprice").alias("f"),
        (F.col("p_retailprice") * (0.7 + 0.02 * (key % 31))).alias("k"),
        (0.05 + 0.01 * F.col("p_size")).alias("t"),
        (0.2 + 0.05 * (key % 17)).alias("v"),
        F.when(key % 2 == 0, 1).otherwise(-1).alias("cp"),
    )


@query(
    f"""WITH c AS ({_B76}), e AS (SELECT *, ln(f / k) / (v * sqrt(t)) + v * sqrt(t) / 2 AS d1, v * sqrt(t) AS s FROM c)
SELECT p_partkey, round(cp * (f * {sql_cdf("(cp * d1)")} - k * {sql_cdf("(cp * (d1 - s))")}), 6) AS price, round(cp * {sql_cdf("(cp * d1)")}, 9) AS delta,
 round(exp(-d1 * d1 / 2) / 2.5066282746310002 / (f * s), 9) AS gamma, round(f * exp(-d1 * d1 / 2) / 2.5066282746310002 * sqrt(t), 6) AS vega, round(-f * exp(-d1 * d1 / 2) / 2.5066282746310002 * v / (2 * sqrt(t)), 6) AS theta FROM e"""
)
def black76_price_greeks(spark: SparkSession, d: str) -> DataFrame:
    g = black76.priced(_contracts(spark, d), "f", "k", "t", "v", "cp")
    digits = {"price": 6, "delta": 9, "gamma": 9, "vega": 6, "theta": 6}
    return g.select("p_partkey", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(f"SELECT p_partkey, round(v, 6) AS iv FROM ({_B76}) WHERE abs(ln(f / k)) < 3 * v * sqrt(t)")
def implied_volatility(spark: SparkSession, d: str) -> DataFrame:
    c = _contracts(spark, d).filter(F.abs(F.log(F.col("f") / F.col("k"))) < 3 * F.col("v") * F.sqrt("t"))
    p = black76.priced(c, "f", "k", "t", "v", "cp")
    return p.select("p_partkey", F.round(black76.implied_vol_udf()("price", "f", "k", "t", "cp"), 6).alias("iv"))


@query()
def implied_volatility_repriced(spark: SparkSession, d: str) -> DataFrame:
    """Every contract, deep ones included: its price, the implied volatility (0 or NaN as defined) and the price that gives."""
    p = black76.priced(_contracts(spark, d), "f", "k", "t", "v", "cp").withColumn("iv", black76.implied_vol_udf()("price", "f", "k", "t", "cp"))
    again = black76.priced(p.select("p_partkey", "f", "k", "t", "iv", "cp"), "f", "k", "t", "iv", "cp").select("p_partkey", F.col("price").alias("repriced"))
    return p.select("p_partkey", "f", "k", "cp", "price", "iv").join(again, "p_partkey")


_SLICES = """WITH s AS (SELECT s_suppkey, unnest(range(21)) AS i, 0.01 + 0.0005 * (s_suppkey % 40) AS a, 0.1 + 0.01 * (s_suppkey % 25) AS b, -0.6 + 0.04 * (s_suppkey % 30) AS rho, 0.02 * (s_suppkey % 7) - 0.06 AS m, 0.05 + 0.03 * (s_suppkey % 9) AS sg FROM supplier),
g AS (SELECT *, -1 + 0.1 * i AS k, sqrt((-1 + 0.1 * i - m) * (-1 + 0.1 * i - m) + sg * sg) AS r FROM s),
v AS (SELECT s_suppkey, i, k, a + b * (rho * (k - m) + r) AS w, b * (rho + (k - m) / r) AS d1, b * sg * sg / (r * r * r) AS d2 FROM g)
"""


def _slices(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(
        "s_suppkey",
        F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"),
        *[e.alias(x) for x, e in {"a": 0.01 + 0.0005 * (n % 40), "b": 0.1 + 0.01 * (n % 25), "rho": -0.6 + 0.04 * (n % 30), "m": 0.02 * (n % 7) - 0.06, "sg": 0.05 + 0.03 * (n % 9)}.items()],
    )
    s = s.withColumn("k", -1 + 0.1 * F.col("i"))
    p = [F.col(x) for x in ("k", "a", "b", "rho", "m", "sg")]
    return s.withColumns({"w": svi_columns.total_variance(*p), "g": svi_columns.durrleman(*p)})


@query(_SLICES + "SELECT s_suppkey, i, round(w, 9) AS w, round((1 - k * d1 / (2 * w)) ^ 2 - d1 * d1 / 4 * (1 / w + 0.25) + d2 / 2, 9) AS g FROM v")
def svi_variance_and_g(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d).select("s_suppkey", F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"), F.round("g", 9).alias("g"))


@query(_SLICES + ", l AS (SELECT s_suppkey // 6 AS snap, w - lag(w) OVER (PARTITION BY s_suppkey // 6, i ORDER BY s_suppkey) AS dw FROM v) SELECT CAST(snap AS BIGINT) AS snap, count_if(dw < -1e-10) AS calendar, round(coalesce(max(-dw) FILTER (dw < -1e-10), 0), 9) AS calendar_max, round(coalesce(sum(-dw) FILTER (dw < -1e-10), 0), 9) AS calendar_sum FROM l GROUP BY snap")
def calendar_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    g = _slices(spark, d).withColumn("snap", F.expr("s_suppkey div 6"))
    c = arbitrage.calendar_breaches(g, ["snap"], k="i", tau="s_suppkey")
    return c.select("snap", "calendar", F.round("calendar_max", 9).alias("calendar_max"), F.round("calendar_sum", 9).alias("calendar_sum"))


@query(
    _SLICES
    + f""", c AS (SELECT s_suppkey, i, k, exp(k) AS x, sqrt(w) AS s, -k / sqrt(w) + sqrt(w) / 2 AS d1 FROM v), p AS (SELECT s_suppkey, i, x, {sql_cdf("d1")} - x * {sql_cdf("(d1 - s)")} AS c FROM c),
q AS (SELECT s_suppkey, i, (lead(c) OVER w - c) / (lead(x) OVER w - x) AS s FROM p WINDOW w AS (PARTITION BY s_suppkey ORDER BY i)), z AS (SELECT s_suppkey, s, lead(s) OVER (PARTITION BY s_suppkey ORDER BY i) - s AS ds FROM q)
SELECT s_suppkey, 0::BIGINT AS unusable, count_if(ds < -1e-10) AS butterfly, round(coalesce(sum(-ds) FILTER (ds < -1e-10), 0), 8) AS butterfly_sum, count_if(s > 1e-10 OR s < -1 - 1e-10) AS vertical, round(coalesce(sum(greatest(s, 0) + greatest(-1 - s, 0)) FILTER (s > 1e-10 OR s < -1 - 1e-10), 0), 8) AS vertical_sum FROM z GROUP BY s_suppkey"""
)
def butterfly_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    b = arbitrage.butterfly_breaches(_slices(spark, d).withColumn("tau", F.lit(1)), ["s_suppkey"])
    return b.select("s_suppkey", "unusable", "butterfly", F.round("butterfly_sum", 8).alias("butterfly_sum"), "vertical", F.round("vertical_sum", 8).alias("vertical_sum"))


@query("""SELECT l_linestatus, l_returnflag, round(least(1, (count_if(l_discount > 0.08) + count_if(l_tax > 0.06))::DOUBLE / (count(DISTINCT l_linenumber) * 9 + (count(DISTINCT l_linenumber) - 1) * 9)), 9) AS rate,
 round(greatest(0, least(1, least(count(*) / 500000.0, 1) * 0.5 * pow(2, -avg(l_discount) / 0.05))), 6) AS weight FROM lineitem GROUP BY ALL""")
def arbitrage_rate_and_weight(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.08).alias("b"), F.count_if(F.col("l_tax") > 0.06).alias("c"), F.count_distinct("l_linenumber").alias("n"), F.count(F.lit(1)).alias("m"), F.avg("l_discount").alias("r")
    )
    return g.select(
        "l_linestatus",
        "l_returnflag",
        F.round(arbitrage.market_rate(F.col("b"), F.col("c"), F.col("n")), 9).alias("rate"),
        F.round(arbitrage.reliability(F.col("m"), F.lit(True), F.lit(False), F.col("r"), n_ref=500_000.0), 6).alias("weight"),
    )


@query("""WITH c AS (SELECT p_brand, list(p_size ORDER BY p_size) AS xs, list(p ORDER BY p_size) AS ys FROM (SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS p FROM part GROUP BY ALL) GROUP BY 1),
q AS (SELECT p_brand, x, xs, ys, len(list_filter(xs, lambda v: v <= x)) AS n FROM c, (SELECT unnest([-3.0, 0.5, 7.25, 24.75, 99.0]) AS x))
SELECT p_brand, CAST(x AS DOUBLE) AS x, round(CASE WHEN n = 0 THEN ys[1] WHEN n = len(xs) THEN ys[n] ELSE ys[n] + (x - xs[n]) * (ys[n + 1] - ys[n]) / (xs[n + 1] - xs[n]) END, 6) AS y FROM q""")
def linear_interp_clamped(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 6).alias("p"))
    c = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_size").cast("double").alias("x"), F.col("p").alias("y")))).alias("c"))
    c = c.withColumn("x", F.explode(F.array(*[F.lit(v) for v in (-3.0, 0.5, 7.25, 24.75, 99.0)])))
    y = interpolate_clamped(F.col("x"), F.transform("c", lambda v: v["x"]), F.transform("c", lambda v: v["y"]))
    return c.select("p_brand", "x", F.round(y, 6).alias("y"))


# ---- folds and windows ----

_FOLDS = """WITH dt AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), e AS (SELECT min(day) AS s, max(day) + 1 AS stop FROM dt),
f AS (SELECT i AS fold_id, s AS train_start, (s + to_months(CAST(16 + 2 * i AS INTEGER)))::DATE AS train_end, (s + to_months(CAST(18 + 2 * i AS INTEGER)))::DATE AS validation_end, (s + to_months(CAST(20 + 2 * i AS INTEGER)))::DATE AS test_end, i < 2 AS tune_hyperparameters, stop
 FROM e, (SELECT unnest(range(200)) AS i)), folds AS (SELECT * EXCLUDE (stop) FROM f WHERE test_end <= stop)
"""


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))


@query(_FOLDS + "SELECT fold_id, strftime(train_start, '%Y-%m-%d') AS train_start, strftime(train_end, '%Y-%m-%d') AS train_end, strftime(validation_end, '%Y-%m-%d') AS validation_end, strftime(test_end, '%Y-%m-%d') AS test_end, tune_hyperparameters FROM folds")
def fold_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = folds.folds(_order_days(spark, d))
    return f.select("fold_id", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "validation_end", "test_end")], "tune_hyperparameters")


@query(_FOLDS + "SELECT fold_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day < train_end THEN 'train' WHEN day < validation_end THEN 'validation' ELSE 'test' END AS split, tune_hyperparameters FROM dt JOIN folds ON day >= train_start AND day < test_end")
def fold_manifest(spark: SparkSession, d: str) -> DataFrame:
    days = _order_days(spark, d)
    return folds.manifest(days, folds.folds(days)).withColumn("day", F.col("day").cast("string"))


@query("""WITH o AS (SELECT o_orderpriority AS p, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT p, day, n, list(n) OVER a AS past, count(*) OVER b AS c FROM o
 WINDOW a AS (PARTITION BY p ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING), b AS (PARTITION BY p ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
SELECT p, strftime(day, '%Y-%m-%d') AS day, n, array_to_string(past, ',') AS past FROM w WHERE c = 7""")
def lookback_windows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = folds.lookback(o, ["p"], "day", ["n"], length=5, horizon=2)
    return w.select("p", F.col("day").cast("string").alias("day"), "n", F.array_join(F.transform("inputs", lambda x: x["n"].cast("string")), ",").alias("past"))


@query("SELECT CAST(i - 1 AS INTEGER) AS pos, round(avg(embedding[i]), 7) AS mean, round(var_pop(embedding[i]), 7) AS variance, count(*) AS n FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i")
def vector_moments(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("pos").agg(F.round(F.avg("x"), 7).alias("mean"), F.round(F.var_pop("x"), 7).alias("variance"), F.count("x").alias("n"))


@query("""SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_pop(embedding[i], embedding[j]), 7) AS covariance
FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) WHERE embedding IS NOT NULL GROUP BY i, j""")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    """The matrix that components are taken from."""
    m = pca.moments(table(spark, d, "embeddings"), "embedding")
    return m.select("i", F.posexplode("covariance").alias("j", "c")).select("i", "j", F.round("c", 7).alias("covariance"))


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = pca.fit(e, "embedding", 4)
    return e.select("vec_id", F.transform(c.scores("embedding"), lambda x: F.round(x, 6)).alias("scores"))


AXES = {"tenor_days": list(svifit.TENOR_DAYS), "moneyness": list(svifit.MONEYNESS)}
_AXES_TEXT = json.dumps(AXES, separators=(",", ":"), sort_keys=True)


@query(f"SELECT n_name, sha256('{_AXES_TEXT}' || n_name) AS signature, '{hashlib.sha256(_AXES_TEXT.encode()).hexdigest()}' AS grid FROM nation")
def grid_signature(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_name", F.sha2(F.concat(F.lit(_AXES_TEXT), "n_name"), 256).alias("signature"), F.sha2(F.lit(_AXES_TEXT), 256).alias("grid"))


__all__ = ["curated", "surfaces", "snap_ts"]
QUERIES, SQL = query.QUERIES, query.SQL
