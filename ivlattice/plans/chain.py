"""The quote chain through the curation cascade, and slices of the option trades with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ivlattice.functions.calendar import snap_ts
from ivlattice.functions.flags import HARD_REJECT
from ivlattice.operators import arbitrage, marketgrid, options, repair
from ivlattice.plans.market import sql_cdf
from ivlattice.plans.registry import Catalogue
from ivlattice.session import durable, table

query = Catalogue()
CELL = ["snap_date", "currency", "expiry"]
SNAP = ["snap_date", "currency"]
#: Quotes of one contract are hours apart here, so calls and puts of a strike are paired within six.
GAP_S = 21_600.0

_DAY_SQL = "strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day"


def _day() -> Column:
    return F.col("snap_date").cast("string").alias("day")


# ---- observations in one shape ----


@query("""SELECT ingest_seq, upper(trim(instrument)) AS instrument, coalesce(strike, CAST(split_part(upper(trim(instrument)), '-', 3) AS DOUBLE)) AS strike,
 upper(coalesce(cp, right(upper(trim(instrument)), 1))) AS cp, CAST(CASE WHEN upper(coalesce(cp, right(upper(trim(instrument)), 1))) = 'C' THEN 1 ELSE -1 END AS BIGINT) AS cp_sign,
 price_btc * index_price AS usd_premium, iv / 100 AS iv_trade, amount AS size, coalesce(block_flag, false) AS block_flag, epoch_us(ts) // 1000 AS ms FROM trades_options""")
def canonical_trades(spark: SparkSession, d: str) -> DataFrame:
    t = options.canonical_trades(table(spark, d, "trades_options"))
    return t.select("ingest_seq", "instrument", "strike", "cp", "cp_sign", "usd_premium", "iv_trade", "size", "block_flag", F.unix_millis("source_ts").alias("ms"))


@query("""SELECT quote_id, upper(trim(symbol)) AS instrument, expiration AS expiry_ms, strike_price AS strike, right(upper(trim(symbol)), 1) AS cp, mark_price * underlying_price AS usd_premium,
 mark_iv / 100 AS iv_trade, coalesce(open_interest, 0) AS size, timestamp // 1000 AS ms FROM tardis_sample""")
def canonical_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = options.canonical_quotes(table(spark, d, "tardis_sample"))
    return q.select(F.col("ingest_seq").alias("quote_id"), "instrument", F.unix_millis("expiry").alias("expiry_ms"), "strike", "cp", "usd_premium", "iv_trade", "size", F.unix_millis("source_ts").alias("ms"))


# ---- the chain at each day's snapshot ----

_CHAIN = """WITH q AS (SELECT quote_id, upper(trim(symbol)) AS n, expiration, strike_price AS strike, mark_price * underlying_price AS prem, underlying_price AS idx, mark_iv / 100 AS iv,
 coalesce(open_interest, 0) AS size, timestamp // 1000 * 1000 AS u FROM tardis_sample WHERE mark_iv IS NOT NULL),
p AS (SELECT *, split_part(n, '-', 1) AS currency, right(n, 1) AS cp, u // 86400000000 AS day FROM q),
l AS (SELECT * FROM p WHERE u <= day * 86400000000 + 29100000000
 QUALIFY row_number() OVER (PARTITION BY day, currency, expiration, strike, cp ORDER BY u DESC, iv DESC, quote_id DESC) = 1),
sides AS (SELECT day, currency, expiration, strike, max(prem) FILTER (cp = 'C') AS c, max(prem) FILTER (cp = 'P') AS p, max(u) FILTER (cp = 'C') AS cu, max(u) FILTER (cp = 'P') AS pu FROM l GROUP BY ALL),
pcp AS (SELECT day, currency, expiration, median(strike + c - p) AS f, count(*) AS n_pairs FROM sides WHERE abs(cu - pu) <= 21600000000 GROUP BY ALL),
cells AS (SELECT day, currency, expiration, median(idx) AS idx FROM l GROUP BY ALL),
fwd AS (SELECT day, currency, expiration, CASE WHEN f > 0 THEN f ELSE idx END AS forward, CASE WHEN f > 0 THEN 'pcp' ELSE 'index_carry' END AS fwd_method,
 CAST(CASE WHEN f > 0 THEN n_pairs ELSE 0 END AS BIGINT) AS n_pairs FROM cells LEFT JOIN pcp USING (day, currency, expiration))
"""


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last quote of each contract before the day's snapshot, and the forwards of the chain alone."""
    marked = table(spark, d, "tardis_sample").filter(F.col("mark_iv").isNotNull())
    quotes = durable(options.add_tau(options.latest_quotes(options.canonical_quotes(marked))))
    no_future, no_funding = table(spark, d, "trades_futures").limit(0), table(spark, d, "funding").limit(0)
    return quotes, options.forwards(quotes, no_future, no_funding, gap_s=GAP_S)


@query(_CHAIN + f"SELECT {_DAY_SQL}, currency, expiration AS expiry_ms, strike, cp, quote_id, iv FROM l")
def latest_chain_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d)[0].select(_day(), "currency", F.unix_millis("expiry").alias("expiry_ms"), "strike", "cp", F.col("ingest_seq").alias("quote_id"), F.col("iv_trade").alias("iv"))


@query(_CHAIN + f"SELECT {_DAY_SQL}, currency, expiration AS expiry_ms, round(forward, 6) AS forward, fwd_method, n_pairs FROM fwd")
def chain_forwards(spark: SparkSession, d: str) -> DataFrame:
    """Parity where calls and puts are close enough, else the index: both occur."""
    return _chain(spark, d)[1].select(_day(), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.round("forward", 6).alias("forward"), "fwd_method", "n_pairs")


_CURATED = (
    _CHAIN
    + """, o AS (SELECT l.*, forward, fwd_method, (expiration * 1000 - day * 86400000000 - 29100000000) / 1e6 / 31536000.0 AS tau FROM l JOIN fwd USING (day, currency, expiration)),
s AS (SELECT *, ln(strike / forward) AS k, iv * iv * tau AS w, CASE WHEN tau > 0 AND iv > 0 THEN iv * sqrt(tau) END AS sd FROM o),
e AS (SELECT *, -k / sd + sd / 2 AS d1 FROM s),
g AS (SELECT *, """
    + sql_cdf("(CASE WHEN cp = 'C' THEN d1 ELSE -d1 END)")
    + """ AS size_of_delta, median(w) OVER (PARTITION BY day, currency, expiration) AS med FROM e),
m AS (SELECT *, median(abs(w - med)) OVER (PARTITION BY day, currency, expiration) AS mad FROM g),
f AS (SELECT *, CAST((CASE WHEN tau < 2.0 / 365 THEN 1 ELSE 0 END) + (CASE WHEN d1 IS NULL OR size_of_delta < 0.02 OR size_of_delta > 0.98 THEN 2 ELSE 0 END) + (CASE WHEN iv < 0.01 OR iv > 5 THEN 4 ELSE 0 END)
 + (CASE WHEN abs(w - med) > 5 * mad THEN 16 ELSE 0 END) + (CASE WHEN size < 0.1 THEN 32 ELSE 0 END) AS BIGINT) AS flags FROM m)
"""
)


def _curated_chain(spark: SparkSession, d: str) -> DataFrame:
    quotes, fwd = _chain(spark, d)
    placed = quotes.join(fwd, CELL, "left").withColumn("k", F.log(F.col("strike") / F.col("forward")))
    return options.cascade(options.cross_check(placed), CELL)


@query(_CURATED + f"SELECT {_DAY_SQL}, quote_id, round(forward, 6) AS forward, round(k, 9) AS k, iv AS iv_obs, round(w, 9) AS w, flags AS hard_flags, flags <> 0 AS rejected FROM f")
def curated_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every quote of the chain with forward, moneyness and the flags that can reject it."""
    c = _curated_chain(spark, d)
    hard = F.col("quality_flags").bitwiseAND(F.lit(HARD_REJECT).cast("long"))
    return c.select(_day(), F.col("ingest_seq").alias("quote_id"), F.round("forward", 6).alias("forward"), F.round("k", 9).alias("k"), "iv_obs", F.round("w", 9).alias("w"), hard.alias("hard_flags"), "rejected")


_COMPARED = (
    _CURATED
    + """, t AS (SELECT epoch_us(ts) // 86400000000 AS day, upper(trim(instrument)) AS n, iv / 100 AS iv FROM trades_options WHERE iv BETWEEN 1 AND 500),
tk AS (SELECT t.day, currency, expiration, floor(ln(CAST(split_part(t.n, '-', 3) AS DOUBLE) / forward) / 0.1) AS b, iv FROM t JOIN fwd
 ON t.day = fwd.day AND split_part(t.n, '-', 1) = currency AND epoch_ms(strptime(split_part(t.n, '-', 2), '%d%b%y')) + 28800000 = expiration),
x AS (SELECT day, currency, expiration, floor(k / 0.1) AS b, avg(iv) AS iv_a, count(*) AS n_a FROM f WHERE flags = 0 GROUP BY ALL),
y AS (SELECT day, currency, expiration, b, avg(iv) AS iv_b, count(*) AS n_b FROM tk GROUP BY ALL),
c AS (SELECT *, abs(iv_a - iv_b) AS diff FROM x JOIN y USING (day, currency, expiration, b))
"""
)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    kept = _curated_chain(spark, d).filter("not rejected")
    fwd = _chain(spark, d)[1].select(*CELL, "forward")
    trades = options.canonical_trades(table(spark, d, "trades_options").filter("iv between 1 and 500")).withColumn("snap_date", F.to_date("source_ts")).drop("expiry", "strike")
    trades = trades.withColumn("__i", options.parse("instrument")).withColumns({"expiry": F.col("__i.expiry"), "strike": F.col("__i.strike")})
    trades = trades.join(fwd, CELL).withColumn("k", F.log(F.col("strike") / F.col("forward")))
    return options.compare_buckets(options.bucket_marks(kept, CELL, "k", "iv_obs"), options.bucket_marks(trades, CELL, "k", "iv_trade"), [*CELL, "k_bucket"])


@query(_COMPARED + f"SELECT {_DAY_SQL}, currency, expiration AS expiry_ms, CAST(b AS BIGINT) AS k_bucket, n_a, n_b, round(diff, 9) AS diff, diff <= 0.05 AS within FROM c")
def chain_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Marks of the curated chain beside the day's trades, per expiry and moneyness bucket."""
    c = _compared(spark, d)
    return c.select(_day(), "currency", F.unix_millis("expiry").alias("expiry_ms"), F.col("k_bucket").cast("long").alias("k_bucket"), "n_a", "n_b", F.round("diff", 9).alias("diff"), "within")


@query(_COMPARED + f"SELECT {_DAY_SQL}, currency, count(*) AS n_buckets, bool_and(diff <= 0.05) AS passed, round(max(diff), 9) AS max_abs_diff FROM c GROUP BY day, currency")
def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    s = options.comparison_summary(_compared(spark, d), SNAP)
    return s.select(_day(), "currency", "n_buckets", "passed", F.round("max_abs_diff", 9).alias("max_abs_diff"))


# ---- slices of a day's trades ----

_INTERP = "(CASE WHEN len(list_filter({xs}, lambda v: v <= {x})) >= len({xs}) THEN {ys}[len({xs})] WHEN {x} < {xs}[1] THEN {ys}[1] ELSE {ys}[len(list_filter({xs}, lambda v: v <= {x}))] + ({x} - {xs}[len(list_filter({xs}, lambda v: v <= {x}))]) * ({ys}[len(list_filter({xs}, lambda v: v <= {x})) + 1] - {ys}[len(list_filter({xs}, lambda v: v <= {x}))]) / ({xs}[len(list_filter({xs}, lambda v: v <= {x})) + 1] - {xs}[len(list_filter({xs}, lambda v: v <= {x}))]) END)"


def sql_interp(x: str, xs: str = "xs", ys: str = "ys") -> str:
    return _INTERP.format(x=x, xs=xs, ys=ys)


_SLICES = """WITH t AS (SELECT epoch_us(ts) AS u, epoch_us(ts) // 86400000000 AS day, upper(trim(instrument)) AS n, iv / 100 AS iv, index_price AS idx FROM trades_options WHERE iv BETWEEN 1 AND 500 AND index_price > 0),
obs AS (SELECT u, day, split_part(n, '-', 1) AS currency, epoch_us(strptime(split_part(n, '-', 2), '%d%b%y')) + 28800000000 AS expiry, CAST(split_part(n, '-', 3) AS DOUBLE) AS strike, iv, idx FROM t),
o AS (SELECT *, (expiry - day * 86400000000 - 29100000000) / 1e6 / 31536000.0 AS tau FROM obs WHERE (expiry - day * 86400000000 - 29100000000) / 1e6 / 31536000.0 > 2.0 / 365),
fw AS (SELECT day, currency, expiry, median(idx) AS forward FROM o GROUP BY ALL),
st AS (SELECT day, currency, expiry, tau, strike, avg(iv * iv) AS v, count(*) AS n, var_pop(iv) AS scatter FROM o GROUP BY ALL),
pt AS (SELECT st.*, forward, ln(strike / forward) AS k, v * tau AS w FROM st JOIN fw USING (day, currency, expiry)),
sl AS (SELECT day, currency, expiry, tau, forward, list(k ORDER BY k) AS xs, list(w ORDER BY k) AS ys, list(n ORDER BY k) AS ns, sqrt(avg(scatter)) AS rmse FROM pt GROUP BY ALL HAVING count(*) >= 3)
"""


def _trade_obs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trades_options").filter("iv between 1 and 500 and index_price > 0")
    o = options.canonical_trades(t).withColumn("__i", options.parse("instrument"))
    o = o.select(F.to_date("source_ts").alias("snap_date"), "currency", F.col("__i.expiry").alias("expiry"), F.col("__i.strike").alias("strike"), F.col("index_price").alias("index"), F.col("iv_trade").alias("iv"), "source_ts")
    return options.add_tau(o).filter(F.col("tau") > 2.0 / 365)


def _slices(spark: SparkSession, d: str) -> DataFrame:
    return marketgrid.slices(_trade_obs(spark, d), SNAP)


_GRID = _SLICES + ", g AS (SELECT day, currency, tau, i, -0.4 + 0.8 * i / 8.0 AS k, " + sql_interp("(-0.4 + 0.8 * i / 8.0)") + " AS w, xs, ns, rmse FROM sl, (SELECT unnest(range(9)) AS i))\n"


@query(_GRID + f"SELECT {_DAY_SQL}, currency, round(tau, 9) AS tau, i, round(w, 9) AS w FROM g")
def market_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each expiry's variance of a day on nine shared values of moneyness."""
    return marketgrid.shared_grid(_slices(spark, d)).select(_day(), "currency", F.round("tau", 9).alias("tau"), F.col("i").cast("long").alias("i"), F.round("w", 9).alias("w"))


def _fly_sql(source: str, order: str) -> str:
    """CTEs fly (per day and currency) from rows day, currency, tau, k, w of ``source``."""
    return f""", bc AS (SELECT day, currency, tau, {order} AS pos, exp(k) AS x, -k / sqrt(w) + sqrt(w) / 2 AS d1, sqrt(w) AS sw FROM {source}),
bp AS (SELECT day, currency, tau, pos, x, {sql_cdf("d1")} - x * {sql_cdf("(d1 - sw)")} AS c FROM bc),
bs AS (SELECT day, currency, tau, pos, (lead(c) OVER o - c) / (lead(x) OVER o - x) AS s FROM bp WINDOW o AS (PARTITION BY day, currency, tau ORDER BY pos)),
bd AS (SELECT *, lead(s) OVER (PARTITION BY day, currency, tau ORDER BY pos) - s AS ds FROM bs),
fly AS (SELECT day, currency, count(*) FILTER (WHERE ds < -1e-10) AS butterfly, coalesce(max(-ds) FILTER (ds < -1e-10), 0) AS butterfly_max, count(*) FILTER (WHERE s > 1e-10 OR s < -1 - 1e-10) AS vertical,
 coalesce(max(greatest(s, 0) + greatest(-1 - s, 0)) FILTER (s > 1e-10 OR s < -1 - 1e-10), 0) AS vertical_max FROM bd GROUP BY ALL)
"""


_ARB = (
    _GRID
    + """, lg AS (SELECT day, currency, w - lag(w) OVER (PARTITION BY day, currency, i ORDER BY tau) AS dw FROM g),
cal AS (SELECT day, currency, count(*) FILTER (WHERE dw < -1e-10) AS calendar, coalesce(max(-dw) FILTER (dw < -1e-10), 0) AS calendar_max FROM lg GROUP BY ALL),
ns AS (SELECT day, currency, count(*) AS n_slices FROM sl GROUP BY ALL)"""
    + _fly_sql("g", "i")
    + """, arb AS (SELECT *, least(1, (butterfly + calendar)::DOUBLE / (n_slices * 9 + (n_slices - 1) * 9)) AS rate FROM cal JOIN fly USING (day, currency) JOIN ns USING (day, currency))
"""
)


def _market_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    g = durable(marketgrid.shared_grid(_slices(spark, d)).select(*SNAP, "tau", "i", "k", "w"))
    cal = arbitrage.calendar_breaches(g, SNAP, k="i")
    j = cal.join(arbitrage.butterfly_breaches(g, SNAP), SNAP).join(g.groupBy(*SNAP).agg(F.count_distinct("tau").alias("n_slices")), SNAP)
    return j.withColumn("rate", arbitrage.market_rate(F.col("butterfly"), F.col("calendar"), F.col("n_slices")))


@query(_ARB + f"SELECT {_DAY_SQL}, currency, n_slices, calendar, round(calendar_max, 9) AS calendar_max, butterfly, round(butterfly_max, 8) AS butterfly_max, vertical, round(vertical_max, 8) AS vertical_max, round(rate, 9) AS rate FROM arb")
def market_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of each day's market before any fit, worst sizes and the share of possible ones."""
    a = _market_arbitrage(spark, d)
    digits = {"calendar_max": 9, "butterfly_max": 8, "vertical_max": 8, "rate": 9}
    return a.select(_day(), "currency", "n_slices", "calendar", "butterfly", "vertical", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(_ARB + "SELECT count(*) AS n_snaps, sum(n_slices)::BIGINT AS n_slices, count(*) FILTER (WHERE calendar + butterfly + vertical = 0) AS n_clean, round(avg(rate), 9) AS mean_rate, round(max(calendar_max), 9) AS worst_calendar FROM arb")
def run_digest(spark: SparkSession, d: str) -> DataFrame:
    """One row over a whole run of snapshots."""
    clean = F.col("calendar") + F.col("butterfly") + F.col("vertical") == 0
    return _market_arbitrage(spark, d).agg(
        F.count(F.lit(1)).alias("n_snaps"), F.sum("n_slices").alias("n_slices"), F.count_if(clean).alias("n_clean"), F.round(F.avg("rate"), 9).alias("mean_rate"), F.round(F.max("calendar_max"), 9).alias("worst_calendar")
    )


@query(
    _SLICES
    + ", nat AS (SELECT pt.day, pt.currency, pt.tau, k, w FROM pt JOIN sl USING (day, currency, expiry))"
    + _fly_sql("nat", "k")
    + f""", pr AS (SELECT day, currency, xs AS x1, ys AS y1, lead(xs) OVER o AS x2, lead(ys) OVER o AS y2 FROM sl WINDOW o AS (PARTITION BY day, currency ORDER BY tau)),
ab AS (SELECT *, greatest(x1[1], x2[1]) AS a, least(x1[-1], x2[-1]) AS b FROM pr WHERE x2 IS NOT NULL),
wd AS (SELECT day, currency, min(greatest(b - a, 0)) AS least_overlap, count(*) FILTER (WHERE b <= a) AS insufficient, count(*) AS pairs FROM ab GROUP BY ALL),
xp AS (SELECT *, a + (b - a) * i / 8.0 AS x FROM ab, (SELECT unnest(range(9)) AS i) WHERE b > a),
vv AS (SELECT day, currency, {sql_interp("x", "x1", "y1")} AS s, {sql_interp("x", "x2", "y2")} AS l FROM xp),
gp AS (SELECT *, CASE WHEN s - l > 1e-10 THEN s - l ELSE 0 END AS gap FROM vv),
cl AS (SELECT day, currency, count(*) FILTER (WHERE gap > 0) AS calendar, max(gap) AS calendar_max, sum(gap) AS calendar_sum, max(gap / greatest((s + l) / 2, 1e-10)) AS relative_max, sum(gap / greatest((s + l) / 2, 1e-10)) AS relative_sum FROM gp GROUP BY ALL)
SELECT {_DAY_SQL}, currency, pairs, insufficient, round(least_overlap, 9) AS least_overlap, coalesce(calendar, 0) AS calendar, round(coalesce(calendar_max, 0), 9) AS calendar_max, round(coalesce(calendar_sum, 0), 9) AS calendar_sum,
 round(coalesce(relative_max, 0), 7) AS relative_max, round(coalesce(relative_sum, 0), 7) AS relative_sum, butterfly, vertical, butterfly = 0 AND vertical = 0 AND coalesce(calendar, 0) = 0 AND insufficient = 0 AS ok
FROM wd LEFT JOIN cl USING (day, currency) LEFT JOIN fly USING (day, currency)"""
)
def domain_quality(spark: SparkSession, d: str) -> DataFrame:
    q = marketgrid.domain_quality(durable(_slices(spark, d)), SNAP)
    digits = {"least_overlap": 9, "calendar_max": 9, "calendar_sum": 9, "relative_max": 7, "relative_sum": 7}
    return q.select(_day(), "currency", "pairs", "insufficient", "calendar", "butterfly", "vertical", "ok", *[F.round(c, n).alias(c) for c, n in digits.items()])


_CHANNELS = _GRID + """, ch AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_filter(list_zip(xs, ns), lambda z: abs(z[1] - k) <= 0.05), lambda z: z[2])), 0) AS BIGINT) AS n_obs, k < xs[1] - 1e-9 OR k > xs[-1] + 1e-9 AS extrap,
 NOT (k < xs[1] - 1e-9 OR k > xs[-1] + 1e-9) AND len(list_filter(xs, lambda v: abs(v - k) < 1e-9)) = 0 AS interp FROM g),
wt AS (SELECT *, greatest(0, least(1, least(n_obs / 5.0, 1) * (CASE WHEN extrap THEN 0 WHEN interp THEN 0.5 ELSE 1 END) * pow(2, -rmse / 0.05))) AS weight FROM ch)
"""


@query(_CHANNELS + f"SELECT {_DAY_SQL}, currency, round(tau, 9) AS tau, i, round(ln(1 + n_obs), 9) AS log_n_obs, interp, extrap, round(rmse, 7) AS rmse, round(weight, 7) AS weight FROM wt")
def quality_channels(spark: SparkSession, d: str) -> DataFrame:
    q = marketgrid.quality_channels(marketgrid.shared_grid(_slices(spark, d)))
    return q.select(_day(), "currency", F.round("tau", 9).alias("tau"), F.col("i").cast("long").alias("i"), F.round("log_n_obs", 9).alias("log_n_obs"), "interp", "extrap", F.round("rmse", 7).alias("rmse"), F.round("weight", 7).alias("weight"))


@query(
    _CHANNELS
    + f""", lt AS (SELECT day, currency, (expiry - day * 86400000000 - 29100000000) / 1e6 / 31536000.0 AS tau, max(u // 1000 * 1000) AS last_u FROM o GROUP BY ALL),
r AS (SELECT day, currency, tau, count(*) FILTER (WHERE n_obs < 1) > 0 AS low, avg(CASE WHEN interp THEN 1.0 ELSE 0 END) AS fi, avg(CASE WHEN extrap THEN 1.0 ELSE 0 END) AS fe FROM wt GROUP BY ALL)
SELECT {_DAY_SQL}, currency, round(tau, 9) AS tau, CASE WHEN low THEN 'flags' || CASE WHEN last_u > day * 86400000000 + 29100000000 THEN ',lookahead' ELSE '' END WHEN last_u > day * 86400000000 + 29100000000 THEN 'lookahead' ELSE '' END AS breaches
FROM r JOIN lt USING (day, currency, tau)"""
)
def daily_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Slices as rows of lists that were told to have no thin cells, and used the whole day: where that does not hold, and where it looks ahead."""
    obs = _trade_obs(spark, d)
    cells = marketgrid.quality_channels(marketgrid.shared_grid(marketgrid.slices(obs, SNAP)))
    order = F.array_sort(F.collect_list(F.struct("i", "w", F.col("cell_n_obs").alias("n_obs"), "interp", "extrap", "rmse", "weight")))
    rows = cells.groupBy(*SNAP, "tau").agg(order.alias("c"))
    take = lambda f: F.transform("c", lambda x: x[f])
    rows = rows.select(*SNAP, "tau", *[take(f).alias(f) for f in ("w", "n_obs", "interp", "extrap", "rmse", "weight")])
    share = lambda c: F.size(F.filter(c, lambda x: x)) / F.size(c)
    told = F.array_compact(F.array(F.when(F.exists("interp", lambda x: x), F.lit("interpolated_grid_cells")), F.when(F.exists("extrap", lambda x: x), F.lit("extrapolated_grid_cells"))))
    last = obs.groupBy(*SNAP, "tau").agg(F.max("source_ts").alias("max_source_ts"))
    rows = rows.withColumns({"flags": told, "interp_fraction": share("interp"), "extrap_fraction": share("extrap"), "n_reference": F.lit(1), "snap_ts": snap_ts("snap_date")}).join(last, [*SNAP, "tau"])
    return marketgrid.coherence(rows, 9).select(_day(), "currency", F.round("tau", 9).alias("tau"), F.array_join("breaches", ",").alias("breaches"))


@query(
    _SLICES
    + f""", tn AS (SELECT day, currency, tau, {sql_interp("0.0")} AS atm, n AS tenor, abs(tau - n / 365.0) AS gap FROM sl, (SELECT unnest([7, 14, 30, 60, 90, 180]) AS n)),
r AS (SELECT day, currency, tenor, arg_min({{'tau': tau, 'atm': atm, 'gap': gap}}, (gap, tau)) AS r FROM tn GROUP BY ALL)
SELECT {_DAY_SQL}, currency, CAST(tenor AS BIGINT) AS tenor, round(r.tau, 9) AS tau, round(r.atm, 9) AS atm_w, r.gap >= 1e-9 AS interp FROM r"""
)
def nearest_slices(spark: SparkSession, d: str) -> DataFrame:
    n = marketgrid.nearest_slices(_slices(spark, d), SNAP, (7, 14, 30, 60, 90, 180))
    return n.select(_day(), "currency", F.col("tenor").cast("long").alias("tenor"), F.round("tau", 9).alias("tau"), F.round("atm_w", 9).alias("atm_w"), "interp")


@query(
    _SLICES
    + f""", j AS (SELECT o.day, o.currency, o.expiry, o.iv, sl.tau, ln(o.strike / sl.forward) AS x, xs, ys FROM o JOIN sl USING (day, currency, expiry))
SELECT {_DAY_SQL}, currency, expiry // 1000 AS expiry_ms, count(*) AS n, round(sqrt(avg(pow(sqrt({sql_interp("x")} / tau) - iv, 2))), 7) AS rmse FROM j GROUP BY day, currency, expiry"""
)
def slice_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Raw volatilities against the curve of their own expiry."""
    obs = _trade_obs(spark, d)
    r = marketgrid.residuals(obs, marketgrid.slices(obs, SNAP), SNAP)
    return r.select(_day(), "currency", F.unix_millis("expiry").alias("expiry_ms"), "n", F.round("rmse", 7).alias("rmse"))


@query(
    _GRID
    + f""", every AS (SELECT DISTINCT day, currency FROM obs), c AS (SELECT day, currency, count(*) AS n FROM sl GROUP BY ALL)
SELECT {_DAY_SQL}, currency, CASE WHEN n IS NULL THEN 'surface_missing' WHEN n < 2 THEN 'surface_parameter_rows' ELSE 'ok' END AS reason FROM every LEFT JOIN c USING (day, currency)"""
)
def surface_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = durable(_slices(spark, d))
    t = table(spark, d, "trades_options").filter("iv between 1 and 500 and index_price > 0")
    every = options.canonical_trades(t).select(F.to_date("source_ts").alias("snap_date"), "currency").distinct()
    return marketgrid.reasons(every, s, marketgrid.shared_grid(s), SNAP).select(_day(), "currency", "reason")


@query(_ARB + f"SELECT {_DAY_SQL}, currency, n_slices, calendar + butterfly + vertical > 0 AS moved, 0::BIGINT AS calendar_after FROM arb")
def repaired_market(spark: SparkSession, d: str) -> DataFrame:
    """Each day's market without arbitrage: what was clean stays, what was not moves, and no maturity falls below the one before."""
    g = marketgrid.shared_grid(_slices(spark, d)).select(*SNAP, "tau", "i", "k", "w")
    r = durable(repair.repair_surfaces(g, SNAP, "tau", "i", "k", "w"))
    before = F.lag("repaired_w").over(Window.partitionBy(*SNAP, "i").orderBy("tau"))
    r = r.withColumns({"fell": F.col("repaired_w") - before < -1e-7, "differs": F.col("repaired_w") != F.col("w")})
    out = r.groupBy(*SNAP).agg(F.count_distinct("tau").alias("n_slices"), F.bool_or("differs").alias("moved"), F.count_if("fell").alias("calendar_after"))
    return out.select(_day(), "currency", "n_slices", "moved", "calendar_after")


# ---- the volatility solver on prices whose volatility is known ----


@query(
    _SLICES
    + f""", x AS (SELECT ingest_seq, iv / 100 AS iv, index_price AS f, CAST(split_part(upper(trim(instrument)), '-', 3) AS DOUBLE) AS k,
 (epoch_us(strptime(split_part(upper(trim(instrument)), '-', 2), '%d%b%y')) + 28800000000 - epoch_us(ts) // 1000 * 1000) / 1e6 / 31536000.0 AS tau FROM trades_options WHERE iv BETWEEN 20 AND 200 AND index_price > 0),
y AS (SELECT * FROM x WHERE tau > 1.0 / 365 AND abs(ln(f / k)) < 2 * iv * sqrt(tau))
SELECT ingest_seq, round(iv, 6) AS iv_recomputed, CASE WHEN ingest_seq % 7 = 0 THEN 'mark' ELSE 'trade' END AS iv_source, CAST(CASE WHEN ingest_seq % 7 <> 0 AND ingest_seq % 5 = 0 THEN 8 ELSE 0 END AS BIGINT) AS flags FROM y"""
)
def volatility_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Premiums made from each trade's own volatility: the solver must find it again.

    One trade in five quotes a volatility three points off and must be flagged; one in
    seven quotes none, so the recomputed one steps in.
    """
    from ivlattice.functions import black76
    from ivlattice.functions.numeric import years_between

    t = options.canonical_trades(table(spark, d, "trades_options").filter("iv between 20 and 200 and index_price > 0")).withColumn("__i", options.parse("instrument"))
    t = t.select("ingest_seq", F.col("__i.strike").alias("strike"), F.col("index_price").alias("forward"), years_between(F.col("__i.expiry"), "source_ts").alias("tau"), "iv_trade", options.sign_of(F.col("__i.cp")).alias("cp_sign"))
    t = t.filter((F.col("tau") > 1.0 / 365) & (F.abs(F.log(F.col("forward") / F.col("strike"))) < 2 * F.col("iv_trade") * F.sqrt("tau")))
    p = black76.priced(t, "forward", "strike", "tau", "iv_trade", "cp_sign").withColumnRenamed("price", "usd_premium")
    off = F.when(F.col("ingest_seq") % 7 == 0, F.lit(None)).when(F.col("ingest_seq") % 5 == 0, F.col("iv_trade") + 0.03).otherwise(F.col("iv_trade"))
    c = options.cross_check(p.withColumn("iv_trade", off))
    return c.select("ingest_seq", F.round("iv_recomputed", 6).alias("iv_recomputed"), "iv_source", F.col("quality_flags").alias("flags"))


QUERIES, SQL = query.QUERIES, query.SQL
