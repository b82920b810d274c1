"""Scans, projections, filters, joins, aggregates and windows over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ivlattice.functions import flags
from ivlattice.functions.calendar import calendar_features, snap_ts
from ivlattice.functions.numeric import bucket_index, decay_weight, finite
from ivlattice.operators import asof, median, relational, snapwindow
from ivlattice.plans.registry import Catalogue
from ivlattice.session import micros, table

query = Catalogue()


@query("""SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' AND l_quantity > 10""")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    ship = F.col("l_shipdate")
    picked = t.filter((ship >= F.lit("1996-01-01").cast("timestamp_ntz")) & (ship < F.lit("1996-07-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 10))
    return picked.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-06 12:00:00"))
    return table(spark, d, "events").filter(F.col("ts").between(a, b)).select("event_id", "user_id", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT DISTINCT upper(trim(instrument)) AS name, split_part(upper(trim(instrument)), '-', 1) AS currency,
 CAST(regexp_extract(upper(trim(instrument)), '-([0-9.]+)-[CP]$', 1) AS DOUBLE) AS strike, regexp_extract(upper(trim(instrument)), '-([CP])$', 1) AS cp,
 CAST(strptime(regexp_extract(upper(trim(instrument)), '-([0-9]+[A-Z]{3}[0-9]{2})-', 1), '%d%b%y') AS TIMESTAMP) + INTERVAL 8 HOUR AS expiry FROM trades_options""")
def instrument_parse(spark: SparkSession, d: str) -> DataFrame:
    from ivlattice.functions.instrument import parse_or_raise
    from ivlattice.session import clean_name

    names = table(spark, d, "trades_options").select(clean_name("instrument").alias("name")).distinct()
    i = names.select("name", parse_or_raise("name").alias("i"))
    return i.select("name", "i.currency", "i.strike", "i.cp", F.col("i.expiry").cast("timestamp_ntz").alias("expiry"))


@query("""SELECT quote_id, make_timestamp(timestamp) AS quote_ts, make_timestamp(expiration * 1000) AS expiry_ts,
 timestamp // 1000 AS ms FROM tardis_sample""")
def epoch_units(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tardis_sample")
    return t.select(
        "quote_id",
        F.timestamp_micros("timestamp").cast("timestamp_ntz").alias("quote_ts"),
        F.timestamp_millis("expiration").cast("timestamp_ntz").alias("expiry_ts"),
        F.unix_millis(F.timestamp_micros("timestamp")).alias("ms"),
    )


@query("""WITH x AS (SELECT l_linestatus, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN CAST('nan' AS DOUBLE)
 WHEN l_linenumber = 3 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS v FROM lineitem)
SELECT l_linestatus, count(*) AS n, count_if(coalesce(isfinite(v), false)) AS n_finite, count_if(v IS NULL) AS n_null, count_if(isnan(v)) AS n_nan,
 sum(CASE WHEN isfinite(v) THEN v END) AS total FROM x GROUP BY l_linestatus""")
def null_nan_finite(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    v = F.when(n == 1, None).when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    t = table(spark, d, "lineitem").select("l_linestatus", v.alias("v"))
    return t.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(finite("v")).alias("n_finite"),
        F.count_if(F.col("v").isNull()).alias("n_null"),
        F.count_if(F.isnan("v")).alias("n_nan"),
        F.sum(F.when(finite("v"), F.col("v"))).alias("total"),
    )


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    mask = flags.combine(
        flags.bit(c("l_linenumber") > 5, flags.TAU_TOO_SHORT),
        flags.bit((c("l_discount") < 0.01) | (c("l_discount") > 0.09), flags.DELTA_OUT_OF_BAND),
        flags.bit(~c("l_extendedprice").between(1000, 90000), flags.IV_OUT_OF_BAND),
        flags.bit(c("l_tax") > 0.07, flags.IV_DIVERGENCE),
        flags.bit(c("l_quantity") < 3, flags.BELOW_MIN_SIZE),
        flags.bit(c("l_returnflag") == "R", flags.BLOCK_TRADE),
    )
    return table(spark, d, "lineitem").withColumn("mask", mask)


_MASK = """(CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END | CASE WHEN l_discount < 0.01 OR l_discount > 0.09 THEN 2 ELSE 0 END
 | CASE WHEN NOT l_extendedprice BETWEEN 1000 AND 90000 THEN 4 ELSE 0 END | CASE WHEN l_tax > 0.07 THEN 8 ELSE 0 END
 | CASE WHEN l_quantity < 3 THEN 32 ELSE 0 END | CASE WHEN l_returnflag = 'R' THEN 64 ELSE 0 END)::BIGINT"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_MASK} AS mask FROM lineitem")
def band_flags_bitmask(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "mask")


@query(f"SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, bit_or({_MASK}) AS mask, bit_count(bit_or({_MASK}))::INTEGER AS n_bits FROM lineitem GROUP BY 1")
def bit_or_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = _flagged(spark, d).groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.bit_or("mask").alias("mask"))
    return g.withColumn("n_bits", F.bit_count("mask"))


@query(f"SELECT l_returnflag, ({_MASK} & 55) <> 0 AS rejected, count(*) AS n FROM lineitem GROUP BY ALL")
def reject_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).withColumn("rejected", flags.rejected("mask")).groupBy("l_returnflag", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, round(exp(-ln(2) * ((epoch_us(ts::DATE::TIMESTAMP + INTERVAL 485 MINUTE + CASE WHEN ts::TIME > TIME '08:05:00' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)
 - epoch_us(ts)) / 1e6) / 900), 9) AS weight FROM events""")
def staleness_weight(spark: SparkSession, d: str) -> DataFrame:
    from ivlattice.functions.calendar import feature_day

    t = table(spark, d, "events")
    age = (F.unix_micros(snap_ts(feature_day(F.col("ts").cast("timestamp")))) - micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return t.select("event_id", F.round(decay_weight(age, 900.0), 9).alias("weight"))


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL")
def exact_median(spark: SparkSession, d: str) -> DataFrame:
    return median.exact_median(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), s AS (SELECT e.event_type, m.med, median(abs(e.value - m.med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY ALL)
SELECT e.event_id, e.event_type, abs(e.value - s.med) > 2 * s.mad AS is_outlier FROM events e JOIN s USING (event_type)""")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return median.mad_outliers(table(spark, d, "events"), ["event_type"], "value", 2.0).select("event_id", "event_type", "is_outlier")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return relational.latest_by(t, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return relational.earliest_by(t, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_breaches(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH days AS (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS snap_date),
p AS (SELECT d.snap_date, e.event_id, e.user_id % 5 AS grp, (epoch_us(d.snap_date::TIMESTAMP) + 29100000000 - epoch_us(e.ts)) AS age FROM events e JOIN days d
 ON e.ts <= d.snap_date::TIMESTAMP + INTERVAL 485 MINUTE AND e.ts > d.snap_date::TIMESTAMP + INTERVAL 125 MINUTE),
s AS (SELECT *, least(age // 3600000000, 5) AS step FROM p),
g AS (SELECT snap_date, k, min(n) AS least_n FROM (SELECT snap_date, grp, k, count(*) AS n FROM s, (SELECT unnest(range(6)) AS k) WHERE step <= k GROUP BY ALL) GROUP BY ALL),
c AS (SELECT snap_date, coalesce(min(CASE WHEN least_n >= 4 THEN k END), 5) AS k FROM g GROUP BY snap_date)
SELECT strftime(s.snap_date, '%Y-%m-%d') AS snap_date, s.event_id, CAST((c.k + 1) * 60 AS BIGINT) AS window_minutes, s.age / 1e6 AS staleness_s FROM s JOIN c USING (snap_date) WHERE s.step <= c.k""")
def snap_window_widening(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("grp"), F.col("ts").cast("timestamp").alias("ts"))
    return snapwindow.snap_window(t, "ts", ["grp"]).select(F.col("snap_date").cast("string").alias("snap_date"), "event_id", "window_minutes", "staleness_s")


def _asof_events(spark: SparkSession, d: str, max_age_us: int | None) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type <> 'error'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"))
    out = asof.asof_backward(left, right, ["user_id"], "ts", "seen", ["seen_id"], tie=["seen_id"], max_age_us=max_age_us)
    return out.select("event_id", "user_id", "seen_id")


@query("""SELECT l.event_id, l.user_id, r.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof_events(spark, d, None)


@query("""SELECT l.event_id, l.user_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 7200000000 THEN r.event_id END AS seen_id FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_max_age(spark: SparkSession, d: str) -> DataFrame:
    return _asof_events(spark, d, 7_200_000_000)


@query("""SELECT n_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def dimension_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    p, s, n = (table(spark, d, x) for x in ("part", "supplier", "nation"))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH s AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS day)
SELECT strftime(day, '%Y-%m-%d') AS day FROM s WHERE day NOT IN (SELECT o_orderdate::DATE FROM orders)""")
def date_spine_gaps(spark: SparkSession, d: str) -> DataFrame:
    return relational.day_gaps(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day").select(F.col("day").cast("string"))


@query("SELECT strftime(unnest(generate_series(date_trunc('month', min(ts)), max(ts), INTERVAL 1 MONTH)), '%Y-%m-%d') AS month FROM (SELECT (ts AT TIME ZONE 'UTC')::TIMESTAMP AS ts FROM trades_options)")
def month_spine(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "trades_options").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return ends.select(relational.month_spine("a", "b").alias("month")).select(F.col("month").cast("string"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT day, n + 1000 AS n FROM o WHERE day >= '2000-01-01')
SELECT * FROM r UNION ALL SELECT * FROM o WHERE day NOT IN (SELECT day FROM r)""")
def rerun_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    new = old.filter("day >= '2000-01-01'").withColumn("n", F.col("n") + 1000)
    return relational.merge_rerun(old, new, ["day"])


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return a.intersect(table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return a.exceptAll(table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY coalesce(p_retailprice, 0) DESC, p_partkey LIMIT 300")
def topk_stable(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.coalesce("p_retailprice", F.lit(0.0)).desc(), F.col("p_partkey")], 300)


@query("""WITH a AS (SELECT l_returnflag AS f, CAST(floor(l_quantity / 10) AS BIGINT) AS b, avg(l_discount) AS m, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
z AS (SELECT l_returnflag AS f, CAST(floor(l_quantity / 10) AS BIGINT) AS b, avg(l_discount) AS m, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT f, b, round(a.m, 9) AS m_open, round(z.m, 9) AS m_done, a.n AS n_open, z.n AS n_done, abs(a.m - z.m) <= 0.0005 AS within FROM a JOIN z USING (f, b)""")
def bucket_compare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), bucket_index("l_quantity", 10.0).alias("b"), "l_linestatus", "l_discount")
    side = lambda s, n: t.filter(F.col("l_linestatus") == s).groupBy("f", "b").agg(F.avg("l_discount").alias(f"m_{n}"), F.count(F.lit(1)).alias(f"n_{n}"))
    j = side("O", "open").join(side("F", "done"), ["f", "b"])
    return j.select("f", "b", F.round("m_open", 9).alias("m_open"), F.round("m_done", 9).alias("m_done"), "n_open", "n_done", (F.abs(F.col("m_open") - F.col("m_done")) <= 0.0005).alias("within"))


@query("""SELECT p_size // 10 AS size_bucket, p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high,
 round(sum(p_retailprice), 4) AS total FROM part GROUP BY ALL""")
def coverage_heatmap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").withColumn("size_bucket", F.expr("cast(p_size div 10 as int)"))
    p = "p_retailprice"
    return t.groupBy("size_bucket", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.sum(p), 4).alias("total")
    )


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
f AS (SELECT day, last_day(day) - CAST((isodow(last_day(day)) + 2) % 7 AS INTEGER) AS fri, last_day((date_trunc('month', day) + INTERVAL 1 MONTH)::DATE) AS e2 FROM d),
q AS (SELECT day, last_day(make_date(year(day), ((month(day) - 1) // 3) * 3 + 3, 1)) AS q1 FROM d)
SELECT strftime(f.day, '%Y-%m-%d') AS day, CAST(isodow(f.day) - 1 AS BIGINT) AS day_of_week,
 CASE WHEN f.fri > f.day THEN date_diff('day', f.day, f.fri) ELSE date_diff('day', f.day, e2 - CAST((isodow(e2) + 2) % 7 AS INTEGER)) END AS days_to_monthly_expiry,
 CASE WHEN q1 - CAST((isodow(q1) + 2) % 7 AS INTEGER) > f.day THEN date_diff('day', f.day, q1 - CAST((isodow(q1) + 2) % 7 AS INTEGER))
  ELSE date_diff('day', f.day, last_day((q1 + 1 + INTERVAL 2 MONTH)::DATE) - CAST((isodow(last_day((q1 + 1 + INTERVAL 2 MONTH)::DATE)) + 2) % 7 AS INTEGER)) END AS days_to_quarterly_expiry
FROM f JOIN q USING (day)""")
def calendar_columns(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), *calendar_features("day"))


@query("""SELECT count_if(l_shipdate > o_orderdate + INTERVAL 30 DAY) AS late, count_if(l_shipdate <= o_orderdate) AS early, count(*) AS n, max(greatest(l_shipdate, o_orderdate)) AS newest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def leakage_counts(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(
        F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 30 days")).alias("late"),
        F.count_if(F.col("l_shipdate") <= F.col("o_orderdate")).alias("early"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.greatest("l_shipdate", "o_orderdate")).alias("newest"),
    )


@query("""SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'rich' END, CASE WHEN c_nationkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS marks FROM customer""")
def flag_list_ordered(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "customer").select("c_custkey", flags.flag_list(("negative", c("c_acctbal") < 0), ("rich", c("c_acctbal") > 9000), ("even", c("c_nationkey") % 2 == 0)).alias("marks"))


@query("""WITH h AS (SELECT *, lag(l_quantity) OVER w AS before, lead(l_quantity) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity))
SELECT l_returnflag, count_if(before < l_quantity) AS rises, count_if(after - 2 * l_quantity + before < 0) AS bends, count(before) AS n FROM h GROUP BY l_returnflag""")
def lag_lead_curvature(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    h = t.withColumns({"before": F.lag("l_quantity").over(w), "after": F.lead("l_quantity").over(w)})
    q = F.col("l_quantity")
    return h.groupBy("l_returnflag").agg(
        F.count_if(F.col("before") < q).alias("rises"), F.count_if(F.col("after") - 2 * q + F.col("before") < 0).alias("bends"), F.count("before").alias("n")
    )


@query("""SELECT o_orderpriority, regr_count(o_totalprice, o_custkey)::BIGINT AS n, count(DISTINCT o_custkey) AS customers,
 round(least(1, count_if(o_orderstatus = 'F')::DOUBLE / nullif(count_if(o_orderstatus = 'O'), 0)), 9) AS rate FROM orders GROUP BY ALL""")
def clamped_ratio(spark: SparkSession, d: str) -> DataFrame:
    rate = F.least(F.lit(1.0), F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("o_totalprice").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(rate, 9).alias("rate")
    )


QUERIES, SQL = query.QUERIES, query.SQL
