"""Sources and sinks as queries: tables go out through a sink and come back through its scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice import contracts
from ivlattice.operators import badrows, relational
from ivlattice.plans.registry import Catalogue
from ivlattice.session import checkpoint_folder, clean_name, durable, micros, remove, table
from ivlattice.sources import payloads, tables

query = Catalogue()


def stored(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives of a folder that ``write`` has filled; the folder is removed again."""
    at = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    write(at)
    out = durable(read(at))
    remove(spark, at)
    return out


@query("SELECT trade_id, instrument, epoch_us(ts) AS at, price, amount FROM trades_futures WHERE ts BETWEEN TIMESTAMPTZ '2024-02-10 00:00:00+00' AND TIMESTAMPTZ '2024-03-20 12:00:00+00'")
def partitioned_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table in folders by month, of which a time range reads its months only."""
    t = table(spark, d, "trades_futures").withColumn("month", F.date_format("ts", "yyyy-MM"))

    def read(at: str) -> DataFrame:
        rows = tables.between(spark.read.parquet(at), "ts", "2024-02-10 00:00:00", "2024-03-20 12:00:00", "month")
        return tables.known_columns(rows, contracts.TRADES_FUTURES).select("trade_id", "instrument", micros("ts").alias("at"), "price", "amount")

    return stored(spark, lambda at: tables.write_days(t, at, "month", ["ts"]), read)


@query("SELECT DISTINCT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM funding")
def partition_days(spark: SparkSession, d: str) -> DataFrame:
    """The days that a table has folders for, by their names alone; names that are no day are left out."""
    f = table(spark, d, "funding").withColumn("snap_date", F.to_date("ts"))

    def write(at: str) -> None:
        tables.write_days(f.select("snap_date", "instrument"), at)
        f.limit(1).write.parquet(f"{at}/snap_date=unreadable")

    return stored(spark, write, lambda at: tables.partition_days(spark, at).select(F.col("snap_date").cast("string").alias("day")))


@query("""SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, instrument, count(*) AS n, round(sum(coalesce(interest_1h, 0)), 9) AS total FROM funding
WHERE NOT (ts >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND ts < TIMESTAMPTZ '2024-04-01 00:00:00+00' AND day(ts AT TIME ZONE 'UTC') % 2 = 0) GROUP BY ALL""")
def replaced_days(spark: SparkSession, d: str) -> DataFrame:
    """March is written again without its even days: their folders go, all others stay as they are."""
    f = table(spark, d, "funding").withColumn("snap_date", F.to_date("ts"))
    march = f.filter("snap_date >= '2024-03-01' and snap_date < '2024-04-01'")

    def write(at: str) -> None:
        tables.write_days(f, at)
        tables.replace_days(march.filter("day(snap_date) % 2 = 1"), at, march.select("snap_date"))

    def read(at: str) -> DataFrame:
        g = spark.read.parquet(at).groupBy(F.col("snap_date").cast("string").alias("day"), "instrument")
        return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("interest_1h", F.lit(0.0))), 9).alias("total"))

    return stored(spark, write, read)


@query("SELECT instrument, count(*) AS n, CAST(0 AS BIGINT) AS delivered FROM funding GROUP BY instrument")
def missing_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that is not there counts as an empty one with its columns."""
    gone = tables.scan(spark, f"{d}/delivery_prices.parquet", contracts.DELIVERY_PRICES)
    f = table(spark, d, "funding").join(gone, F.col("instrument") == F.col("index"), "left")
    return f.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count("delivery_price").alias("delivered"))


_CHAIN_COLUMNS = ("timestamp", "strike_price", "expiration", "open_interest", "bid_iv", "ask_price", "mark_iv", "underlying_price", "delta", "rho")


def _as_csv(spark: SparkSession, d: str) -> Callable[[str], None]:
    rows = table(spark, d, "tardis_sample").select(*badrows.COLUMNS)
    return lambda at: rows.write.option("header", True).option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)


@query(f"SELECT upper(trim(symbol)) AS symbol, type, {', '.join(_CHAIN_COLUMNS)} FROM tardis_sample")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped CSV files read with pinned types."""
    return stored(spark, _as_csv(spark, d), lambda at: tables.read_chain_csv(spark, at).select(clean_name("symbol").alias("symbol"), "type", *_CHAIN_COLUMNS))


@query("SELECT strftime(make_timestamp(timestamp), '%Y-%m-%d') AS day, count(*) AS n, count(mark_iv) AS marked, max(strike_price) AS top FROM tardis_sample GROUP BY 1")
def csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    """CSV files streamed by the tasks into a parquet folder per day."""

    def read(at: str) -> DataFrame:
        days = tables.read_chain_csv(spark, f"{at}/csv").withColumn("snap_date", F.to_date(F.timestamp_micros("timestamp")))
        tables.write_days(days, f"{at}/days", sort=["symbol", "timestamp"])
        g = spark.read.parquet(f"{at}/days").groupBy(F.col("snap_date").cast("string").alias("day"))
        return g.agg(F.count(F.lit(1)).alias("n"), F.count("mark_iv").alias("marked"), F.max("strike_price").alias("top"))

    return stored(spark, lambda at: _as_csv(spark, d)(f"{at}/csv"), read)


@query("""WITH q AS (SELECT upper(trim(symbol)) AS instrument, timestamp // 3600000000 * 3600000000 AS hour_us, open_interest FROM tardis_sample)
SELECT split_part(instrument, '-', 1) AS currency, instrument, hour_us, open_interest FROM q WHERE open_interest >= 0 AND isfinite(open_interest)""")
def ndjson_interest(spark: SparkSession, d: str) -> DataFrame:
    """Hourly snapshots appended as JSON lines in two goes, a folder per day, and read back item by item."""
    name, hour = clean_name("symbol"), F.date_trunc("hour", F.timestamp_micros("timestamp"))
    q = table(spark, d, "tardis_sample").select(F.split_part(name, F.lit("-"), F.lit(1)).alias("currency"), hour.alias("hour"), F.struct(name.alias("instrument_name"), "open_interest").alias("item"), "quote_id")

    def write(at: str) -> None:
        for part in (0, 1):
            one = q.filter(F.col("quote_id") % 2 == part).groupBy("currency", "hour").agg(F.collect_list("item").alias("book_summary"))
            tables.append_snapshots(one.select(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("snap_ts"), "currency", "book_summary"), at)

    read = lambda at: tables.collected_interest(tables.read_snapshots(spark, at)).select("currency", "instrument", micros("source_ts").alias("hour_us"), "open_interest")
    return stored(spark, write, read)


QUOTE_RULES = contracts.Contract(
    "quotes",
    "symbol string, timestamp long, mark_iv double, bid_iv double, open_interest double, underlying_price double",
    rules={"mark band": "mark_iv BETWEEN 0 AND 500", "bid below ask": "bid_iv <= ask_iv"},
    finite=frozenset({"mark_iv"}),
    strict=False,
)


@query("""SELECT * FROM (SELECT 'bid_iv is null' AS rule, count_if(bid_iv IS NULL) AS n FROM tardis_sample UNION ALL SELECT 'mark_iv is null', count_if(mark_iv IS NULL) FROM tardis_sample
UNION ALL SELECT 'open_interest is null', count_if(open_interest IS NULL) FROM tardis_sample UNION ALL SELECT 'mark band', count_if(NOT (mark_iv BETWEEN 0 AND 500)) FROM tardis_sample
UNION ALL SELECT 'bid below ask', count_if(NOT (bid_iv <= ask_iv)) FROM tardis_sample UNION ALL SELECT 'mark_iv is not finite', count_if(mark_iv IS NOT NULL AND NOT isfinite(mark_iv)) FROM tardis_sample) WHERE n > 0""")
def contract_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break each rule of a contract, whole table, one pass."""
    return QUOTE_RULES.breach_counts(table(spark, d, "tardis_sample"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count_if(o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY 1),
done AS (SELECT month FROM m WHERE f = n) SELECT month FROM m WHERE month NOT IN (SELECT month FROM done) OR month = (SELECT max(month) FROM done)""")
def months_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Months that a manifest does not list, and again the last that it does."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("whole"))
    return tables.to_fetch(o.select("month"), o.filter("whole"), "month")


@query("""SELECT DISTINCT upper(trim(symbol)) AS instrument, 'option' AS kind, expiration AS expiry_ms, strike_price AS strike, CASE type WHEN 'call' THEN 'C' ELSE 'P' END AS cp FROM tardis_sample""")
def instrument_reference(spark: SparkSession, d: str) -> DataFrame:
    """Instruments from stored response pages that overlap."""
    q = table(spark, d, "tardis_sample")
    item = F.struct(clean_name("symbol").alias("instrument_name"), F.lit("option").alias("kind"), F.col("expiration").alias("expiration_timestamp"), F.col("strike_price").alias("strike"), F.col("type").alias("option_type"))
    pages = q.groupBy(F.expr("quote_id div 100").alias("page")).agg(F.to_json(F.collect_set(item)).alias("body"))
    return payloads.instruments(pages).select("instrument", "kind", F.unix_millis("expiry").alias("expiry_ms"), "strike", "cp")


@query("""WITH f AS (SELECT CAST(l_orderkey % 5 AS BIGINT) AS fold_id, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT fold_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM f""")
def manifest_sink(spark: SparkSession, d: str) -> DataFrame:
    """A split manifest that is checked before it replaces the one before."""
    f = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold_id"), F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rows = f.select("fold_id", "day", F.when(F.col("n") % 3 == 0, "test").otherwise("train").alias("split"), F.lit(False).alias("tune_hyperparameters"))

    def write(at: str) -> None:
        tables.write_manifest(rows.limit(1), at)
        tables.write_manifest(rows, at)

    return stored(spark, write, lambda at: spark.read.parquet(at).select("fold_id", F.col("day").cast("string").alias("day"), "split"))


@query("""WITH a AS (SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, instrument, count(*) AS n FROM funding GROUP BY ALL),
b AS (SELECT day, instrument, n + 1000 AS n FROM a WHERE day BETWEEN '2024-02-01' AND '2024-02-15') SELECT * FROM b UNION ALL SELECT * FROM a WHERE (day, instrument) NOT IN (SELECT (day, instrument) FROM b)""")
def merged_quality_table(spark: SparkSession, d: str) -> DataFrame:
    """A quality table after some days were run again: their rows are the new ones, all others the old."""
    old = table(spark, d, "funding").groupBy(F.to_date("ts").cast("string").alias("day"), "instrument").agg(F.count(F.lit(1)).alias("n"))
    new = old.filter("day between '2024-02-01' and '2024-02-15'").withColumn("n", F.col("n") + 1000)
    return stored(spark, lambda at: relational.merge_rerun(old, new, ["day", "instrument"]).write.parquet(at), spark.read.parquet)


QUERIES, SQL = query.QUERIES, query.SQL
