"""Streams over the test tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice.plans.registry import Catalogue
from ivlattice.session import checkpoint_folder, clean_name, durable, remove, table
from ivlattice.streaming import collect

query = Catalogue()


def _drained(rows: DataFrame, mode: str) -> DataFrame:
    """Everything a stream gives, by way of the shared folder; its state and batches are removed again."""
    spark = rows.sparkSession
    at = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    collect.written_batches(rows, f"{at}/rows", f"{at}/state", mode).awaitTermination()
    out = durable(spark.read.schema(rows.schema).parquet(f"{at}/rows/batch_id=*"))
    remove(spark, at)
    return out


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a directory and a test table may be one file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("""WITH t AS (SELECT (epoch_us(ts) + 57300000000 - 1) // 86400000000 AS day, upper(trim(instrument)) AS instrument, coalesce(amount, 0) AS amount FROM trades_options)
SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, instrument, round(sum(amount), 6) AS total, count(*) AS n FROM t GROUP BY day, instrument""")
def stream_day_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _source(spark, d, "trades_options").select("ts", clean_name("instrument").alias("instrument"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    out = _drained(collect.day_totals(t, "ts", ["instrument"], "amount"), "complete")
    return out.select(F.col("snap_date").cast("string").alias("day"), "instrument", F.round("total", 6).alias("total"), "n")


@query("""WITH t AS (SELECT (epoch_us(ts) + 57300000000 - 1) // 86400000000 AS day, upper(trim(instrument)) AS instrument, coalesce(amount, 0) AS amount FROM trades_options),
closed AS (SELECT ((epoch_us(max(ts)) - 1) // 1000 - 21600000) * 1000 AS mark FROM trades_options)
SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, instrument, round(sum(amount), 6) AS total, count(*) AS n
FROM t, closed WHERE day * 86400000000 + 29100000000 <= mark GROUP BY day, instrument""")
def stream_closed_days(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the days that the watermark, six hours behind the last trade, has closed: append mode gives no others."""
    t = _source(spark, d, "trades_options").select("ts", clean_name("instrument").alias("instrument"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    out = _drained(collect.day_totals(t, "ts", ["instrument"], "amount"), "append")
    return out.select(F.col("snap_date").cast("string").alias("day"), "instrument", F.round("total", 6).alias("total"), "n")


@query("SELECT DISTINCT instrument, epoch_us(ts) AS at FROM funding")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Hourly funding rows, each kept once as the stream meets it."""
    t = _source(spark, d, "funding").select("ts", "instrument")
    out = _drained(collect.once_within(t, "ts", ["instrument", "ts"]), "append")
    return out.select("instrument", F.unix_micros("ts").alias("at"))


QUERIES, SQL = query.QUERIES, query.SQL
