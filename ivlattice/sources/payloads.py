"""Tables from stored API responses: one JSON text per row, parsed with fixed schemas.

Fetching is left to whatever lands the responses (no network here); a row is one
response page. Pages may overlap: rows of one identity are kept once, the first
page by ``page`` wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.functions.instrument import parse
from ivlattice.operators.relational import earliest_by

TRADES = "trades array<struct<timestamp: bigint, instrument_name: string, price: double, iv: double, amount: double, index_price: double, trade_id: string, block_trade_id: string>>"
CANDLES = "ticks array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
INDEX = "data array<array<double>>, continuation bigint"
FUNDING = "array<struct<timestamp: bigint, interest_1h: double, interest_8h: double, index_price: double>>"
DELIVERIES = "data array<struct<date: string, delivery_price: double>>, records_total bigint"
INSTRUMENTS = "array<struct<instrument_name: string, kind: string, expiration_timestamp: bigint, strike: double, option_type: string, creation_timestamp: bigint>>"


def _rows(pages: DataFrame, schema: str, items: str | None, keep: list[str]) -> DataFrame:
    body = F.from_json("body", schema)
    return pages.select("page", *keep, F.explode(body[items] if items else body).alias("x"))


def trades(pages: DataFrame) -> DataFrame:
    """Trades of all pages (page long, body string), each trade_id once."""
    t = _rows(pages, TRADES, "trades", []).filter(F.col("x.trade_id").isNotNull())
    i = parse(F.col("x.instrument_name"))
    rows = t.select(
        "page",
        F.timestamp_millis("x.timestamp").alias("ts"),
        F.col("x.instrument_name").alias("instrument"),
        i["expiry"].alias("expiry"),
        i["strike"].alias("strike"),
        i["cp"].alias("cp"),
        F.col("x.price").alias("price_btc"),
        F.col("x.iv").alias("iv"),
        F.col("x.amount").alias("amount"),
        F.col("x.index_price").alias("index_price"),
        F.col("x.trade_id").alias("trade_id"),
        F.col("x.block_trade_id").isNotNull().alias("block_flag"),
    )
    return earliest_by(rows, ["trade_id"], ["page", "ts"]).drop("page")


def candles(pages: DataFrame) -> DataFrame:
    """Bars of all pages (page, instrument, body), each instrument and open time once."""
    b = pages.select("page", "instrument", F.from_json("body", CANDLES).alias("b"))
    z = b.select("page", "instrument", F.explode(F.arrays_zip("b.ticks", "b.open", "b.high", "b.low", "b.close", "b.volume")).alias("z"))
    rows = z.select("page", "instrument", F.timestamp_millis("z.ticks").alias("ts"), "z.open", "z.high", "z.low", "z.close", "z.volume")
    return earliest_by(rows.filter(F.col("ts").isNotNull()), ["instrument", "ts"], ["page"]).drop("page")


def volatility_index(pages: DataFrame) -> DataFrame:
    """Index candles of all pages (page, currency, body)."""
    r = _rows(pages, INDEX, "data", ["currency"]).filter(F.size("x") >= 5)
    rows = r.select("page", "currency", F.timestamp_millis(F.col("x")[0].cast("long")).alias("ts"), *[F.col("x")[i].alias(c) for i, c in enumerate(("open", "high", "low", "close"), 1)])
    return earliest_by(rows, ["currency", "ts"], ["page"]).drop("page")


def funding(pages: DataFrame) -> DataFrame:
    """Funding rows of all pages (page, instrument, body)."""
    r = _rows(pages, FUNDING, None, ["instrument"])
    rows = r.select("page", "instrument", F.timestamp_millis("x.timestamp").alias("ts"), "x.interest_1h", "x.interest_8h", "x.index_price")
    return earliest_by(rows.filter(F.col("ts").isNotNull()), ["instrument", "ts"], ["page"]).drop("page")


def deliveries(pages: DataFrame) -> DataFrame:
    """Delivery prices of all pages (page, index, body)."""
    r = _rows(pages, DELIVERIES, "data", ["index"])
    return earliest_by(r.select("page", "index", "x.date", "x.delivery_price"), ["index", "date"], ["page"]).drop("page")


def instruments(pages: DataFrame) -> DataFrame:
    """Instruments of all pages (page, body), calls and puts as C and P."""
    r = _rows(pages, INSTRUMENTS, None, [])
    cp = F.when(F.col("x.option_type") == "call", "C").when(F.col("x.option_type") == "put", "P")
    rows = r.select(
        "page",
        F.col("x.instrument_name").alias("instrument"),
        F.col("x.kind").alias("kind"),
        F.timestamp_millis("x.expiration_timestamp").alias("expiry"),
        F.col("x.strike").alias("strike"),
        cp.alias("cp"),
        F.timestamp_millis("x.creation_timestamp").alias("creation_ts"),
    )
    return earliest_by(rows, ["instrument"], ["page"]).drop("page")
