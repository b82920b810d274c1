"""Candles to feature-day bars, realized volatility, returns and jumps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions.calendar import feature_day
from ivlattice.functions.numeric import finite

DAYS_A_YEAR = 365.0


def valid_candle() -> Column:
    ok = F.lit(True)
    for c in ("open", "high", "low", "close"):
        ok = ok & finite(c) & (F.col(c) > 0)
    return F.coalesce(ok & (F.col("high") >= F.col("low")), F.lit(False))


def daily_bars(candles: DataFrame, key: str, resolution_s: int, need: int | None = None) -> DataFrame:
    """One bar per key and feature day: open, high, low, close, n, last_ts.

    A candle is known at its open time plus the resolution and belongs to the first
    day whose snapshot is at or after that. Candles of one open time count once, the
    one with the largest sequence wins. A day with fewer than ``need`` candles
    (default: as many as fit in a day, exactly) has no bar.
    """
    full = 86_400 // resolution_s
    valid = candles.filter(valid_candle() & F.col("ts").isNotNull())
    one = valid.groupBy(key, "ts").agg(F.max_by(F.struct("open", "high", "low", "close"), "ingest_seq").alias("c")).select(key, "ts", "c.*")
    known = one.withColumn("day", feature_day(F.col("ts") + F.expr(f"interval {resolution_s} seconds")))
    bars = known.groupBy(key, "day").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.count(F.lit(1)).alias("n"),
        (F.max("ts") + F.expr(f"interval {resolution_s} seconds")).alias("last_ts"),
    )
    return bars.filter(F.col("n") == full) if need is None else bars.filter(F.col("n") >= need)


def realized(bars: DataFrame, key: str, horizons: tuple[int, ...] = (1, 5, 22), jump_days: int = 22, jump_multiple: float = 3.0) -> DataFrame:
    """Bars with return_1d, log_range, rv_parkinson_{h}d, rv_garman_klass_{h}d and jump_flag.

    Windows run over calendar days and need every day of them, so a gap gives null
    rather than a compressed window.
    """
    number = F.unix_date("day")
    by_day = Window.partitionBy(key).orderBy(number)
    prev = F.first("close").over(by_day.rangeBetween(-1, -1))
    hl = F.log(F.col("high") / F.col("low"))
    co = F.log(F.col("close") / F.col("open"))
    b = bars.withColumns(
        {
            "return_1d": F.log(F.col("close") / prev),
            "log_range": hl,
            "__gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co,
        }
    )
    out = {}
    for h in horizons:
        w = by_day.rangeBetween(-(h - 1), 0)
        whole = F.count(F.lit(1)).over(w) == h
        out[f"rv_parkinson_{h}d"] = F.when(whole, F.sqrt(DAYS_A_YEAR * F.avg(F.col("log_range") * F.col("log_range")).over(w) / (4 * math.log(2))))
        out[f"rv_garman_klass_{h}d"] = F.when(whole, F.sqrt(DAYS_A_YEAR * F.greatest(F.avg("__gk").over(w), F.lit(0.0))))
    before = by_day.rangeBetween(-jump_days, -1)
    n = F.count("return_1d").over(before)
    sd = F.when(n == jump_days, F.stddev_samp("return_1d").over(before) if jump_days > 1 else F.stddev_pop("return_1d").over(before))
    out["jump_flag"] = F.when(sd.isNotNull() & F.col("return_1d").isNotNull(), F.abs("return_1d") > jump_multiple * sd)
    return b.withColumns(out).drop("__gk")
