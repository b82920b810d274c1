"""Market state at each day's snapshot: volatility index, funding, volumes, basis, open interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions.calendar import feature_day, snap_ts
from ivlattice.functions.instrument import parse
from ivlattice.functions.numeric import finite
from ivlattice.operators.asof import at_snapshots
from ivlattice.session import clean_name

SECOND_US = 1_000_000
DAY_S = 86_400
YEAR_S = 31_536_000.0


def with_lineage(days: DataFrame, source: str, ts: str, value: Column | None = None) -> DataFrame:
    """Adds {source}_source_ts, _age_s and _available from the matched time."""
    seen = F.col(ts).isNotNull()
    return days.withColumns(
        {
            f"{source}_source_ts": F.col(ts),
            f"{source}_age_s": F.when(seen, (F.unix_micros(snap_ts("snap_date")) - F.unix_micros(ts)) / F.lit(1e6)),
            f"{source}_available": seen if value is None else seen & value.isNotNull(),
        }
    ).drop(ts)


def dvol_level(days: DataFrame, dvol: DataFrame, resolution_s: int = 3_600, max_age_s: int = 7_200, back_days: int = 5) -> DataFrame:
    """days (snap_date, currency) with dvol, dvol_change_{n}d and its lineage.

    A candle is usable once it is complete. The earlier value must itself be fresh
    at its own target instant.
    """
    good = dvol.filter(finite("close")).withColumn("usable", F.col("ts") + F.expr(f"interval {resolution_s} seconds"))
    good = good.select("currency", "usable", (F.col("close") / 100).alias("level"), F.col("usable").alias("dvol_ts"), "ingest_seq")
    # the days asked for and those they look back to, in one pass
    then = days.select("currency", F.date_sub("snap_date", back_days).alias("snap_date"), F.lit(False).alias("__asked"))
    spine = days.select("currency", "snap_date", F.lit(True).alias("__asked")).unionByName(then).groupBy("currency", "snap_date").agg(F.bool_or("__asked").alias("__asked"))
    d = at_snapshots(spine, good, ["currency"], "usable", ["level", "dvol_ts"], ["ingest_seq"], max_age_us=max_age_s * SECOND_US)
    earlier = F.first("level").over(Window.partitionBy("currency").orderBy(F.unix_date("snap_date")).rangeBetween(-back_days, -back_days))
    d = d.withColumn(f"dvol_change_{back_days}d", F.col("level") - earlier).filter("__asked").drop("__asked").withColumnRenamed("level", "dvol")
    if set(days.columns) != {"currency", "snap_date"}:
        d = days.join(d, ["snap_date", "currency"], "left")
    return with_lineage(d, "dvol", "dvol_ts")


def funding_level(days: DataFrame, funding: DataFrame, max_age_s: int = 43_200) -> DataFrame:
    """days (snap_date, currency) with funding_8h: the last finite rate at or before the snapshot."""
    good = funding.filter(finite("interest_8h")).select(
        F.split_part("instrument", F.lit("-"), F.lit(1)).alias("currency"), F.col("ts").alias("__ts"), F.col("interest_8h").alias("funding_8h"), F.col("ts").alias("funding_ts"), "ingest_seq"
    )
    d = at_snapshots(days, good, ["currency"], "__ts", ["funding_8h", "funding_ts"], ["ingest_seq"], max_age_us=max_age_s * SECOND_US)
    return with_lineage(d, "funding", "funding_ts")


def option_volumes(trades: DataFrame) -> DataFrame:
    """snap_date, currency, options_volume, put_call_ratio over the day (snapshot - 1 d, snapshot].

    The ratio is null without calls.
    """
    name = clean_name("instrument")
    cp = F.regexp_extract(name, "-([CP])$", 1)
    amount = F.coalesce("amount", F.lit(0.0))
    t = trades.filter(F.col("ts").isNotNull()).select(feature_day("ts").alias("snap_date"), F.split_part(name, F.lit("-"), F.lit(1)).alias("currency"), cp.alias("cp"), amount.alias("amount"))
    g = t.groupBy("snap_date", "currency").agg(
        F.sum(F.when(F.col("cp") == "C", F.col("amount")).otherwise(0.0)).alias("calls"), F.sum(F.when(F.col("cp") == "P", F.col("amount")).otherwise(0.0)).alias("puts")
    )
    ratio = F.when(F.col("calls") != 0, F.col("puts") / F.col("calls"))
    return g.select("snap_date", "currency", (F.col("calls") + F.col("puts")).alias("options_volume"), ratio.alias("put_call_ratio"))


def futures_basis(days: DataFrame, futures: DataFrame, target_days: float = 30.0, least_days: float = 7.0, max_age_s: int = DAY_S) -> DataFrame:
    """days (snap_date, currency) with the annualised basis of the future nearest the target term.

    Of each instrument the latest trade at or before the snapshot counts, if it is
    young enough; ties in distance go to the smaller name. Unknown names are skipped.
    """
    f = futures.withColumn("i", parse("instrument")).filter((F.col("i.kind") == "future") & (F.col("price") > 0) & (F.col("index_price") > 0))
    f = f.select(F.col("i.currency").alias("currency"), F.col("i.expiry").alias("expiry"), "instrument", "ts", "price", "index_price", "ingest_seq")
    age = DAY_S if max_age_s is None else max_age_s
    # each trade is within reach of the snapshots of its own feature day and, for longer ages, the following ones
    reach = -(-age // DAY_S)
    near = f.withColumn("snap_date", F.explode(F.sequence(feature_day("ts"), F.date_add(feature_day("ts"), reach))))
    near = near.filter(F.unix_micros(snap_ts("snap_date")) - F.unix_micros("ts") <= age * SECOND_US)
    last = near.groupBy("snap_date", "currency", "expiry", "instrument").agg(F.max_by(F.struct("price", "index_price", "ts"), F.struct("ts", "ingest_seq")).alias("l"))
    tau_s = (F.unix_micros("expiry") - F.unix_micros(snap_ts("snap_date"))) / F.lit(1e6)
    c = last.withColumn("tau_s", tau_s).filter(F.col("tau_s") >= least_days * DAY_S)
    basis = (F.col("l.price") / F.col("l.index_price") - 1) / (F.col("tau_s") / YEAR_S)
    best = c.groupBy("snap_date", "currency").agg(
        F.min_by(F.struct(basis.alias("basis"), F.col("l.ts").alias("ts")), F.struct(F.abs(F.col("tau_s") / DAY_S - target_days), "instrument")).alias("b")
    )
    out = days.join(best, ["snap_date", "currency"], "left").select(*days.columns, F.col("b.basis").alias("futures_basis"), F.col("b.ts").alias("basis_ts"))
    return with_lineage(out, "basis", "basis_ts")


def open_interest(days: DataFrame, collected: DataFrame, chain: DataFrame) -> DataFrame:
    """Open interest: latest per instrument, then summed; a collected snapshot beats the chain outright.

    ``collected`` and ``chain``: currency, instrument, source_ts, open_interest. The
    chain counts for its own calendar day only; an instrument whose latest value is
    null is left out, older values do not step in.
    """

    def total(df: DataFrame, name: str) -> DataFrame:
        d = df.filter(F.col("source_ts").isNotNull()).withColumn("snap_date", F.to_date("source_ts")).filter(F.col("source_ts") <= snap_ts("snap_date"))
        last = d.groupBy("snap_date", "currency", "instrument").agg(F.max_by("open_interest", "source_ts").alias("oi"), F.max("source_ts").alias("ts"))
        return last.filter(finite("oi")).groupBy("snap_date", "currency").agg(F.sum("oi").alias(name), F.max("ts").alias(f"{name}_ts"))

    j = days.join(total(collected, "a"), ["snap_date", "currency"], "left").join(total(chain, "b"), ["snap_date", "currency"], "left")
    out = j.select(*days.columns, F.coalesce("a", "b").alias("aggregate_oi"), F.when(F.col("a").isNotNull(), F.col("a_ts")).otherwise(F.col("b_ts")).alias("oi_ts"))
    return with_lineage(out, "oi", "oi_ts")
