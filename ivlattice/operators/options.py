"""From raw option trades and quotes to curated observations per daily snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ivlattice.functions import black76, flags
from ivlattice.functions.calendar import snap_ts
from ivlattice.functions.instrument import parse, parse_or_raise
from ivlattice.functions.numeric import bucket_index, finite, if_finite, nan_if_null, years_between
from ivlattice.operators.asof import at_snapshots
from ivlattice.operators.median import mad_outliers
from ivlattice.operators.relational import latest_by
from ivlattice.session import clean_name

MINUTE_US = 60_000_000

# Funding periods a year of the eight-hour and the one-hour rate.
EIGHT_HOURS_A_YEAR = 3 * 365.0
HOURS_A_YEAR = 24 * 365.0


def sign_of(cp: Column) -> Column:
    return F.when(cp == "C", 1).otherwise(-1).cast("long")


def canonical_trades(trades: DataFrame) -> DataFrame:
    """Raw option trades as observations: given columns win over those parsed from the name.

    A name that is not understood fails the query. Null sizes, prices and flags stay
    null (a null block flag is false).
    """
    name = clean_name("instrument")
    t = trades.withColumn("__i", parse_or_raise(name))
    cp = F.upper(F.coalesce("cp", F.col("__i.cp")))
    return t.select(
        "ingest_seq",
        name.alias("instrument"),
        F.coalesce("expiry", F.col("__i.expiry")).alias("expiry"),
        F.coalesce("strike", F.col("__i.strike")).alias("strike"),
        cp.alias("cp"),
        sign_of(cp).alias("cp_sign"),
        F.col("__i.currency").alias("currency"),
        "price_btc",
        "index_price",
        (F.col("price_btc") * F.col("index_price")).alias("usd_premium"),
        (F.col("iv") / 100).alias("iv_trade"),
        F.col("amount").alias("size"),
        F.coalesce("block_flag", F.lit(False)).alias("block_flag"),
        F.timestamp_millis(F.unix_millis("ts")).alias("source_ts"),
    )


def canonical_quotes(chain: DataFrame) -> DataFrame:
    """The quote chain in the same shape: mark volatility in fractions, cp from the symbol only."""
    name = clean_name("symbol")
    c = chain.withColumn("__i", parse(name))
    cp = F.col("__i.cp")
    return c.filter(F.col("__i").isNotNull()).select(
        F.col("quote_id").alias("ingest_seq"),
        name.alias("instrument"),
        F.timestamp_millis("expiration").alias("expiry"),
        F.col("strike_price").alias("strike"),
        cp.alias("cp"),
        sign_of(cp).alias("cp_sign"),
        F.col("__i.currency").alias("currency"),
        F.col("mark_price").alias("price_btc"),
        F.col("underlying_price").alias("index_price"),
        (F.col("mark_price") * F.col("underlying_price")).alias("usd_premium"),
        (F.col("mark_iv") / 100).alias("iv_trade"),
        F.coalesce("open_interest", F.lit(0.0)).alias("size"),
        F.lit(False).alias("block_flag"),
        F.timestamp_millis(F.floor(F.col("timestamp") / 1000)).alias("source_ts"),
    )


def latest_quotes(quotes: DataFrame, day: str = "snap_date") -> DataFrame:
    """The last quote at or before each day's snapshot per contract, ties by the larger volatility, then sequence."""
    known = quotes.withColumn(day, F.to_date(F.col("source_ts"))).filter(F.col("source_ts") <= snap_ts(day))
    return latest_by(known, [day, "currency", "expiry", "strike", "cp"], ["source_ts", "iv_trade", "ingest_seq"])


def parity_pairs(obs: DataFrame, cell: list[str], gap_s: float = 60.0) -> DataFrame:
    """Forwards by put-call parity: ``cell``, parity_forward, n_pairs.

    Per strike the nearest call and the nearest put to the snapshot are picked
    first, and the pair is dropped afterwards if their times differ by more than
    ``gap_s``: an older pair closer in time is not looked for. Pairs with a null
    premium count, the median skips them.
    """
    quote = F.struct("source_ts", "ingest_seq", "usd_premium")
    pairs = obs.groupBy(*cell, "strike").agg(F.max(F.when(F.col("cp") == "C", quote)).alias("c"), F.max(F.when(F.col("cp") == "P", quote)).alias("p"))
    gap = F.abs(F.unix_micros("c.source_ts") - F.unix_micros("p.source_ts"))
    near = pairs.filter(F.col("c").isNotNull() & F.col("p").isNotNull() & (gap <= gap_s * 1e6))
    return near.groupBy(*cell).agg(
        F.median(F.col("strike") + F.col("c.usd_premium") - F.col("p.usd_premium")).alias("parity_forward"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def forwards(obs: DataFrame, futures: DataFrame, funding: DataFrame, min_pairs: int = 1, gap_s: float = 60.0) -> DataFrame:
    """One forward per (snap_date, currency, expiry) by the first of three methods that gives one.

    Parity of enough pairs, else the last future of that expiry at or before the
    snapshot, else index x exp(carry x tau) with the carry of the last funding row.
    Returns forward, fwd_method and n_pairs (0 unless parity was used).
    """
    cell = ["snap_date", "currency", "expiry"]
    pcp = parity_pairs(obs, cell, gap_s)
    cells = obs.groupBy(*cell).agg(
        F.median("tau").alias("tau"),
        F.median(if_finite("index_price")).alias("index"),
    )
    f = futures.withColumn("__i", parse("instrument")).filter((F.col("price") > 0) & (F.col("__i.kind") == "future"))
    f = f.select(F.col("__i.currency").alias("currency"), F.col("__i.expiry").alias("expiry"), "ts", F.col("price").alias("future"), "ingest_seq")
    g = funding.select(F.split_part("instrument", F.lit("-"), F.lit(1)).alias("currency"), "ts", "interest_1h", "interest_8h", "ingest_seq")
    out = at_snapshots(cells, f, ["currency", "expiry"], "ts", ["future"], ["ingest_seq"])
    out = at_snapshots(out, g, ["currency"], "ts", ["interest_1h", "interest_8h"], ["ingest_seq"])
    out = out.join(pcp, cell, "left")
    carry = F.coalesce(if_finite("interest_8h") * EIGHT_HOURS_A_YEAR, if_finite("interest_1h") * HOURS_A_YEAR, F.lit(0.0))
    use_pcp = F.coalesce((F.col("n_pairs") >= min_pairs) & finite("parity_forward") & (F.col("parity_forward") > 0), F.lit(False))
    use_future = F.col("future").isNotNull()
    value = F.when(use_pcp, F.col("parity_forward")).when(use_future, F.col("future")).otherwise(F.col("index") * F.exp(carry * F.col("tau")))
    method = F.when(use_pcp, "pcp").when(use_future, "future").otherwise("index_carry")
    return out.select(*cell, value.alias("forward"), method.alias("fwd_method"), F.when(use_pcp, F.col("n_pairs")).otherwise(0).cast("long").alias("n_pairs"))


def cross_check(obs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Adds iv_recomputed, iv_obs, iv_source and quality_flags.

    A finite traded volatility always wins; otherwise the recomputed one is used.
    Only the solve itself runs in Arrow batches.
    """
    solve = black76.implied_vol_udf()
    o = obs.withColumn("iv_recomputed", solve(*[nan_if_null(c) for c in ("usd_premium", "forward", "strike", "tau", "cp_sign")]))
    recomputed = nan_if_null("iv_recomputed")
    traded = finite("iv_trade")
    apart = F.abs(F.col("iv_trade") - recomputed) > tolerance
    return o.withColumns(
        {
            "iv_recomputed": recomputed,
            "iv_obs": F.when(traded, F.col("iv_trade")).otherwise(recomputed),
            "iv_source": F.when(traded, "trade").otherwise("mark"),
            "quality_flags": flags.combine(flags.bit(F.isnan(recomputed), flags.IV_UNSOLVABLE), flags.bit(traded & finite(recomputed) & apart, flags.IV_DIVERGENCE)),
        }
    )


def cascade(
    obs: DataFrame,
    group: list[str],
    tau_min_days: float = 2.0,
    delta_band: tuple[float, float] = (0.02, 0.98),
    iv_band: tuple[float, float] = (0.01, 5.0),
    mad_multiple: float = 5.0,
    size_min: float = 0.1,
) -> DataFrame:
    """Adds delta, vega, w, quality_flags and rejected; keeps every row.

    A null delta, volatility or size sets no flag, NaN does. The deviation test runs
    over all finite w of the group, rejected rows included; a group is what one snapshot
    has of one expiry, and fits a task.
    """
    o = black76.priced(obs.drop("price", "delta", "gamma", "vega", "theta"), "forward", "strike", "tau", "iv_obs", "cp_sign")
    alive = (F.col("tau") > 0) & (F.col("iv_obs") > 0)
    o = o.withColumns(
        {
            "delta": F.coalesce(F.when(alive, F.col("delta")), F.lit(float("nan"))),
            "w": F.col("iv_obs") * F.col("iv_obs") * F.col("tau"),
        }
    ).drop("price", "gamma", "theta")
    o = mad_outliers(o, group, "w", mad_multiple, "__far", bounded=True)
    outside = lambda c, lo, hi: F.isnan(c) | (c < lo) | (c > hi)
    bits = [
        flags.bit(F.col("tau") < tau_min_days / 365.0, flags.TAU_TOO_SHORT),
        flags.bit(outside(F.abs("delta"), *delta_band), flags.DELTA_OUT_OF_BAND),
        flags.bit(outside(F.col("iv_obs"), *iv_band), flags.IV_OUT_OF_BAND),
        flags.bit(F.col("__far"), flags.MAD_OUTLIER),
        flags.bit(F.col("size") < size_min, flags.BELOW_MIN_SIZE),
        flags.bit(F.col("block_flag"), flags.BLOCK_TRADE),
    ]
    before = F.col("quality_flags") if "quality_flags" in obs.columns else F.lit(0).cast("long")
    o = o.withColumn("quality_flags", flags.combine(before, *bits))
    return o.withColumn("rejected", flags.rejected("quality_flags")).drop("__far")


def add_tau(obs: DataFrame) -> DataFrame:
    return obs.withColumn("tau", years_between("expiry", snap_ts("snap_date")))


def bucket_marks(obs: DataFrame, cell: list[str], k: str, iv: str, width: float = 0.1) -> DataFrame:
    """Mean and count per cell and moneyness bucket (whole-number bucket)."""
    return obs.withColumn("k_bucket", bucket_index(k, width)).groupBy(*cell, "k_bucket").agg(F.avg(iv).alias("iv"), F.count(F.lit(1)).alias("n"))


def compare_buckets(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Buckets in both, their difference, and whether it is within tolerance."""
    x = a.withColumnsRenamed({"iv": "iv_a", "n": "n_a"})
    y = b.withColumnsRenamed({"iv": "iv_b", "n": "n_b"})
    diff = F.abs(F.col("iv_a") - F.col("iv_b"))
    return x.join(y, keys).withColumns({"diff": diff, "within": diff <= tolerance})


def comparison_summary(buckets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per ``keys`` (over all without): buckets compared, passed (all within tolerance) and max_abs_diff."""
    return buckets.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_buckets"), F.coalesce(F.bool_and("within"), F.lit(True)).alias("passed"), F.coalesce(F.max("diff"), F.lit(0.0)).alias("max_abs_diff"))
