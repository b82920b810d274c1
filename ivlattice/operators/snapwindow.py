"""Snapshot windows that widen backward while any group is sparse, without a loop.

For each snapshot the window grows from ``base`` to ``most`` minutes in steps until
every group present has enough rows. A row belongs to the first step whose window
holds it, so counts per (snapshot, group, step) cumulated over the steps tell which
step is the first with no sparse group. Counting combines map-side; the step table
has a few rows per snapshot and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ivlattice.functions.calendar import snap_ts
from ivlattice.functions.numeric import decay_weight
from ivlattice.session import floor_div, micros

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def steps(base: int, step: int, most: int) -> int:
    """Number of window sizes tried."""
    return 1 if step <= 0 or most <= base else 1 + -(-(most - base) // step)


def first_step(age_us: Column, base: int, step: int, most: int) -> Column:
    """The first step (from 0) whose window (snapshot - width, snapshot] holds a row of that age."""
    inner = F.when(age_us < base * MINUTE_US, F.lit(0))
    if steps(base, step, most) == 1:
        return inner.cast("long")
    later = floor_div(age_us - base * MINUTE_US, step * MINUTE_US) + 1
    return inner.otherwise(F.least(later, F.lit(steps(base, step, most) - 1))).cast("long")


def snap_window(
    rows: DataFrame,
    ts: str,
    group: list[str],
    base: int = 60,
    step: int = 60,
    most: int = 360,
    least_rows: int = 4,
    half_life_s: float = 900.0,
) -> DataFrame:
    """Rows in their snapshot's window, with snap_date, window_minutes, staleness_s and weight.

    Snapshots are the daily instants; a row may fall into the windows of several
    only if ``most`` exceeds a day. The upper bound is inclusive, the lower strict.
    Rows with a null time are in no window.
    """
    top = base if steps(base, step, most) == 1 else most
    us = micros(ts)
    # days whose snapshot lies in [ts, ts + top)
    first = floor_div(us - (8 * 60 + 5) * MINUTE_US + DAY_US - 1, DAY_US)
    last = floor_div(us - (8 * 60 + 5) * MINUTE_US + top * MINUTE_US - 1, DAY_US)
    days = F.when(first <= last, F.sequence(first, last))
    placed = rows.filter(F.col(ts).isNotNull()).withColumn("__day", F.explode(days))
    placed = placed.withColumn("snap_date", F.date_from_unix_date(F.col("__day").cast("int"))).drop("__day")
    placed = placed.withColumn("__age", F.unix_micros(snap_ts("snap_date")) - us)
    placed = placed.withColumn("__step", first_step(F.col("__age"), base, step, most)).filter(F.col("__step").isNotNull())
    counts = placed.groupBy("snap_date", *group, "__step").agg(F.count(F.lit(1)).alias("__n"))
    n_steps = steps(base, step, most)
    grid = counts.groupBy("snap_date", *group).agg(*[F.sum(F.when(F.col("__step") <= s, F.col("__n"))).alias(f"__s{s}") for s in range(n_steps)])
    fewest = grid.groupBy("snap_date").agg(*[F.min(f"__s{s}").alias(f"__s{s}") for s in range(n_steps)])
    chosen = F.coalesce(*[F.when(F.col(f"__s{s}") >= least_rows, F.lit(s)) for s in range(n_steps)], F.lit(n_steps - 1))
    fewest = fewest.select("snap_date", chosen.alias("__chosen"))
    kept = placed.join(fewest, "snap_date").filter("__step <= __chosen")
    width = F.least(F.lit(base) + F.col("__chosen") * step, F.lit(top)) if n_steps > 1 else F.lit(base)
    stale = F.col("__age") / F.lit(1e6)
    return kept.select(
        *rows.columns,
        "snap_date",
        width.cast("long").alias("window_minutes"),
        stale.alias("staleness_s"),
        decay_weight(stale, half_life_s).alias("weight"),
    )


__all__ = ["snap_window", "first_step", "steps"]
