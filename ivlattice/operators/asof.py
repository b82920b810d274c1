"""Backward as-of joins that stay distributed when one key holds a third of the rows.

Both sides are cut into time buckets per key. Within a bucket, one sort gives each
left row the last right row before it; what earlier buckets contribute arrives as
one carried row per bucket, from a running maximum over bucket summaries. There is
no broadcast and no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions.calendar import feature_day, snap_ts
from ivlattice.session import floor_div, micros

DAY_US = 86_400_000_000


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    tie: list[str] | None = None,
    max_age_us: int | None = None,
    strict: bool = False,
    bucket_us: int = DAY_US,
) -> DataFrame:
    """``left`` with the ``values`` of the latest right row at or before it (before it if ``strict``).

    Rows of one right time are ordered by ``tie`` (largest wins). A match older than
    ``max_age_us`` counts as none: values are null. Left rows are all kept, null
    keys and times included; right rows with null times never match.
    """
    tie = tie or []
    payload = F.struct(micros(right_ts).alias("t"), F.struct(*[F.col(x).alias(f"o{i}") for i, x in enumerate(tie)], *[F.col(x).alias(f"v{i}") for i, x in enumerate(values)]).alias("v"))
    r = right.filter(F.col(right_ts).isNotNull()).select(*keys, micros(right_ts).alias("__t"), payload.alias("__p"))
    r = r.withColumn("__b", floor_div(F.col("__t"), bucket_us))
    l = left.withColumn("__t", micros(left_ts)).withColumn("__b", floor_div(F.col("__t"), bucket_us))  # noqa: E741
    row = F.struct(*[left[f"`{c}`"] for c in left.columns])
    rows = l.select(*keys, "__t", "__b", row.alias("__l"), F.lit(None).cast(r.schema["__p"].dataType).alias("__p"))
    both = rows.unionByName(r.withColumn("__l", F.lit(None).cast(rows.schema["__l"].dataType)))
    # right rows come first at equal times, last if the join is strict
    side = F.when(F.col("__p").isNotNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    order = Window.partitionBy(*keys, "__b").orderBy("__t", side, F.col("__p.v"))
    near = F.last("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__near", near).filter(F.col("__l").isNotNull())
    best = r.groupBy(*keys, "__b").agg(F.max("__p").alias("__top"))
    need = l.select(*keys, "__b").filter(F.col("__b").isNotNull()).distinct().withColumn("__top", F.lit(None).cast(r.schema["__p"].dataType))
    summary = best.unionByName(need).groupBy(*keys, "__b").agg(F.max("__top").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("__carry", F.max("__top").over(before)).filter(F.col("__carry").isNotNull()).select(*keys, "__b", "__carry")
    out = found.join(carry, [*keys, "__b"], "left").withColumn("__m", F.coalesce("__near", "__carry"))
    if max_age_us is not None:
        out = out.withColumn("__m", F.when(F.col("__t") - F.col("__m.t") <= max_age_us, F.col("__m")))
    return out.select("__l.*", *[F.col("__m.v")[f"v{i}"].alias(v) for i, v in enumerate(values)])


def at_snapshots(cells: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tie: list[str], day: str = "snap_date", max_age_us: int | None = None) -> DataFrame:
    """``cells`` with the ``values`` of the latest right row at or before their day's snapshot.

    As ``asof_backward`` where all left times are daily snapshots: right rows are first
    reduced to one per key and day, combined map-side, and the window runs over those
    days alone. Ages and ties as there; cells are all kept, right rows with null times
    never match.
    """
    payload = F.struct(micros(ts).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    daily = right.filter(F.col(ts).isNotNull()).groupBy(*keys, feature_day(ts).alias(day)).agg(F.max_by(payload, F.struct(ts, *tie)).alias("__p"))
    row = F.struct(*[cells[f"`{c}`"] for c in cells.columns])
    left = cells.select(*keys, day, row.alias("__l"), F.lit(None).cast(daily.schema["__p"].dataType).alias("__p"))
    both = left.unionByName(daily.withColumn("__l", F.lit(None).cast(left.schema["__l"].dataType)))
    # a day's right rows stand before its cells
    order = Window.partitionBy(*keys).orderBy(day, F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__m", F.last("__p", ignorenulls=True).over(order)).filter(F.col("__l").isNotNull())
    if max_age_us is not None:
        out = out.withColumn("__m", F.when(micros(snap_ts(day)) - F.col("__m.t") <= max_age_us, F.col("__m")))
    return out.select("__l.*", *[F.col("__m")[f"v{i}"].alias(v) for i, v in enumerate(values)])
