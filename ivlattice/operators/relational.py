"""Selecting, deduplicating and merging rows with total, stated orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the largest order of each key, as one aggregation with map-side combination.

    Nulls order lowest and NaN highest. Rows equal in the whole order: any of them.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, "__row.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*[_c(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, "__row.*").select(*df.columns)


#: Places that the rows of one key are dealt to when they meet a table with one row per key.
WAYS = 8


def beside(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``per_key``, which has one row per key.

    Nulls in keys are equal. One key may hold a third of ``df``: its rows are dealt to
    WAYS places, and the few rows of ``per_key`` copied to each; a ``per_key`` that
    turns out small is broadcast by the planner all the same. Without keys it is one row.
    """
    if not keys:
        return df.crossJoin(per_key)
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    few = per_key.withColumnsRenamed(names).withColumn("__way2", F.explode(F.array(*[F.lit(i) for i in range(WAYS)])))
    many = df.withColumn("__way", F.pmod(F.xxhash64(*df.columns), F.lit(WAYS)).cast("int"))
    same = F.col("__way") == F.col("__way2")
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    return many.join(few, same, how).drop("__way", "__way2", *names.values())


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top k; each task keeps k rows before the last merge."""
    return df.orderBy(*order).limit(k)


def merge_rerun(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys were not produced again, and all new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def date_spine(df: DataFrame, day: str, keys: list[str] | None = None) -> DataFrame:
    """Every calendar day from the first to the last of each key."""
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).filter(F.col("__a").isNotNull())
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(day))


def month_spine(start: str | Column | date, end: str | Column | date) -> Column:
    a, b = (F.lit(x) if isinstance(x, date) else _c(x) for x in (start, end))
    return F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))


def day_gaps(df: DataFrame, day: str, keys: list[str] | None = None) -> DataFrame:
    """Calendar days without a row between the first and the last."""
    keys = keys or []
    return date_spine(df, day, keys).join(df.select(*keys, day).distinct(), [*keys, day], "left_anti")


def prior_day_value(day: str, value: str, keys: list[str], back: int = 1) -> Column:
    """The value exactly ``back`` calendar days earlier, null if that day is missing."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-back, -back)
    return F.first(value).over(w)
