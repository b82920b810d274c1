"""Irregular readings on a regular grid, with missing slots marked or filled.

Slots are reduced to one reading each with map-side combination, cut into time
shards of ``width`` slots, and summarised per shard by first slot, last slot and
last value. A prefix scan over the summaries gives each shard of a source, empty
ones included, the value carried into it. Every shard is then filled on its own.

Defined results: readings with a null source, slot or (if ``need_value``) value
do not count; several readings of one slot reduce to the one with the largest
order; a source without readings has no slots; before the first reading there is
no slot to fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.session import floor_div


def _shards(readings: DataFrame, width: int, need_value: bool) -> tuple[DataFrame, DataFrame]:
    keep = ["source", "slot", *(["value"] if need_value else [])]
    slots = (
        readings.dropna(subset=keep)
        .groupBy("source", "slot")
        .agg(F.max_by("value", "order").alias("value"))
        .withColumn("shard", floor_div(F.col("slot"), width))
    )
    summary = slots.groupBy("source", "shard").agg(
        F.min("slot").alias("first"),
        F.max("slot").alias("last"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("slot"))).alias("last_value"),
    )
    return slots, summary


def _grid(summary: DataFrame, width: int) -> DataFrame:
    """(source, shard, lo, hi, carry) for every shard from a source's first to its last.

    Between two shards with readings lie only empty ones; each starts with the
    value carried over all summaries before it.
    """
    w = Window.partitionBy("source").orderBy("shard")
    s = summary.select(
        "source",
        "shard",
        "first",
        "last",
        F.lead("shard").over(w).alias("next"),
        F.lag("shard").over(w).alias("prev"),
        F.last("last_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_in"),
        F.last("last_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("carry_out"),
    )
    end = F.when(F.col("next").isNull(), F.col("shard")).otherwise(F.col("next") - 1)
    spread = s.withColumn("own", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.col("own"), end)))
    is_own = F.col("shard") == F.col("own")
    lo = F.when(is_own & F.col("prev").isNull(), F.col("first")).otherwise(F.col("shard") * width)
    hi = F.when(is_own & F.col("next").isNull(), F.col("last")).otherwise((F.col("shard") + 1) * width - 1)
    carry = F.when(is_own, F.col("carry_in")).otherwise(F.col("carry_out"))
    return spread.select("source", "shard", lo.alias("lo"), hi.alias("hi"), carry.alias("carry"))


def missing_slots(readings: DataFrame, width: int, need_value: bool = True) -> DataFrame:
    """(source, slot) of every slot between a source's first and last that has no reading.

    ``readings``: source string, slot long, value double, order long.
    Each shard takes the difference of its slots and those it has, at most
    ``width`` of either.
    """
    slots, summary = _shards(readings, width, need_value)
    have = slots.groupBy("source", "shard").agg(F.collect_set("slot").alias("have"))
    grid = _grid(summary, width).join(have, ["source", "shard"], "left")
    empty = F.coalesce("have", F.array().cast("array<bigint>"))
    return grid.select("source", F.explode(F.array_except(F.sequence("lo", "hi"), empty)).alias("slot"))


def regular_grid(readings: DataFrame, width: int, need_value: bool = True) -> DataFrame:
    """Every slot from a source's first to its last: source, slot, value, missing.

    ``value`` of a missing slot is the last value before it (null if there is none).
    """
    slots, summary = _shards(readings, width, need_value)
    grid = _grid(summary, width).withColumn("slot", F.explode(F.sequence("lo", "hi")))
    have = slots.withColumn("seen", F.lit(True)).drop("shard")
    rows = grid.join(have, ["source", "slot"], "left")
    w = Window.partitionBy("source", "shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "source",
        "slot",
        F.coalesce(F.last("value", ignorenulls=True).over(w), F.col("carry")).alias("value"),
        F.col("seen").isNull().alias("missing"),
    )
