"""Totals and averages over trailing days, empty days included.

Readings are first summed per (entity, day) with map-side combination. Each
entity's days, first to last, are cut into tiles of ``tile`` days; a tile also
gets the ``longest - 1`` days before it as a halo. Entities of one tile are packed
into a dense (entities x days) block, and one product with a banded matrix of ones
gives every trailing sum of the block at once. With ``digits``, values are counted in
whole units of 10**-digits, so that sums are exact and the same in whatever order
they are made.

Defined results: null values are not readings; a day inside an entity's span
without any reading in its window has count 0 and a null average; an entity
without readings has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.operators.sortedruns import GROUP_ROWS, in_runs
from ivlattice.session import floor_div


def trailing_totals(readings: DataFrame, windows: tuple[int, ...] = (7, 30), tile: int = 64, digits: int | None = None, most: int = GROUP_ROWS) -> DataFrame:
    """``readings``: entity string, day long, value double.

    Returns entity, day and, per window w, sum{w} double, n{w} long, avg{w} double,
    for every day between an entity's first and last reading. ``digits``: decimal
    digits of a value that count (None: sums of doubles); a day's sum beyond
    9.2e18 / 10**digits then fails the query rather than overflow.
    """
    unit, kind = (1.0, np.float64) if digits is None else (10.0**digits, np.int64)
    counted = F.col("value") if digits is None else F.round(F.col("value") * unit).cast("long")
    halo = max(windows) - 1
    daily = (
        readings.dropna(subset=["entity", "day", "value"])
        .groupBy("entity", "day")
        .agg(F.sum(counted).alias("total"), F.count("value").alias("n"))
    )
    span = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    lo, hi = floor_div(F.col("first"), tile), floor_div(F.col("last"), tile)
    marks = span.select("entity", F.explode(F.sequence(lo, hi)).alias("tile"), "first", "last")
    own = floor_div(F.col("day"), tile)
    data = daily.withColumn("tile", F.explode(F.sequence(own, floor_div(F.col("day") + halo, tile)))).join(marks, ["entity", "tile"])
    rows = data.select("entity", "tile", "first", "last", "day", "total", "n").unionByName(
        marks.selectExpr("entity", "tile", "first", "last", "cast(null as long) day", f"{'0D' if digits is None else '0L'} total", "0L n")
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [one_tile(int(t), g) for t, g in pdf.groupby("tile", sort=False)]
        return pd.concat(parts)

    width = tile + halo
    bands = {w: np.array([[int(0 <= halo + j - i < w) for j in range(tile)] for i in range(width)]) for w in windows}

    def one_tile(t: int, g: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(g["entity"])
        total, count = np.zeros((len(names), width), kind), np.zeros((len(names), width), np.int64)
        first, last = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        first[code], last[code] = g["first"], g["last"]
        real = g["day"].notna().to_numpy()
        at = (g["day"].to_numpy()[real] - (t * tile - halo)).astype(np.int64)
        total[code[real], at] = g["total"].to_numpy()[real]
        count[code[real], at] = g["n"].to_numpy()[real]
        days = t * tile + np.arange(tile)
        e, d = np.nonzero((days >= first[:, None]) & (days <= last[:, None]))
        out = {"entity": np.asarray(names)[e], "day": days[d]}
        for w in windows:
            s, c = (total @ bands[w])[e, d] / unit, (count @ bands[w])[e, d]
            out |= {f"sum{w}": np.where(c > 0, s, 0.0), f"n{w}": c, f"avg{w}": np.where(c > 0, s / np.maximum(c, 1), np.nan)}
        return pd.DataFrame(out)

    schema = "entity string, day long, " + ", ".join(f"sum{w} double, n{w} long, avg{w} double" for w in windows)
    done = in_runs(rows, ["tile", "entity"], block, schema, most)
    return done.withColumns({f"avg{w}": F.when(F.col(f"n{w}") > 0, F.col(f"avg{w}")) for w in windows})


def hourly_latest(df: DataFrame, entity: str, ts_hour: str, value: str, seq: str) -> DataFrame:
    """One value per (entity, hour): the non-null one with the largest sequence number."""
    return (
        df.dropna(subset=[entity, ts_hour, value])
        .groupBy(entity, ts_hour)
        .agg(F.max_by(value, seq).alias(value))
    )


__all__ = ["trailing_totals", "hourly_latest"]
