"""Cutting long series into bounded tiles of whole time cells.

A series may hold a third of all rows. Rows are counted per (series, cell) with
map-side combination; a running count over that small table gives each series the
cells where its tiles begin, about ``size`` rows apart. That is one short array
per series, about one entry per ``size`` rows of input in all, which rows look
themselves up in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.session import floor_div


def tile_starts(df: DataFrame, series: list[str], time_us: str, cell_us: int, size: int, halo: int) -> DataFrame:
    """Per series an array ``__tiles`` of struct<start, back, on>, ascending.

    ``start``: the tile's first cell; ``back``: from which cell on the rows before
    it are its halo; ``on``: up to which cell its own first rows are the halo of
    the tile before.
    """
    cells = df.select(*series, floor_div(F.col(time_us), cell_us).alias("__cell"))
    counts = cells.groupBy(*series, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*series).orderBy("__cell")
    counts = counts.withColumn("__end", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("__begin", F.col("__end") - F.col("__n"))
    counts = counts.withColumn("__tile", floor_div(F.col("__begin"), size))
    # by running count: the cell that holds the row ``halo`` rows earlier, and the one ``halo`` rows later
    near = Window.partitionBy(*series).orderBy("__begin")
    counts = counts.withColumns(
        {
            "__back": F.min("__cell").over(near.rangeBetween(-halo, -1)),
            "__on": F.max("__cell").over(near.rangeBetween(0, halo - 1)),
            "__new": F.coalesce(F.col("__tile") != F.lag("__tile").over(order), F.lit(True)),
            "__before": F.lag("__cell").over(order),
        }
    )
    starts = counts.filter("__new").select(
        *series,
        F.struct(
            F.col("__cell").alias("start"),
            F.least(F.coalesce("__back", "__before"), F.col("__before")).alias("back"),
            F.col("__on").alias("on"),
        ).alias("__t"),
    )
    return starts.groupBy(*series).agg(F.array_sort(F.collect_list("__t")).alias("__tiles"))


def tiles_of(cell: Column) -> Column:
    """The tiles a row in ``cell`` belongs to, as array<struct<t, core>>, given ``__tiles``."""
    own = F.size(F.filter("__tiles", lambda t: t["start"] <= cell))
    here = F.struct(own.alias("t"), F.lit(True).alias("core"))
    following = F.try_element_at("__tiles", own + 1)
    after = F.when(following["back"] <= cell, F.struct((own + 1).alias("t"), F.lit(False).alias("core")))
    before = F.when((own > 1) & (F.try_element_at("__tiles", own)["on"] >= cell), F.struct((own - 1).alias("t"), F.lit(False).alias("core")))
    return F.array_compact(F.array(here, before, after))


def tiled(df: DataFrame, series: list[str], time_us: str, cell_us: int, size: int, halo: int) -> DataFrame:
    """Rows of ``df`` with ``__tile`` and ``__core``.

    A row appears once with ``__core`` true in its own tile, and again with
    ``__core`` false in the next (previous) tile when it is among the ``halo``
    rows nearest to it; whole cells are copied, so the halo may be longer.
    Rows with a null time or series are dropped: they have no place in a series.
    """
    rows = df.dropna(subset=[*series, time_us])
    starts = tile_starts(rows, series, time_us, cell_us, size, halo)
    return (
        rows.join(starts, series)
        .withColumn("__to", F.explode(tiles_of(floor_div(F.col(time_us), cell_us))))
        .withColumns({"__tile": F.col("__to.t"), "__core": F.col("__to.core")})
        .drop("__to", "__tiles")
    )
