"""Messages delivered at least once: keep one copy of each.

Copies are grouped by their identifier and reduced with ``min_by`` over a struct
of delivery order and tie-break, so each map task sends at most one row per
identifier and a group that holds a third of the table costs no more than any
other.

Defined results: a row whose identifier is null in any part is nobody's copy and
is kept; an empty table gives an empty result; rows equal in every order column
are told apart by the row's own id, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keyed(df: DataFrame, keys: list[Column], order: list[str], row_id: str) -> DataFrame:
    ks = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    rank = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate([*order, row_id])]).alias("__rank")
    return df.select(*ks, rank, F.col(row_id).alias("__id"))


def _all_set(n: int) -> Column:
    cond = F.lit(True)
    for i in range(n):
        cond = cond & F.col(f"__k{i}").isNotNull()
    return cond


def keeper_ids(df: DataFrame, keys: list[Column], order: list[str], row_id: str) -> DataFrame:
    """The row id of the copy to keep, one row per identifier (column ``__id``)."""
    keyed = _keyed(df, keys, order, row_id).filter(_all_set(len(keys)))
    return (
        keyed.groupBy(*[f"__k{i}" for i in range(len(keys))])
        .agg(F.min_by("__id", "__rank").alias("__id"))
        .select("__id")
    )


def surplus_copies(df: DataFrame, keys: list[Column], order: list[str], row_id: str) -> DataFrame:
    """Ids (column ``row_id``) of all copies but the kept one.

    Only ids are shuffled for the anti join, and ids are unique, so no partition
    of it is hot.
    """
    keyed = _keyed(df, keys, order, row_id).filter(_all_set(len(keys)))
    ids = keyed.select(F.col("__id").alias(row_id))
    keep = keeper_ids(df, keys, order, row_id).select(F.col("__id").alias(row_id))
    return ids.join(keep, row_id, "left_anti")


def first_deliveries(df: DataFrame, keys: list[Column], order: list[str], row_id: str) -> DataFrame:
    """The table without surplus copies, columns unchanged.

    Whole rows travel once through the aggregation as a struct; rows without an
    identifier bypass it.
    """
    ks = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    rank = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate([*order, row_id])])
    packed = df.select(*ks, rank.alias("__rank"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"))
    kept = (
        packed.filter(_all_set(len(keys)))
        .groupBy(*names)
        .agg(F.min_by("__row", "__rank").alias("__row"))
        .select("__row.*")
    )
    return kept.unionByName(packed.filter(~_all_set(len(keys))).select("__row.*"))
