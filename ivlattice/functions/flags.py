"""Bitmask flags whose bits never move, and ordered flag lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of each quality flag.
TAU_TOO_SHORT = 1
DELTA_OUT_OF_BAND = 2
IV_OUT_OF_BAND = 4
IV_DIVERGENCE = 8
MAD_OUTLIER = 16
BELOW_MIN_SIZE = 32
BLOCK_TRADE = 64
STALE = 128
IV_UNSOLVABLE = 256

HARD_REJECT = TAU_TOO_SHORT | DELTA_OUT_OF_BAND | IV_OUT_OF_BAND | MAD_OUTLIER | BELOW_MIN_SIZE


def bit(condition: Column, value: int) -> Column:
    """The bit where the condition holds; a null condition sets nothing."""
    return F.when(condition, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))


def combine(*bits: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def rejected(mask: str | Column, hard: int = HARD_REJECT) -> Column:
    m = F.col(mask) if isinstance(mask, str) else mask
    return m.bitwiseAND(F.lit(hard).cast("long")) != 0


def flag_list(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
