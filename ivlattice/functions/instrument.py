"""Instrument names as columns: CCY-DMMMYY-STRIKE-C|P, CCY-DMMMYY, CCY-PERPETUAL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ivlattice.functions.numeric import col

# Month names of the exchange's dates; the expiry hour.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
EXPIRY_HOUR = 8

_NAME = r"^[A-Z0-9_]+-(?:PERPETUAL|[0-9]{1,2}[A-Z]{3}[0-9]{2}(?:-[0-9]+(?:[d.][0-9]+)?-[CPcp])?)$"


def _expiry(date: Column) -> Column:
    """08:00 UTC of DMMMYY or DDMMMYY; null if there is no such day."""
    n = F.length(date)
    # months stand at places 1, 4, 7 and so on; any other place is no month, nor is 0
    place = F.instr(F.lit("".join(MONTHS)), F.substring(date, n - 4, F.lit(3))) + 2
    month = F.when(place % 3 == 0, place / 3)
    day = F.try_make_timestamp_ntz(
        F.lit(2000) + F.right(date, F.lit(2)).try_cast("int"), month.cast("int"), F.substring(date, F.lit(1), n - 5).try_cast("int"), F.lit(EXPIRY_HOUR), F.lit(0), F.lit(0)
    )
    # epoch microseconds do not depend on the session's zone
    return F.timestamp_micros(F.unix_date(day.cast("date")).cast("long") * 86_400_000_000 + EXPIRY_HOUR * 3_600_000_000)


def _fields(p: Column) -> Column:
    """The struct of a name's parts between dashes."""
    part = lambda i: F.get(p, F.lit(i))
    option, perpetual = F.size(p) == 4, part(1) == "PERPETUAL"
    return F.struct(
        part(0).alias("currency"),
        F.when(option, "option").when(perpetual, "perpetual").otherwise("future").alias("kind"),
        F.when(~perpetual, _expiry(part(1))).alias("expiry"),
        F.when(option, F.translate(part(2), "d", ".").try_cast("double")).alias("strike"),
        F.when(option, F.upper(part(3))).alias("cp"),
    )


def parse(name: str | Column) -> Column:
    """struct<currency, kind, expiry, strike, cp>; null when the name is not understood.

    One pattern tells whether it is; the parts are cut out once, bound as a lambda's
    argument, so no field repeats the work of another.
    """
    c = col(name)
    whole = F.transform(F.when(c.rlike(_NAME), F.array(F.split(c, "-"))), _fields)
    return F.get(F.filter(whole, lambda s: (s["kind"] == "perpetual") | s["expiry"].isNotNull()), F.lit(0))


def parse_or_raise(name: str | Column) -> Column:
    """As ``parse``; a name that is not understood fails the query."""
    c = col(name)
    return F.coalesce(parse(c), F.raise_error(F.concat(F.lit("unknown instrument name: "), F.coalesce(c, F.lit("null")))))
