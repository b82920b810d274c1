"""Functions for SQL text: implied_vol, black76_price, parse_instrument, svi_w and svi_g."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ivlattice.functions import black76


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` and returns their names.

    Pricing runs in Arrow batches; instrument parsing and SVI are SQL functions that
    the optimizer inlines.
    """

    @F.pandas_udf("double")
    def black76_price(f: pd.Series, k: pd.Series, t: pd.Series, v: pd.Series, cp: pd.Series) -> pd.Series:
        return pd.Series(black76.np_price(f, k, t, v, cp))

    spark.udf.register("black76_price", black76_price)
    spark.udf.register("implied_vol", black76.implied_vol_udf())
    args = "k double, a double, b double, rho double, m double, sigma double"
    w = "a + b * (rho * (k - m) + sqrt((k - m) * (k - m) + sigma * sigma))"
    r = "sqrt((k - m) * (k - m) + sigma * sigma)"
    d1, d2 = f"(b * (rho + (k - m) / {r}))", f"(b * sigma * sigma / pow({r}, 3))"
    g = f"pow(1 - k * {d1} / (2 * greatest({w}, 1e-12)), 2) - {d1} * {d1} / 4 * (1 / greatest({w}, 1e-12) + 0.25) + {d2} / 2"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION svi_w({args}) RETURNS double RETURN {w}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION svi_g({args}) RETURNS double RETURN {g}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_instrument(name string) RETURNS struct<currency: string, expiry: string, strike: string, cp: string> "
        "RETURN named_struct('currency', split_part(name, '-', 1), 'expiry', nullif(split_part(name, '-', 2), ''), 'strike', nullif(split_part(name, '-', 3), ''), 'cp', nullif(split_part(name, '-', 4), ''))"
    )
    return ["black76_price", "implied_vol", "svi_w", "svi_g", "parse_instrument"]
