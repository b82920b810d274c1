"""Exact medians and median absolute deviations of groups of any size.

An approximate quantile of bounded size brackets each group's middle; the values
inside the narrow bracket are counted by value, and the middle ranks are read off
the running counts: a window over two in five thousand of a group's values. Groups
meet their brackets by a spread join, so a hot one is in no single task. Even counts
interpolate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.functions.numeric import if_finite
from ivlattice.operators.relational import beside

ACCURACY = 10_000


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """One row per key with a finite value: the keys and ``name``.

    Null, NaN and infinite values do not count.
    """
    v = df.select(*keys, if_finite(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    slack = 2.0 / ACCURACY
    ends = v.groupBy(*keys).agg(
        F.percentile_approx("__v", [0.5 - slack, 0.5 + slack], ACCURACY).alias("__q"),
        F.count(F.lit(1)).alias("__n"),
    )
    ends = ends.select(*keys, "__n", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"))
    placed = beside(v, ends, keys)
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    counted = placed.groupBy(*keys, F.when(inside, F.col("__v")).alias("__v")).agg(
        F.count_if(F.col("__v") < F.col("__lo")).alias("__below"), F.count_if(inside).alias("__c"), F.first("__n").alias("__n")
    )
    w = Window.partitionBy(*keys)
    total = counted.withColumn("__under", F.sum("__below").over(w)).filter(F.col("__v").isNotNull())
    run = w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    total = total.withColumn("__upto", F.col("__under") + F.sum("__c").over(run))
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    pick = lambda rank: F.min(F.when(F.col("__upto") >= rank, F.col("__v")))
    return total.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias(name))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, ``median`` and ``mad`` (the median absolute deviation) of the finite values."""
    med = exact_median(df, keys, value)
    dev = beside(df.select(*keys, value), med, keys).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    return beside(med, exact_median(dev, keys, "__d", "mad"), keys)


def mad_outliers(df: DataFrame, keys: list[str], value: str, multiple: float, name: str = "is_outlier", bounded: bool = False) -> DataFrame:
    """``df`` with ``name``: finite and strictly more than ``multiple`` deviations from the median.

    A deviation of zero makes every differing value an outlier; a lone row never is one.
    Rows whose keys are null are kept with a false flag. With ``bounded`` the caller
    says that a group fits a task, such as one expiry of one snapshot: both medians are
    then windows over one shuffle.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        with_median = df.withColumn("__x", if_finite(value).cast("double")).withColumn("__gap", F.abs(F.col("__x") - F.median("__x").over(group)))
        far = (F.col("__gap") > F.lit(multiple) * F.median("__gap").over(group))
        for k in keys:
            far = far & F.col(k).isNotNull()
        return with_median.withColumn(name, F.coalesce(far, F.lit(False))).drop("__x", "__gap")
    stats = mad(df, keys, value).withColumnsRenamed({"median": "__med", "mad": "__mad"})
    joined = beside(df, stats.dropna(subset=keys) if keys else stats, keys, "left")
    far = F.abs(if_finite(value) - F.col("__med")) > F.lit(multiple) * F.col("__mad")
    return joined.withColumn(name, F.coalesce(far, F.lit(False))).drop("__med", "__mad")
