"""Walk-forward folds, split manifests and look-back windows on calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folds(dates: DataFrame, day: str = "day", fit_months: int = 16, val_months: int = 2, test_months: int = 2, step_months: int = 2, tune_folds: int = 2) -> DataFrame:
    """Half-open train, validation and test ranges, as long as the test range fits the data."""
    ends = dates.agg(F.min(day).alias("start"), F.date_add(F.max(day), 1).alias("stop")).filter(F.col("start").isNotNull())
    most = F.greatest(F.floor(F.months_between("stop", "start") / step_months).cast("int"), F.lit(0))
    f = ends.select("start", "stop", F.explode(F.sequence(F.lit(0), most)).alias("fold_id"))
    at = lambda m: F.add_months("start", F.lit(fit_months + m) + F.col("fold_id") * step_months)
    f = f.select(
        F.col("fold_id").cast("long"),
        F.col("start").alias("train_start"),
        at(0).alias("train_end"),
        at(val_months).alias("validation_end"),
        at(val_months + test_months).alias("test_end"),
        (F.col("fold_id") < tune_folds).alias("tune_hyperparameters"),
        "stop",
    )
    return f.filter(F.col("test_end") <= F.col("stop")).drop("stop")


def manifest(dates: DataFrame, fold_table: DataFrame, day: str = "day") -> DataFrame:
    """(fold_id, date, split): the target date alone decides; dates outside a fold are absent.

    The fold table has one row per ``step_months`` of data and is broadcast by the
    planner when its measured size allows.
    """
    d = dates.select(day).distinct()
    j = d.join(fold_table, (F.col(day) >= F.col("train_start")) & (F.col(day) < F.col("test_end")))
    split = F.when(F.col(day) < F.col("train_end"), "train").when(F.col(day) < F.col("validation_end"), "validation").otherwise("test")
    return j.select("fold_id", day, split.alias("split"), "tune_hyperparameters")


def lookback(rows: DataFrame, keys: list[str], day: str, features: list[str], length: int = 20, horizon: int = 1) -> DataFrame:
    """One row per target day with the ``length`` days that end ``horizon`` days before it.

    Every calendar day of the span, the gap before the target included, must exist;
    otherwise the target is dropped. Adds ``inputs`` (array of structs, oldest first)
    and ``mask`` (array of booleans per day: all features are ordinary numbers).
    """
    number = F.unix_date(day)
    w = Window.partitionBy(*keys).orderBy(number)
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    item = F.struct(F.col(day), *[F.col(f) for f in features], ok.alias("complete"))
    seen = F.collect_list(item).over(w.rangeBetween(-(length + horizon - 1), -horizon))
    n = F.count(F.lit(1)).over(w.rangeBetween(-(length + horizon - 1), 0))
    out = rows.select(*keys, day, *features, F.array_sort(seen).alias("inputs"), n.alias("__n")).filter(F.col("__n") == length + horizon).drop("__n")
    return out.withColumn("mask", F.transform("inputs", lambda x: x["complete"]))


def scalar_features(schema: T.StructType, left_out: set[str]) -> list[str]:
    """Numeric and boolean columns in order, without those named and without times of sources."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in schema if isinstance(f.dataType, kinds) and f.name not in left_out and not f.name.endswith("_source_ts")]


def window_breaches(windows: DataFrame, day: str, length: int, horizon: int) -> DataFrame:
    """rule, n: how many look-back windows break each invariant, those that none breaks left out.

    ``windows`` as ``lookback`` gives them: as many inputs and mask entries as
    ``length``, on consecutive days, the last ``horizon`` days before the target.
    """
    at = lambda i: F.unix_date(F.get("inputs", i)[day])
    rules = {
        "input count": F.size("inputs") != length,
        "mask length": F.size("mask") != F.size("inputs"),
        "consecutive days": F.exists(F.sequence(F.lit(1), F.lit(max(1, length - 1))), lambda i: at(i) - at(i - 1) != 1) if length > 1 else F.lit(False),
        "last input": at(F.lit(length - 1)) != F.unix_date(day) - horizon,
    }
    one = windows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"c{i}").alias("n")) for i, r in enumerate(rules)]))).filter("n > 0")


def fold_breaches(fold_table: DataFrame) -> DataFrame:
    """rule, n: folds whose ranges don't follow each other, or don't grow from one fold to the next."""
    w = Window.orderBy("fold_id")
    f = fold_table.withColumns({"__end": F.lag("train_end").over(w), "__start": F.lag("train_start").over(w)})
    rules = {
        "order of ranges": ~((F.col("train_start") < F.col("train_end")) & (F.col("train_end") < F.col("validation_end")) & (F.col("validation_end") < F.col("test_end"))),
        "growing training": F.col("__end") >= F.col("train_end"),
        "one start": F.col("__start") != F.col("train_start"),
    }
    one = f.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"c{i}").alias("n")) for i, r in enumerate(rules)]))).filter("n > 0")


def fit_range_inside(fold_table: DataFrame, start: str, end: str) -> DataFrame:
    """fold_id, inside: whether components fitted on [start, end) saw nothing but the fold's training days."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return fold_table.select("fold_id", ((F.col("train_start") <= a) & (a < b) & (b <= F.col("train_end"))).alias("inside"))


def leaks(rows: DataFrame, snap: str, source_columns: list[str]) -> DataFrame:
    """Number of rows per source whose time lies after the snapshot."""
    return rows.agg(*[F.count_if(F.col(c) > F.col(snap)).alias(c) for c in source_columns])
