"""Session settings and the few helpers every plan shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "ivlattice") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set in the context.

    It is the session's spark.checkpoint.dir. Where that is unset, a local session
    (tests, a laptop) gets a fresh temporary one; a cluster is refused, as its nodes
    would each write to a folder of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder on whatever file system it lies; False if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, which survives lost executors.

    Spark deletes the files once nothing refers to them, if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared checkpoint folder, for several readers, and its path, to be removed after them."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores, if the scan has fewer splits than there are cores.

    Only small or badly split input is moved; a table of many files stays where it is
    read. Rows that a shuffle has dealt out already are left alone, and no job runs to
    find out.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_name(column: str | Column) -> Column:
    """Instrument names are equal after trimming blanks and upper-casing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(F.trim(c))


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone (the latter read as UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c)


def floor_div(c: Column, by: int) -> Column:
    """Exact integer floor division (no detour through doubles)."""
    return ((c - F.pmod(c, F.lit(by))) / F.lit(by)).cast("long")


def utc_day(column: str | Column) -> Column:
    """Days since the epoch in UTC, whatever the session's zone."""
    return floor_div(micros(column), 86_400_000_000)


def day_text(day: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_from_unix_date(day.cast("int")).cast("string")


def utc_hour(column: str | Column) -> Column:
    """Hours since the epoch in UTC."""
    return floor_div(micros(column), 3_600_000_000)


def hour_text(hour: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of an hour number since the epoch."""
    return F.concat(
        day_text(floor_div(hour, 24)),
        F.lit(" "),
        F.lpad(F.pmod(hour, F.lit(24)).cast("string"), 2, "0"),
        F.lit(":00:00"),
    )
