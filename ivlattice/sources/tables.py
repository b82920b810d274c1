"""Reading and writing the tables: typed scans, quote-chain CSV, NDJSON snapshots, partitioned sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ivlattice.contracts import SPLIT_MANIFEST, Contract
from ivlattice.functions.numeric import finite
from ivlattice.operators.badrows import record_type
from ivlattice.session import remove


def scan(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A parquet table in its contract's shape; an absent table is an empty one.

    Partition columns of the path that the contract does not know are dropped, so
    filters on contract columns reach the files.
    """
    try:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], contract.schema)
    return known_columns(df, contract)


def known_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` in the contract's shape, without columns that a strict contract does not know."""
    known = {f.name for f in contract.schema}
    return contract.shaped(df.select(*[c for c in df.columns if c in known])) if contract.strict else contract.shaped(df)


def partition_days(spark: SparkSession, path: str, day: str = "snap_date") -> DataFrame:
    """The days (one column) that a table has folders for; other names are skipped. The driver lists names only."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [x.getPath().getName() for x in found if x.isDirectory()]
    texts = spark.createDataFrame([(n.removeprefix(f"{day}="),) for n in names if n.startswith(f"{day}=")], "name string")
    return texts.select(F.col("name").try_cast("date").alias(day)).filter(F.col(day).isNotNull())


def between(df: DataFrame, ts: str, start: str, end: str, partition: str | None = None) -> DataFrame:
    """Rows with ts in [start, end]; with ``partition`` (a yyyy-MM month column) whole months are pruned first."""
    out = df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return out.filter(F.col(partition).between(start[:7], end[:7])) if partition else out


def read_chain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quote-chain CSV files (plain or gz) with pinned types.

    gz files cannot be split, so what follows is spread by a shuffle-free
    repartition of their rows. Files that may hold broken lines are read as lines
    through badrows instead.
    """
    return spark.read.schema(record_type()).option("header", True).option("mode", "FAILFAST").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CSV files as line_id, file_name, line_no, raw_line for badrows.

    ``line_no`` is 1 for the first line of a file if it is the header, 2 for all
    others, also for a header that stands further down; ids are unique, not
    consecutive.
    """
    header = ",".join(f.name for f in record_type())
    t = spark.read.text(path).select("value", F.input_file_name().alias("file_name"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("line_id"))
    # one row per file: ids grow within a block, and the first block holds the first line
    first = t.filter("block = 0").groupBy("file_name").agg(F.min("line_id").alias("first_id"))
    bare = F.replace(F.rtrim(F.col("value")), F.lit('"'), F.lit(""))
    is_header = (F.col("line_id") == F.col("first_id")) & (bare == header)
    return t.join(first, "file_name", "left").select("line_id", "file_name", F.when(is_header, 1).otherwise(2).alias("line_no"), F.col("value").alias("raw_line"))


SNAPSHOT = T.StructType(
    [
        T.StructField("snap_ts", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("index_price", T.DoubleType()),
        T.StructField(
            "book_summary",
            T.ArrayType(T.StructType([T.StructField("instrument_name", T.StringType()), T.StructField("open_interest", T.DoubleType()), T.StructField("volume", T.DoubleType())])),
        ),
    ]
)


def collected_interest(snapshots: DataFrame) -> DataFrame:
    """Open interest of NDJSON snapshots: currency, instrument, source_ts, open_interest.

    Lines that are no JSON, items without a name and values that are no number of
    zero or more are skipped.
    """
    rows = snapshots.select("currency", F.col("snap_ts").try_cast("timestamp").alias("source_ts"), F.explode("book_summary").alias("b"))
    good = F.col("source_ts").isNotNull() & F.col("b.instrument_name").isNotNull() & finite("b.open_interest") & (F.col("b.open_interest") >= 0)
    return rows.filter(good).select("currency", F.col("b.instrument_name").alias("instrument"), "source_ts", F.col("b.open_interest").alias("open_interest"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).option("mode", "PERMISSIVE").json(path)


def most_liquid(summary: DataFrame, n: int) -> DataFrame:
    """The n instruments with the largest volume (null as zero), ties by name."""
    return summary.orderBy(F.coalesce("volume", F.lit(0.0)).desc(), "instrument").limit(n)


def write_days(df: DataFrame, path: str, day: str = "snap_date", sort: list[str] | None = None) -> None:
    """Zstd parquet, one directory per day; only the days present are replaced.

    Rows are spread by day and a salt first, so a large day is written by several
    tasks and no task opens many days' files.
    """
    out = df.repartition(F.col(day), F.pmod(F.xxhash64(*df.columns), F.lit(4)))
    out = out.sortWithinPartitions(day, *(sort or []))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(day).parquet(path)


def replace_days(df: DataFrame, path: str, days: DataFrame, day: str = "snap_date") -> None:
    """Writes ``df`` in place of the given days: one that has no rows any more loses its folder.

    Days outside ``days`` stay untouched; the driver handles day names only.
    """
    write_days(df, path, day)
    empty = days.select(day).distinct().join(df.select(day).distinct(), day, "left_anti")
    for row in empty.toLocalIterator():
        remove(df.sparkSession, f"{path}/{day}={row[0]}")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Adds snapshots as JSON lines, in the folder of their UTC day."""
    day = F.substring("snap_ts", 1, 10).alias("day")
    snapshots.select("*", day).write.mode("append").partitionBy("day").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Replaces a split manifest by one that keeps its contract; a breach leaves the old one as it is."""
    SPLIT_MANIFEST.validate(rows).coalesce(1).write.mode("overwrite").parquet(path)


def to_fetch(candidates: DataFrame, done: DataFrame, unit: str) -> DataFrame:
    """Units of work that are not done, and the last that is, as it may have been cut short."""
    again = done.agg(F.max(unit).alias(unit)).join(candidates, unit, "left_semi")
    return unseen(candidates, done, [unit]).select(unit).unionByName(again).distinct()


def unseen(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that a manifest table does not list yet."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")
