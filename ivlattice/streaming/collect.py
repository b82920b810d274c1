"""Live counterparts: deduplicated trades, windowed sums and open interest from snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ivlattice.sources.tables import SNAPSHOT, collected_interest, write_days


def stream_snapshots(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """NDJSON snapshots of a folder as they arrive."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", per_batch).json(path)


def stream_interest(spark: SparkSession, path: str) -> DataFrame:
    return collected_interest(stream_snapshots(spark, path))


def once_within(events: DataFrame, ts: str, keys: list[str], delay: str = "6 hours") -> DataFrame:
    """Events delivered at least once, kept once as long as copies arrive within ``delay``."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def day_totals(events: DataFrame, ts: str, keys: list[str], value: str, delay: str = "6 hours") -> DataFrame:
    """Sums per snapshot day, right-closed at 08:05 UTC (shifted by a microsecond, as windows are left-closed)."""
    shifted = events.withColumn("__t", F.col(ts) - F.expr("interval 1 microsecond")).withWatermark("__t", delay)
    w = F.window("__t", "1 day", "1 day", "8 hours 5 minutes")
    g = shifted.groupBy(w, *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select(F.to_date("window.end").alias("snap_date"), *keys, "total", "n")


def write_stream_days(rows: DataFrame, path: str, checkpoint: str, day: str = "snap_date") -> StreamingQuery:
    """Appends a stream to a table in folders batch_id=N/day.

    Each batch owns its folder: a batch that is replayed after a failure overwrites
    just that, and a later batch with rows of the same day adds to them.
    """
    return written_batches(rows, path, checkpoint, "append", [day])


def written_batches(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", by: list[str] | None = None) -> StreamingQuery:
    """Everything there is of a stream, a folder for each batch (one for all in complete mode), then it stops."""

    def write(batch: DataFrame, n: int) -> None:
        write_batch(batch, path, 0 if mode == "complete" else n, by)

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, path: str, n: int, by: list[str] | None = None) -> None:
    out = batch.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(f"{path}/batch_id={n}")


def compact_days(spark: SparkSession, path: str, to: str, day: str = "snap_date") -> None:
    """The batches of a streamed table as one folder per day; the days it has are replaced whole."""
    write_days(spark.read.parquet(path).drop("batch_id"), to, day)
