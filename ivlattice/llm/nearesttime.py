"""Pairing records of two tables by nearest time within a tolerance.

Records are hashed into groups by (entity, time bucket) and sorted by time; a
right-hand record near a bucket's edge is copied to the neighbour it can reach, so a
hot entity spreads over its buckets and every group is complete. Groups come to
Python as Arrow tables of bounded size (see sortedruns). Inside a table, DuckDB joins
backward and forward as of each left-hand time, and the nearer candidate within the
tolerance is taken: the earlier one on equal distance, the smaller id on equal times.
A bucket that is longer than a table goes on in the next one, together with what
lies within reach of the cut.

Defined results: a record with a null entity or time pairs with nothing; left-hand
records without a partner are absent from the result; repeated left-hand rows each
get their partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.operators.sortedruns import GROUP_ROWS, KEY, cut_frames, placed
from ivlattice.session import floor_div

#: For DuckDB in one task; a table of GROUP_ROWS rows takes a fraction of it. Nothing is spilled to the node's own disk.
DUCKDB = {"threads": 1, "memory_limit": "512MB", "temp_directory": ""}

NEAREST = """
WITH back AS (
  SELECT l.left_id, l.entity, l.bucket, l.tm, r.right_id AS b_id, r.tm AS b_tm
  FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.bucket = r.bucket AND l.tm >= r.tm),
both_ways AS (
  SELECT back.left_id, back.tm, b_id, b_tm, r.right_id AS f_id, r.tm AS f_tm
  FROM back ASOF LEFT JOIN r ON back.entity = r.entity AND back.bucket = r.bucket AND back.tm <= r.tm)
SELECT left_id, CASE WHEN f_tm IS NULL OR tm - b_tm <= f_tm - tm THEN b_id ELSE f_id END AS right_id
FROM both_ways WHERE least(coalesce(tm - b_tm, {far}), coalesce(f_tm - tm, {far})) <= {tolerance}
"""


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, bucket_us: int, most: int = GROUP_ROWS) -> DataFrame:
    """``left``: left_id long, entity string, at long (microseconds); ``right``: right_id likewise.

    Returns left_id, right_id. An Arrow table has at most ``most`` rows, and those of
    one entity within twice the tolerance of a cut.
    """
    lf = left.dropna(subset=["left_id", "entity", "at"]).withColumn("bucket", floor_div(F.col("at"), bucket_us))
    rt = right.dropna(subset=["right_id", "entity", "at"]).groupBy("entity", "at").agg(F.min("right_id").alias("right_id"))
    reach = F.sequence(floor_div(F.col("at") - tolerance_us, bucket_us), floor_div(F.col("at") + tolerance_us, bucket_us))
    rt = rt.withColumn("bucket", F.explode(reach))
    query = NEAREST.format(far=2 * tolerance_us + 1, tolerance=tolerance_us)
    out = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

    def pair(l: pa.Table, r: pa.Table) -> Iterator[pa.RecordBatch]:  # noqa: E741
        if l.num_rows and r.num_rows:
            import duckdb

            with duckdb.connect(config=DUCKDB) as con:
                con.register("l", l.rename_columns({"id": "left_id"}))
                con.register("r", r.rename_columns({"id": "right_id"}))
                yield from con.sql(query).to_arrow_table().select(["left_id", "right_id"]).cast(out).to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for frame, goes_on in cut_frames(batches, most):
            frame = frame if held is None else pa.concat_tables([held, frame])
            side = frame["is_left"]
            now = side
            if goes_on:
                # left-hand records within reach of the cut wait, with the right-hand ones that they can reach
                end = frame["tm"][-1].as_py()
                open_key = pc.equal(frame[KEY], frame[KEY][-1])
                late = pc.and_(open_key, pc.greater(frame["tm"], end - tolerance_us))
                near = pc.and_(open_key, pc.greater_equal(frame["tm"], end - 2 * tolerance_us))
                now = pc.and_not(side, late)
                held = frame.filter(pc.or_(pc.and_(side, late), pc.and_not(near, side)))
            else:
                held = None
            yield from pair(frame.filter(now), frame.filter(pc.invert(side)))

    a = lf.select("entity", "bucket", F.col("at").alias("tm"), F.lit(True).alias("is_left"), F.col("left_id").cast("long").alias("id"))
    b = rt.select("entity", "bucket", F.col("at").alias("tm"), F.lit(False).alias("is_left"), F.col("right_id").cast("long").alias("id"))
    return placed(a.unionByName(b), ["entity", "bucket"], ["tm"]).mapInArrow(walk, "left_id long, right_id long")
