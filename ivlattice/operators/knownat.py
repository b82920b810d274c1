"""Attributes as they were known at each event's time.

Events and attribute changes of one entity are cut into time buckets and
co-grouped: hashed together and sorted by time, so that Python walks along them in
frames of bounded size (see sortedruns). Inside a frame, changes are sorted by the
time they became known, a running maximum gives the best version known so far, and
one binary search per event finds it. A bucket that is longer than a frame goes on
in the next one with its best version so far as one more row. What was known before
a bucket began enters it in the same way, from a running maximum over bucket
summaries, so no bucket needs another bucket's rows.

Defined results: an event with a null time, entity or attribute table gets no
row; nor does an event before anything was known. Versions that tie in valid time
are decided by the larger sequence number. Changes with a null known or valid
time are never known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.operators.sortedruns import GROUP_ROWS, KEY, cut_frames, placed
from ivlattice.session import floor_div

DAY_US = 86_400_000_000


def _search(events: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"event_id": pd.Series(dtype="int64"), "entity": pd.Series(dtype=object), "known_seq": pd.Series(dtype="int64")})
    if events.empty or changes.empty:
        return empty
    key = pd.concat([events["entity"] + "\x00" + events["bucket"].astype(str), changes["entity"] + "\x00" + changes["bucket"].astype(str)])
    code, _ = pd.factorize(key)
    ce, cc = code[: len(events)], code[len(events) :]
    # rank of each version: valid time, then sequence; made dense so a running maximum works on one integer
    version = np.lexsort((changes["seq"].to_numpy(), changes["valid"].to_numpy()))
    rank = np.empty(len(changes), dtype=np.int64)
    rank[version] = np.arange(len(changes))
    order = np.lexsort((rank, changes["known"].to_numpy(), cc))
    c, known, rank = cc[order], changes["known"].to_numpy()[order], rank[order]
    # running maximum within a group: groups get disjoint, growing offsets
    best = np.maximum.accumulate(rank + c.astype(np.int64) * (len(changes) + 1)) - c.astype(np.int64) * (len(changes) + 1)
    times = np.concatenate([known, events["at"].to_numpy()])
    dense = np.unique(times, return_inverse=True)[1].astype(np.int64)
    span = dense.max() + 1
    at = np.searchsorted(c * span + dense[: len(known)], ce * span + dense[len(known) :], side="right") - 1
    ok = (at >= 0) & (c[np.maximum(at, 0)] == ce)
    seq = changes["seq"].to_numpy()[version][best[at[ok]]]
    return pd.DataFrame({"event_id": events["event_id"].to_numpy()[ok], "entity": events["entity"].to_numpy()[ok], "known_seq": seq})


def _best(changes: pd.DataFrame) -> pd.DataFrame:
    """The best version of each entity and bucket."""
    return changes.sort_values(["valid", "seq"]).drop_duplicates(["entity", "bucket"], keep="last")


def known_at(events: DataFrame, changes: DataFrame, bucket_us: int = DAY_US, most: int = GROUP_ROWS) -> DataFrame:
    """For each event the sequence number of the version known at its time.

    ``events``: event_id long, entity string, at long (microseconds).
    ``changes``: entity string, known long, valid long, seq long.
    Returns event_id, entity, known_seq; events without a known version are absent.
    A frame in Python has at most ``most`` rows, whatever the sizes of the entities.
    """
    ev = events.select("event_id", "entity", "at").dropna()
    ch = changes.select("entity", "known", "valid", "seq").dropna()
    ev = ev.withColumn("bucket", floor_div(F.col("at"), bucket_us))
    ch = ch.withColumn("bucket", floor_div(F.col("known"), bucket_us))
    # what each bucket adds, and the buckets that events need; both are small
    best = ch.groupBy("entity", "bucket").agg(F.max(F.struct("valid", "seq")).alias("top"))
    need = ev.select("entity", "bucket").distinct().withColumn("top", F.lit(None).cast("struct<valid:bigint,seq:bigint>"))
    summary = best.unionByName(need).groupBy("entity", "bucket").agg(F.max("top").alias("top"))
    before = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.withColumn("top", F.max("top").over(before))
        .filter(F.col("top").isNotNull())
        .select("entity", (F.col("bucket") * bucket_us - 1).alias("known"), F.col("top.valid").alias("valid"), F.col("top.seq").alias("seq"), "bucket")
    )
    none = F.lit(0).cast("long")
    left = ev.select("entity", "bucket", "at", F.lit(True).alias("event"), none.alias("valid"), F.col("event_id").alias("seq"))
    right = ch.unionByName(carry).select("entity", "bucket", F.col("known").alias("at"), F.lit(False).alias("event"), "valid", "seq")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame, goes_on in cut_frames(batches, most):
            is_event = frame["event"].to_numpy(bool)
            e = frame[is_event].rename(columns={"seq": "event_id"})
            c = frame[~is_event].rename(columns={"at": "known"})
            c = c if kept is None else pd.concat([kept, c], ignore_index=True)
            yield _search(e, c)
            kept = _best(c[c[KEY] == frame[KEY].iloc[-1]]).assign(known=frame["at"].iloc[-1]) if goes_on else None

    # a change counts for the events of its own instant, so it stands before them
    together = placed(left.unionByName(right), ["entity", "bucket"], ["at", "event"])
    return together.mapInPandas(search, "event_id long, entity string, known_seq long")
