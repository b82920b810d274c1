"""Grouped Arrow work of bounded size, whatever the number of partitions.

Rows are hashed by key and sorted by it inside their partition, a sort that spills
to disk. Python then walks along each partition and gets frames of whole keys, each
as soon as it holds about ``GROUP_ROWS`` rows, so its memory depends neither on
``spark.sql.shuffle.partitions`` nor on the size of the table. Keys must be bounded
by themselves (a tile, a pair of records) unless the work can cut one: then
``cut_frames`` hands out parts of a long key too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handed to Python at once; a frame ends with the key that reaches it.
GROUP_ROWS = 200_000
KEY = "__key"


def whole_keys(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Frames of whole keys from batches sorted by ``KEY``; each is handed out as soon as it has ``most`` rows."""
    held: list[pd.DataFrame] = []
    n, last = 0, None
    for b in batches:
        if not len(b):
            continue
        key = b[KEY].to_numpy()
        starts = np.flatnonzero(np.r_[last is not None and key[0] != last, key[1:] != key[:-1]])
        at = 0
        while n + len(b) - at >= most:
            # the first place from which a new key begins once the frame is full
            i = int(np.searchsorted(starts, max(at, at + most - n)))
            if i == len(starts) or (starts[i] == at and not n):
                break
            held.append(b.iloc[at : starts[i]])
            yield pd.concat(held, ignore_index=True)
            held, n, at = [], 0, int(starts[i])
        held.append(b.iloc[at:])
        n, last = n + len(b) - at, key[-1]
    if n:
        yield pd.concat(held, ignore_index=True)


Part = pd.DataFrame | pa.Table


def _part(b: pd.DataFrame | pa.RecordBatch, start: int, end: int) -> pd.DataFrame | pa.RecordBatch:
    return b.iloc[start:end] if isinstance(b, pd.DataFrame) else b.slice(start, end - start)


def _joined(parts: list) -> Part:
    return pd.concat(parts, ignore_index=True) if isinstance(parts[0], pd.DataFrame) else pa.Table.from_batches(parts)


def _key(b: Part | pa.RecordBatch, i: int) -> int:
    return int(b[KEY].iloc[i]) if isinstance(b, pd.DataFrame) else b.column(KEY)[i].as_py()


def cut_frames(batches: Iterator, most: int) -> Iterator[tuple[Part, bool]]:
    """As ``whole_keys``, but a key longer than ``most`` comes in parts: (frame, whether its last key goes on).

    Batches are pandas frames or Arrow record batches; frames are pandas frames or Arrow tables.
    """
    held: list = []
    n = 0
    for b in batches:
        at = 0
        while n + len(b) - at > most:
            held.append(_part(b, at, at + most - n))
            at += most - n
            frame = _joined(held)
            yield frame, _key(frame, len(frame) - 1) == _key(b, at)
            held, n = [], 0
        held.append(_part(b, at, len(b)))
        n += len(b) - at
    if n:
        yield _joined(held), False


def placed(df: DataFrame, keys: list[str], then: list[str] | None = None) -> DataFrame:
    """``df`` with ``KEY``, a hash of ``keys``, its rows together and in order. Keys that share a hash share a frame."""
    return df.withColumn(KEY, F.xxhash64(*keys)).repartition(KEY).sortWithinPartitions(KEY, *(then or []))


def in_runs(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = GROUP_ROWS) -> DataFrame:
    """``work`` on frames of whole keys: at most ``most`` rows, and the rest of one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_keys(batches, most):
            yield work(frame)

    return placed(df, keys).mapInPandas(run, schema)
