"""Implausible readings per source: spikes, stuck values, impossible sizes.

Each source's readings are a hidden Markov chain with four states. A normal
reading scatters around its neighbours' median as the source usually does; a
spike may lie anywhere; a stuck reading repeats its neighbour exactly; an
out-of-range reading violates hard bounds. Forward-backward gives each reading
its state probabilities. A stuck flag also needs a run of at least ``run``
different records, a spike flag distance from both sides' medians and from the
ordinary readings next to it.

Sources are cut into tiles of bounded size with halos (see shardedtime), and a
task computes all chains it holds at once: they are folded into pieces of
``PIECE`` readings with ``OVERLAP`` readings of context on either side, and each
step of the recursion is one array operation over all pieces.

Defined results: null and NaN readings are no readings; copies of one record with
one value count once and share its flags; a source with a single reading can only
be out of range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.operators.shardedtime import tiled
from ivlattice.operators.sortedruns import GROUP_ROWS, in_runs
from ivlattice.session import durable

HOUR_US = 3_600_000_000
NORMAL, SPIKE, STUCK, OUT = range(4)
PIECE, OVERLAP = 64, 16
SIDE = 5
CONFIRM = 6.0

# Transition probabilities between the states (rows: from).
STEP = np.array(
    [
        [0.99, 0.0049, 1e-8, 0.005],
        [0.60, 0.39, 1e-8, 0.01],
        [0.05, 0.001, 0.94, 0.009],
        [0.90, 0.005, 1e-8, 0.095],
    ]
)
STEP /= STEP.sum(1, keepdims=True)
START = np.array([0.98, 0.01, 1e-6, 0.01])


@dataclass(frozen=True)
class Limits:
    """Hard bounds of a quantity and the least scatter (of its logarithm) worth telling apart.

    ``offset`` is added before the logarithm, so that amounts near the smallest
    tick do not scatter without bound.
    """

    low: float
    high: float
    floor: float
    offset: float = 0.0
    stuck: bool = True


def _medians(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row medians of an array with NaN gaps, and the number of values in each row."""
    n = (~np.isnan(v)).sum(1)
    s = np.sort(v, axis=1)  # NaN last
    rows = np.arange(len(v))
    lo, hi = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, v.shape[1] - 1)
    return np.where(n > 0, (s[rows, lo] + s[rows, hi]) / 2, np.nan), n


def _around(v: np.ndarray, series: np.ndarray, offsets: list[int]) -> np.ndarray:
    n = len(v)
    out = np.full((n, len(offsets)), np.nan)
    for j, k in enumerate(offsets):
        a, b = max(0, -k), min(n, n - k)
        if a < b:
            same = series[a:b] == series[a + k : b + k]
            out[a:b, j] = np.where(same, v[a + k : b + k], np.nan)
    return out


def side_median(v: np.ndarray, series: np.ndarray, k: int = 3) -> np.ndarray:
    """Median of up to k neighbours on each side, itself left out."""
    return _medians(_around(v, series, [*range(-k, 0), *range(1, k + 1)]))[0]


def deviation(x: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Distance from the nearer of the medians before, after and around.

    A lasting change is near the readings after it, a spike near neither side.
    """
    before, nb = _medians(_around(x, series, list(range(-SIDE, 0))))
    after, na = _medians(_around(x, series, list(range(1, SIDE + 1))))
    around, _ = _medians(_around(x, series, [*range(-4, 0), *range(1, 5)]))
    gaps = np.abs(np.stack([np.where(nb >= 3, x - before, np.nan), np.where(na >= 3, x - after, np.nan), x - around]))
    gaps = np.where(np.isnan(gaps), np.inf, gaps)
    out = gaps.min(0)
    return np.where(np.isinf(out), 0.0, out)


def _pieces(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index matrix (pieces x PIECE) of consecutive readings of one series (-1 where none), and its piece per reading."""
    n = len(series)
    start = np.r_[True, series[1:] != series[:-1]] if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    at = np.arange(n) - first
    piece = np.cumsum((at % PIECE == 0)) - 1
    index = np.full((piece[-1] + 1 if n else 0, PIECE), -1)
    index[piece, at % PIECE] = np.arange(n)
    return index, piece


def scatter(dev: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Robust scale of the deviations over a reading's piece and the two beside it."""
    index, piece = _pieces(series)
    own = np.where(index >= 0, dev[index], np.nan)
    head = series[index[:, 0]]
    left = np.where((np.r_[-1, head[:-1]] == head)[:, None], np.roll(own, 1, 0), np.nan)
    right = np.where((np.r_[head[1:], -1] == head)[:, None], np.roll(own, -1, 0), np.nan)
    return 1.4826 * _medians(np.hstack([left, own, right]))[0][piece]


def state_probabilities(u: np.ndarray, equal: np.ndarray, out: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Forward-backward state probabilities (readings x states).

    ``u``: deviation in units of usual scatter; ``equal``: repeats a neighbour
    exactly; ``out``: violates the hard bounds.
    """
    n = len(u)
    if n == 0:
        return np.zeros((0, 4))
    core = np.exp(-np.minimum(u, 38) ** 2 / 2) * 0.9 + np.exp(-np.minimum(u / 2.5, 38) ** 2 / 2) * 0.1 / 2.5
    emit = np.empty((n, 4))
    emit[:, NORMAL] = core / 2.5066 * np.where(equal, 0.02, 0.98) + 1e-300
    emit[:, SPIKE] = np.where(u > 3, 1 / 60, 1e-4) * 0.5
    emit[:, STUCK] = np.where(equal, 0.2, 1e-12)
    emit[:, OUT] = 1e-200
    emit[out] = [1e-200, 1e-200, 1e-200, 1.0]
    emit /= emit.max(1, keepdims=True)
    index, piece = _pieces(series)
    width = PIECE + 2 * OVERLAP
    wide = index[:, :1] - OVERLAP + np.arange(width)
    ok = (wide >= 0) & (wide < n)
    wide = np.clip(wide, 0, n - 1)
    ok &= series[wide] == series[index[:, 0]][:, None]
    e = np.where(ok[:, :, None], emit[wide], 1.0)
    forward = np.empty((width, len(index), 4))
    state = np.broadcast_to(START, (len(index), 4))
    for t in range(width):
        state = (state @ STEP) * e[:, t]
        state = state / state.sum(1, keepdims=True)
        forward[t] = state
    back = np.ones((len(index), 4))
    for t in range(width - 1, -1, -1):
        both = forward[t] * back
        forward[t] = both / both.sum(1, keepdims=True)
        back = (e[:, t] * back) @ STEP.T
        back = back / back.sum(1, keepdims=True)
    at = np.arange(n) - index[piece, 0] + OVERLAP
    return forward[at, piece]


def run_lengths(value: np.ndarray, series: np.ndarray) -> np.ndarray:
    n = len(value)
    if n == 0:
        return np.zeros(0, np.int64)
    start = np.r_[True, (value[1:] != value[:-1]) | (series[1:] != series[:-1])]
    ids = np.cumsum(start) - 1
    return np.bincount(ids)[ids]


def _stands_apart(x: np.ndarray, scale: np.ndarray, series: np.ndarray, spike: np.ndarray) -> np.ndarray:
    """Whether a reading is CONFIRM scales away from the two nearest ordinary readings on either side.

    A slow drift between sparse readings is near one of them, a spike near none.
    """
    index = np.flatnonzero(~spike & ~np.isnan(x))
    at = np.flatnonzero(spike)
    place = np.searchsorted(index, at)
    apart = np.ones(len(at), bool)
    for k in (-2, -1, 0, 1):
        j = place + k
        ok = (j >= 0) & (j < len(index))
        other = index[np.clip(j, 0, max(len(index) - 1, 0))] if len(index) else np.zeros(len(at), int)
        near = ok & (series[other] == series[at]) & (np.abs(x[at] - x[other]) < CONFIRM * scale[at])
        apart &= ~near
    out = np.zeros(len(x), bool)
    out[at] = apart
    return out


def classify(value: np.ndarray, expected: np.ndarray, series: np.ndarray, limits: Limits, run: int) -> tuple[np.ndarray, np.ndarray]:
    """State (0 to 3) and its probability for readings sorted by series and time."""
    out = (value <= limits.low) | (value >= limits.high)
    plain = np.log(np.clip(value, 1e-9, 1e9) + limits.offset)
    x = plain - np.log(expected + limits.offset)
    seen = np.where(out, np.nan, x)
    dev = deviation(seen, series)
    dev = np.where(out, 0.0, dev)
    scale = np.maximum(np.nan_to_num(scatter(dev, series)), limits.floor)
    u = dev / scale
    lengths = run_lengths(value, series)
    equal = (lengths > 1) & limits.stuck
    p = state_probabilities(u, equal, out, series)
    state = p.argmax(1)
    state = np.where((state == STUCK) & (lengths < run), NORMAL, state)
    state = np.where(out, OUT, state)
    # by itself as well as by what was expected of it, as the expectation may be what is wrong
    for v in (seen, np.where(out, np.nan, plain)):
        state = np.where((state == SPIKE) & ~_stands_apart(v, scale, series, state == SPIKE), NORMAL, state)
    return state, p[np.arange(len(p)), state]


FLAGGED = ["kind", "source", "record", "value", "row_key", "last_key", "copies"]
#: Flagged records with more than two copies are broadcast up to this number (rows of about 100 bytes), joined by shuffle beyond.
MOST_BROADCAST = 100_000
STATES = ("normal", "spike", "stuck", "out_of_range")


def flag_readings(
    readings: DataFrame,
    limits: dict[str, Limits],
    expect: dict[str, Callable[[pd.DataFrame, np.ndarray], np.ndarray]] | None = None,
    covariates: list[str] | None = None,
    run: int = 8,
    size: int = 20_000,
    cell_us: int = HOUR_US,
    most: int = GROUP_ROWS,
) -> DataFrame:
    """Flags of all readings that are not normal.

    ``readings``: kind string (a key of ``limits``), source string, at long
    (microseconds), record string (equal for copies), row_key long, value double,
    and any covariates. ``expect[kind](frame, series)`` may give the level a
    reading should have; the default is a constant, so only neighbours count.
    Returns kind, row_key, flag, probability. Python gets whole tiles, ``most`` rows at
    a time and the rest of one tile.
    """
    covariates = covariates or []
    expect = expect or {}
    rows = readings.filter(F.col("value").isNotNull() & ~F.isnan("value")).dropna(subset=["source", "record", "at"])
    cut = tiled(rows, ["kind", "source"], "at", cell_us, size, halo=2 * PIECE)
    # copies of a record with one value become one row before anything is grouped in Python
    keys = ["kind", "source", "__tile", "record", "value"]
    records = cut.groupBy(*keys).agg(
        F.min(F.struct("row_key", "at", *covariates)).alias("r"),
        F.max("row_key").alias("last_key"),
        F.count(F.lit(1)).alias("copies"),
        F.max("__core").alias("__core"),
    )
    records = records.select(*keys, "r.*", "last_key", "copies", "__core")

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for kind, g in pdf.groupby("kind", sort=False):
            lane = pd.factorize(g["source"] + "\x00" + g["__tile"].astype(str))[0]
            order = np.lexsort((g["row_key"].to_numpy(), g["at"].to_numpy(), lane))
            g, series = g.iloc[order], lane[order]
            level = expect[kind](g, series) if kind in expect else np.ones(len(g))
            state, p = classify(g["value"].to_numpy(float), level, series, limits[kind], run)
            hit = (state != NORMAL) & g["__core"].to_numpy(bool)
            parts.append(g[hit][FLAGGED].assign(flag=np.array(STATES)[state[hit]], probability=p[hit]))
        return pd.concat(parts)

    schema = "kind string, source string, record string, value double, row_key long, last_key long, copies long, flag string, probability double"
    flagged = durable(in_runs(records, ["kind", "source", "__tile"], chains, schema, most))
    # one or two copies are known by their first and last key; only rows with more are looked up
    ends = F.explode(F.array_distinct(F.array("row_key", "last_key"))).alias("row_key")
    few = flagged.filter("copies <= 2").select("kind", ends, "flag", "probability")
    many = flagged.filter("copies > 2").select("kind", "source", "record", "value", "flag", "probability")
    if many.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        many = F.broadcast(many)
    rest = rows.select("kind", "source", "record", "value", "row_key").join(many, ["kind", "source", "record", "value"])
    return few.unionByName(rest.select("kind", "row_key", "flag", "probability")).distinct()
