"""Long exact spans shared between records, by collinear chaining of k-mer seeds.

1. Seeds. Every window of ``length`` characters owns one k-mer, the smallest by
   hash among those it contains. Equal windows own equal k-mers, so a window
   shared by two records always gives them a common seed. Windows next to each
   other mostly own the same k-mer; a seed with its range of windows is one row.
   Texts are read once: the seeds become a table.
2. Join. Rows of one seed meet in frames of bounded size (see sortedruns). Where
   the whole stretch of a seed's windows stands in another record too, all of it is
   a match. Seeds with more than ``HOT`` rows are counted out before and joined by
   map-side aggregation and broadcasts instead, so none is gathered in one place.
3. Where only part of the stretch does, its windows are compared one by one,
   against two examples of each different stretch of that seed.
4. Chain. Matches of a record with one partner are merged along diagonals into
   anchors, and chained in order with linear gap costs by a Fenwick tree. Every
   anchor belongs to one chain; a chain is a fuzzy passage, its anchors are the
   exact spans.

Each match of steps 2 and 3 names one partner, which is all that the union over
partners needs. That union takes the anchors of all chains: chaining decides which
anchors form one passage, not which characters are shared.

Passages name every partner. Copies of a whole text are one class, of which the
least id is matched; the others have one row with it. A seed's places in the
representatives are paired in blocks of bounded size, all places with all, merged
along diagonals into runs of each pair, chained, and extended to exact spans; the
gaps between the anchors of a chain are aligned, 30 characters to a machine word.

Defined results: null texts, texts without an id and texts shorter than ``length`` share nothing; a
record does not share with itself; copies of one text under different ids do
share. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ivlattice.llm.rolling import code_points, prefix, run_pairs as _hits, runs as _runs, sliding_min, window_hash
from ivlattice.operators.sortedruns import in_runs
from ivlattice.session import durable, remove, spread, stored

BLOCK_CHARS = 1 << 20
#: Low bits that hold a place in a block; texts of up to 4 billion characters.
PLACE_BITS = np.uint64(32)
GAP_COST = 0.1
MOST_IDS = 1_000_000
#: Rows of one seed (or window) up to which a task may hold them all at once.
HOT = 50_000
#: Copies of an example of a hot seed, so that its rows meet it in as many places.
SALT = 8
#: Places of one seed that one task pairs with as many others.
BLOCK_PLACES = 1024
#: Rows with pieces of text on either side that Python takes at once.
MOST_FLANKS = 20_000
#: Pieces of text that are sent on together.
MOST_PIECES = 4096


def _blocks(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in runs of about BLOCK_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]


def _stretches(texts: list[str], length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text number, seed hash, hash of the whole stretch, first and last window, place of the seed) per seed."""
    points, ends = code_points(texts)
    pre = prefix(points)
    starts = np.arange(max(0, len(points) - k + 1))
    seed = window_hash(pre, starts, starts + k)
    # the smallest seed of a window, the first on ties: hash in the high bits, place in the low ones
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    owner = (sliding_min((seed & ~low) | starts.astype(np.uint64), length - k + 1) & low).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(ends))[: len(owner)]
    window = np.arange(len(owner))
    whole = window + length <= ends[of + 1]
    window, owner, of = window[whole], owner[whole], of[whole]
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    new = np.r_[True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])]
    first = np.flatnonzero(new)
    a, b = window[first], window[np.r_[first[1:], len(window)] - 1]
    of, owner = of[first], owner[first]
    return of, seed[owner], window_hash(pre, a, b + length), a - ends[of], b - ends[of], owner - ends[of]


def seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, seed, stretch (hash), a, b: the windows [a, b] that own the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for ids, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    of, seed, stretch, a, b, _ = _stretches(texts, length, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(ids, np.int64)[of]), pa.array(seed.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                        names=["doc_id", "seed", "stretch", "a", "b"],
                    )

    return spread(docs).mapInArrow(run, "doc_id long, seed long, stretch long, a int, b int")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, so that other texts are not shuffled by a later join.

    Up to MOST_IDS ids (8 bytes each) are broadcast; beyond, the join shuffles.
    """
    ids = ids.distinct()
    small = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """One row per wanted window: seed, window (hash), doc_id, start, asks.

    ``wanted``: doc_id and a list of struct<seed, a, b, asks>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for doc, text, want in zip(*(c.to_pylist() for c in batch.columns)):
                    points, _ = code_points([text])
                    pre = prefix(points)
                    n = np.array([w["b"] - w["a"] + 1 for w in want])
                    at = np.repeat(np.array([w["a"] for w in want]) - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.array([w["seed"] for w in want], np.int64), n)),
                            pa.array(window_hash(pre, at, at + length).view(np.int64)),
                            pa.array(np.full(len(at), doc, np.int64)),
                            pa.array(at.astype(np.int32)),
                            pa.array(np.repeat(np.array([w["asks"] for w in want]), n)),
                        ],
                        names=["seed", "window", "doc_id", "start", "asks"],
                    )

    joined = _only(docs, wanted.select("doc_id")).join(wanted, "doc_id").select("doc_id", "text", "want")
    return joined.mapInArrow(run, "seed long, window long, doc_id long, start int, asks boolean")


def _partner(lo: str, hi: str):
    """The example that lies in another record."""
    return F.when(F.col(f"{lo}.d") != F.col("doc_id"), F.col(lo)).otherwise(F.col(hi))


MATCH, ASKS, SHOWN = "match", "asks", "shown"
_FOUND = "what string, doc_id long, seed long, a int, b int, partner long, partner_start int"


def _seed_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """All rows of whole seeds to matches of whole stretches, stretches that ask, and examples to compare them with."""
    seed, stretch, doc, a, b = (pdf[c].to_numpy() for c in ("seed", "stretch", "doc_id", "a", "b"))
    order = np.lexsort((a, doc, stretch, seed))
    seed, stretch, doc, a, b = seed[order], stretch[order], doc[order], a[order], b[order]
    new_seed = np.r_[True, seed[1:] != seed[:-1]]
    first = np.flatnonzero(new_seed | np.r_[True, stretch[1:] != stretch[:-1]])
    last = np.r_[first[1:], len(seed)] - 1
    kind = np.repeat(np.arange(len(first)), last - first + 1)
    twice = doc[first] != doc[last]
    # by seed: whether two records have it, and whether some of several stretches stands in one record only
    at = np.flatnonzero(new_seed)
    common = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    kinds_at = np.searchsorted(first, at)
    several = np.diff(np.r_[kinds_at, len(first)]) > 1
    is_open = np.repeat(common & several & ~np.minimum.reduceat(twice, kinds_at), np.diff(np.r_[kinds_at, len(first)]))
    full = np.flatnonzero(twice[kind])
    other = np.where(doc[full] != doc[first][kind[full]], first[kind[full]], last[kind[full]])
    asks = np.flatnonzero((is_open & ~twice)[kind])
    shown = np.unique(np.concatenate([first[is_open & twice], last[is_open & twice]]))
    rows = np.concatenate([full, asks, shown])
    what = np.repeat([MATCH, ASKS, SHOWN], [len(full), len(asks), len(shown)])
    none = np.zeros(len(asks) + len(shown), np.int64)
    return pd.DataFrame(
        {"what": what, "doc_id": doc[rows], "seed": seed[rows], "a": a[rows], "b": b[rows], "partner": np.r_[doc[other], none], "partner_start": np.r_[a[other], none].astype(np.int32)}
    )


def _hot_rows(found: DataFrame) -> DataFrame:
    """As ``_seed_frame`` for the rows of seeds that stand nearly everywhere: nothing gathers a seed.

    Examples are found with map-side combination. They go back to the rows of their
    stretch by a join in which each of them is copied to SALT places.
    """
    where = F.struct(F.col("doc_id").alias("d"), F.col("a").alias("a"), F.col("b").alias("b"))
    kinds = durable(found.groupBy("seed", "stretch").agg(F.min(where).alias("lo"), F.max(where).alias("hi")))
    twice = F.col("lo.d") != F.col("hi.d")
    by_seed = kinds.groupBy("seed").agg(F.min("lo.d").alias("d0"), F.max("hi.d").alias("d1"), F.count(F.lit(1)).alias("n"), F.bool_or(~twice).alias("some"))
    # one row per hot seed, of which there are at most one for HOT rows of the table
    opened = by_seed.select("seed", (F.col("d0") != F.col("d1")).alias("common"), ((F.col("n") > 1) & F.col("some")).alias("open"))
    salted = kinds.join(F.broadcast(opened), "seed").filter("common").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    rows = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["seed", "stretch", "salt"])
    p, none = _partner("lo", "hi"), F.lit(0).cast("long")
    full = rows.filter(twice).select(F.lit(MATCH).alias("what"), "doc_id", "seed", "a", "b", p["d"].alias("partner"), p["a"].alias("partner_start"))
    asks = rows.filter(~twice & F.col("open")).select(F.lit(ASKS).alias("what"), "doc_id", "seed", "a", "b", none.alias("partner"), none.cast("int").alias("partner_start"))
    shown = kinds.filter(twice).join(F.broadcast(opened.filter("common and open")), "seed").select("seed", F.explode(F.array("lo", "hi")).alias("x")).distinct()
    shown = shown.select(F.lit(SHOWN).alias("what"), F.col("x.d").alias("doc_id"), "seed", F.col("x.a").alias("a"), F.col("x.b").alias("b"), none.alias("partner"), none.cast("int").alias("partner_start"))
    return full.unionByName(asks).unionByName(shown)


def _hot_keys(df: DataFrame, keys: list[str], hot: int) -> DataFrame | None:
    """Keys with more than ``hot`` rows, None if there are none; at most one for ``hot`` rows of the table, so they may be broadcast."""
    many = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).select(*keys))
    return None if many.isEmpty() else many


def matches(docs: DataFrame, length: int, k: int, hot: int = HOT) -> DataFrame:
    """Exact matches: doc_id, start, end, partner, partner_start.

    Together they cover exactly the characters that lie in a shared window.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    every, path = stored(seeds(docs, length, k))
    many = _hot_keys(every, ["seed"], hot)
    if many is None:
        found = in_runs(every, ["seed"], _seed_frame, _FOUND)
    else:
        found = in_runs(every.join(F.broadcast(many), "seed", "left_anti"), ["seed"], _seed_frame, _FOUND)
        found = found.unionByName(_hot_rows(every.join(F.broadcast(many), "seed")))
    found = durable(found)
    remove(docs.sparkSession, path)
    full = found.filter(F.col("what") == MATCH).select("doc_id", F.col("a").alias("start"), (F.col("b") + length).alias("end"), "partner", "partner_start")
    wanted = found.filter(F.col("what") != MATCH).groupBy("doc_id").agg(F.collect_list(F.struct("seed", "a", "b", (F.col("what") == ASKS).alias("asks"))).alias("want"))
    windows = durable(_windows(docs, wanted, length))
    many = _hot_keys(windows, ["seed", "window"], hot)
    if many is None:
        part = in_runs(windows, ["seed", "window"], _window_frame, _MATCHES)
    else:
        part = in_runs(windows.join(F.broadcast(many), ["seed", "window"], "left_anti"), ["seed", "window"], _window_frame, _MATCHES)
        part = part.unionByName(_hot_windows(windows.join(F.broadcast(many), ["seed", "window"])))
    return full.unionByName(part.withColumn("end", F.col("start") + length))


_MATCHES = "doc_id long, start int, partner long, partner_start int"


def _window_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """All rows of whole windows: those that ask, with an example in another record."""
    seed, window, doc, start, asks = (pdf[c].to_numpy() for c in ("seed", "window", "doc_id", "start", "asks"))
    order = np.lexsort((start, doc, window, seed))
    seed, window, doc, start, asks = seed[order], window[order], doc[order], start[order], asks[order].astype(bool)
    first = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (window[1:] != window[:-1])])
    last = np.r_[first[1:], len(seed)] - 1
    kind = np.repeat(np.arange(len(first)), last - first + 1)
    rows = np.flatnonzero(asks & (doc[first] != doc[last])[kind])
    other = np.where(doc[rows] != doc[first][kind[rows]], first[kind[rows]], last[kind[rows]])
    return pd.DataFrame({"doc_id": doc[rows], "start": start[rows], "partner": doc[other], "partner_start": start[other]})


def _hot_windows(windows: DataFrame) -> DataFrame:
    """As ``_window_frame`` for windows with very many rows; one row of examples each, which may be broadcast."""
    spot = F.struct(F.col("doc_id").alias("d"), F.col("start").alias("a"))
    known = windows.groupBy("seed", "window").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).filter(F.col("lo.d") != F.col("hi.d"))
    p = _partner("lo", "hi")
    return windows.filter("asks").join(F.broadcast(known), ["seed", "window"]).select("doc_id", "start", p["d"].alias("partner"), p["a"].alias("partner_start"))


def merge_diagonals(start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals that touch or overlap on one diagonal (same shift)."""
    order = np.lexsort((start, shift))
    start, end, shift = start[order], end[order], shift[order]
    lane = np.cumsum(np.r_[0, (shift[1:] != shift[:-1])])
    big = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + lane * big) - lane * big
    new = np.r_[True, (lane[1:] != lane[:-1]) | (start[1:] > reach[:-1])] if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return start[first], reach[last], shift[first]


class BestBefore:
    """Fenwick tree of prefix maxima: the best (score, item) among positions up to i."""

    def __init__(self, n: int) -> None:
        self.best = [(float("-inf"), -1)] * (n + 1)

    def add(self, i: int, score: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if score > self.best[i][0]:
                self.best[i] = (score, item)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        i += 1
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chain(start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Chain number of each anchor.

    Anchors (start to end in one record, from ``other`` in its partner) follow each
    other in both records; a link costs GAP_COST per character skipped in either,
    and is made only where it gains. Each anchor is in exactly one chain.
    """
    n = len(start)
    if n == 1:
        return np.zeros(1, np.int64)
    other_end = other + (end - start)
    rank = {v: i for i, v in enumerate(np.unique(other_end).tolist())}
    ends = np.array(sorted(rank))
    tree = BestBefore(len(rank))
    by_start, by_end = np.lexsort((end, start)), np.argsort(end, kind="stable")
    score, back, done = np.zeros(n), np.full(n, -1), 0
    for i in by_start.tolist():
        while done < n and end[by_end[done]] <= start[i]:
            j = int(by_end[done])
            tree.add(rank[int(other_end[j])], score[j] + GAP_COST * (end[j] + other_end[j]), j)
            done += 1
        s, j = tree.upto(int(np.searchsorted(ends, other[i], side="right")) - 1)
        gain = s - GAP_COST * (start[i] + other[i])
        score[i] = end[i] - start[i]
        if j >= 0 and gain > 0:
            score[i] += gain
            back[i] = j
    label = np.full(n, -1)
    for n_chain, i in enumerate(np.argsort(-score, kind="stable").tolist()):
        while i >= 0 and label[i] < 0:
            label[i] = n_chain
            i = int(back[i])
    return label


ANCHORS = "doc_id long, partner long, chain int, span_start long, span_end long, partner_start long"


def _anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (doc, partner), g in pdf.groupby(["doc_id", "partner"], sort=False):
        s, e = g["start"].to_numpy(np.int64), g["end"].to_numpy(np.int64)
        s, e, shift = merge_diagonals(s, e, g["partner_start"].to_numpy(np.int64) - s)
        out.append(pd.DataFrame({"doc_id": doc, "partner": partner, "chain": chain(s, e, s + shift), "span_start": s, "span_end": e, "partner_start": s + shift}))
    return pd.concat(out)


def anchors(found: DataFrame) -> DataFrame:
    """Anchors of all chains, from ``matches``."""
    return in_runs(found, ["doc_id", "partner"], _anchors, ANCHORS)


def shared_spans(docs: DataFrame, length: int = 300, k: int = 176, hot: int = HOT) -> DataFrame:
    """doc_id, span_start, span_end: the union of a record's anchors over all its chains.

    A record's matches are chained and united where they meet, in one shuffle; their
    number is bounded by its length.
    """

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _anchors(pdf)
        s, e, doc = merge_diagonals(a["span_start"].to_numpy(), a["span_end"].to_numpy(), a["doc_id"].to_numpy())
        return pd.DataFrame({"doc_id": doc, "span_start": s, "span_end": e})

    return in_runs(matches(docs, length, k, hot), ["doc_id"], union, "doc_id long, span_start long, span_end long")


def edit_distance(a: str, b: str) -> int:
    """Fewest insertions, deletions and substitutions.

    A column of the table is two numbers with a bit for each character of ``a``, where
    it rises and where it falls against the row before; one step of a few operations on
    them takes it past a character of ``b``.
    """
    head = len(commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, edits = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        level = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (every & ~(level | rises)), rises & level
        if up & last:
            edits += 1
        elif down & last:
            edits -= 1
        up, down, keep = (up << 1) | 1, down << 1, same | falls
        rises, falls = (down | ~(keep | up)) & every, up & keep & every
    return edits


def places(docs: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, seed, again (a second hash), place, step, n: where the seeds stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for ids, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    of, seed, _, _, _, place = _stretches(texts, length, k)
                    first, step, count = _runs(of, seed, place)
                    of, seed, place = of[first], seed[first], place[first]
                    points, ends = code_points(texts)
                    at = ends[of] + place
                    again = window_hash(prefix(points + np.uint32(0x110000)), at, at + k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(ids, np.int64)[of]), pa.array(seed.view(np.int64)), pa.array(again.view(np.int64)), pa.array(place), pa.array(step), pa.array(count.astype(np.int64))],
                        names=["doc_id", "seed", "again", "place", "step", "n"],
                    )

    return spread(docs).mapInArrow(run, "doc_id long, seed long, again long, place long, step long, n long")


def _paired(found: DataFrame) -> DataFrame:
    """All places of a seed with all its places in records of greater id; ``size`` is the number of its rows."""
    blocks = F.ceil(F.col("size") / BLOCK_PLACES)
    found = found.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    left = found.select("seed", "again", F.col("own").alias("i"), F.col("other").alias("j"), "doc_id", "place", "step", "n")
    right = found.select("seed", "again", F.col("other").alias("i"), F.col("own").alias("j"), F.col("doc_id").alias("partner"), F.col("place").alias("place2"), F.col("step").alias("step2"), F.col("n").alias("n2"))
    return left.join(right, ["seed", "again", "i", "j"]).filter("doc_id < partner").drop("seed", "again", "i", "j")


RUNS = "doc_id long, partner long, s long, e long, ps long, pe long"


def pair_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of shared seeds on one diagonal, of every two records: ``RUNS``, doc_id < partner."""
    every, path = stored(places(docs, length, k))
    common = every.groupBy("seed", "again").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count(F.lit(1)).alias("size")).filter("d0 <> d1").select("seed", "again", "size")
    shared = durable(every.join(common, ["seed", "again"]))
    remove(docs.sparkSession, path)
    hits = _paired(shared)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (doc, partner), g in pdf.groupby(["doc_id", "partner"], sort=False):
            six = zip(*(g[c].tolist() for c in ("place", "step", "n", "place2", "step2", "n2")))
            h = np.array([x for row in six for x in _hits(*row, k)], np.int64).reshape(-1, 3)
            s, e, shift = merge_diagonals(h[:, 0], h[:, 1], h[:, 2] - h[:, 0])
            out.append(pd.DataFrame({"doc_id": doc, "partner": partner, "s": s, "e": e, "ps": s + shift, "pe": e + shift}))
        return pd.concat(out)

    return in_runs(hits, ["doc_id", "partner"], run, RUNS)


def _flanks(docs: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """doc_id, s, e, before, after: up to ``reach`` characters on either side of each run, in both records."""
    wanted = runs.select("doc_id", "s", "e").union(runs.select("partner", "ps", "pe")).distinct()
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, want in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, len(want), MOST_PIECES):
                    part = [(w["s"], w["e"]) for w in want[at : at + MOST_PIECES]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(part), pa.int64()),
                            pa.array([s for s, _ in part], pa.int64()),
                            pa.array([e for _, e in part], pa.int64()),
                            pa.array([text[max(0, s - reach) : s] for s, _ in part], pa.string()),
                            pa.array([text[e : e + reach] for _, e in part], pa.string()),
                        ],
                        names=["doc_id", "s", "e", "before", "after"],
                    )

    joined = _only(docs, wanted.select("doc_id")).join(wanted, "doc_id").select("doc_id", "text", "want")
    return joined.mapInArrow(run, "doc_id long, s long, e long, before string, after string")


def _alike(a: str, b: str) -> int:
    """Number of equal characters at the start of both."""
    return len(commonprefix([a, b]))


def _in_chains(label: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray) -> list[list[int]]:
    """[chain, start, end, partner_start], cut so that the anchors of a chain don't overlap in either record."""
    out: list[list[int]] = []
    for i in np.lexsort((s, label)).tolist():
        c, a, b, o = int(label[i]), int(s[i]), int(e[i]), int(other[i])
        if out and out[-1][0] == c:
            last = out[-1]
            if o - a == last[3] - last[1] and a <= last[2]:
                last[2] = max(last[2], b)
                continue
            over = max(0, last[2] - a, last[3] + last[2] - last[1] - o)
            a, o = a + over, o + over
            if a >= b:
                continue
        out.append([c, a, b, o])
    return out


def pair_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Anchors of the chains of every two records, doc_id < partner.

    Every shared seed counts, also in a span shorter than ``length``. A span of
    ``length`` or more has a seed within ``length - k`` characters of both ends, so
    runs that are extended so far are whole spans.
    """
    runs = durable(pair_runs(docs, length, k))
    flanks = durable(_flanks(docs, runs, length - k))
    theirs = flanks.select(F.col("doc_id").alias("partner"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("before").alias("before2"), F.col("after").alias("after2"))
    both = runs.join(flanks, ["doc_id", "s", "e"]).join(theirs, ["partner", "ps", "pe"]).select("doc_id", "partner", "s", "e", "ps", "before", "before2", "after", "after2")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.array([_alike(a[::-1], b[::-1]) for a, b in zip(pdf["before"], pdf["before2"])], np.int64)
        right = np.array([_alike(a, b) for a, b in zip(pdf["after"], pdf["after2"])], np.int64)
        pdf = pdf[["doc_id", "partner", "s", "e", "ps"]].assign(left=left, right=right)
        out = []
        for (doc, partner), g in pdf.groupby(["doc_id", "partner"], sort=False):
            s, e, other, left, right = (g[c].to_numpy(np.int64) for c in ("s", "e", "ps", "left", "right"))
            rows = np.array(_in_chains(chain(s, e, other), s - left, e + right, other - left), np.int64)
            out.append(pd.DataFrame({"doc_id": doc, "partner": partner, "chain": rows[:, 0], "span_start": rows[:, 1], "span_end": rows[:, 2], "partner_start": rows[:, 3]}))
        return pd.concat(out)

    return in_runs(both, ["doc_id", "partner"], run, ANCHORS, most=MOST_FLANKS)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, partner, size: records whose whole text is that of the partner, the least id that has it."""
    keys = docs.select("doc_id", F.md5("text").alias("key"), F.length("text").cast("long").alias("size"))
    classes = keys.groupBy("key", "size").agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last")).filter("partner <> last").drop("last")
    return keys.join(classes, ["key", "size"]).filter("doc_id <> partner").select("doc_id", "partner", "size")


def _gaps(a: DataFrame) -> DataFrame:
    """Stretches between consecutive anchors of a chain, in both records (negative lengths as none)."""
    w = Window.partitionBy("doc_id", "partner", "chain").orderBy("span_start")
    g = a.withColumns(
        {
            "q0": F.lag("span_end").over(w),
            "t0": F.lag(F.col("partner_start") + F.col("span_end") - F.col("span_start")).over(w),
        }
    ).filter(F.col("q0").isNotNull())
    return g.select("doc_id", "partner", "chain", "q0", F.greatest("q0", "span_start").alias("q1"), "t0", F.greatest("t0", "partner_start").alias("t1"))


def passages(docs: DataFrame, length: int = 300, k: int = 176) -> DataFrame:
    """Fuzzy passages: one row per chain of each two different texts, aligned between its anchors.

    ``edits`` is the sum of the edit distances of the gaps, ``similarity`` one minus
    edits over the longer side. Of copies of one text, the least id has the passages;
    each other has one row with it over the whole text (similarity 1), and so its
    passages too. Rows stand in both directions. A chain never leaves its two records,
    so a window or a group here is bounded by two records.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    same = durable(copies(docs))
    extra = same.select("doc_id")
    small = extra.limit(MOST_IDS + 1).count() <= MOST_IDS
    text = docs.join(F.broadcast(extra) if small else extra, "doc_id", "left_anti")
    a = durable(pair_anchors(text, length, k))
    gaps = _gaps(a)
    text = _only(text, gaps.select("doc_id").union(gaps.select(F.col("partner").alias("doc_id"))))
    side = lambda at, to: F.substring("text", F.col(at).cast("int") + 1, (F.col(to) - F.col(at)).cast("int"))
    gaps = gaps.join(text, "doc_id").withColumn("qs", side("q0", "q1")).drop("text")
    gaps = gaps.join(text.withColumnRenamed("doc_id", "partner"), "partner").withColumn("ts", side("t0", "t1")).drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [edit_distance(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(edits, pa.int64())], names=["doc_id", "partner", "chain", "edits"])

    aligned = gaps.select("doc_id", "partner", "chain", "qs", "ts").mapInArrow(run, "doc_id long, partner long, chain int, edits long")
    edits = aligned.groupBy("doc_id", "partner", "chain").agg(F.sum("edits").alias("edits"))
    p = a.groupBy("doc_id", "partner", "chain").agg(
        F.min("span_start").alias("span_start"),
        F.max("span_end").alias("span_end"),
        F.min("partner_start").alias("partner_start"),
        F.max(F.col("partner_start") + F.col("span_end") - F.col("span_start")).alias("partner_end"),
        F.sum(F.col("span_end") - F.col("span_start")).alias("exact_chars"),
        F.count(F.lit(1)).alias("n_anchors"),
    )
    longer = F.greatest(F.col("span_end") - F.col("span_start"), F.col("partner_end") - F.col("partner_start"))
    out = p.join(edits, ["doc_id", "partner", "chain"], "left").withColumn("edits", F.coalesce("edits", F.lit(0).cast("long")))
    out = out.withColumn("similarity", 1 - F.col("edits") / longer).drop("chain")
    none = F.lit(0).cast("long")
    whole = same.select("doc_id", "partner", none.alias("span_start"), F.col("size").alias("span_end"), none.alias("partner_start"), F.col("size").alias("partner_end"), F.col("size").alias("exact_chars"), F.lit(1).cast("long").alias("n_anchors"), none.alias("edits"), F.lit(1.0).alias("similarity"))
    out = durable(out.unionByName(whole))
    swap = {"doc_id": "partner", "partner": "doc_id", "span_start": "partner_start", "span_end": "partner_end", "partner_start": "span_start", "partner_end": "span_end"}
    return out.unionByName(out.select(*(F.col(swap.get(c, c)).alias(c) for c in out.columns)))


__all__ = ["shared_spans", "passages", "matches", "anchors", "chain", "edit_distance"]
