"""Evaluation texts leaking into training texts, by spaced-seed hashing.

Texts become sequences of word hashes. A spaced seed hashes the words at fixed
places of a mask's span and ignores the others, so a hit survives substitutions at
ignored places. Every exact run of SPAN words is hit by every mask at its first
word, so none of them is missed.

Training seeds that no evaluation text has are dropped where they arise, by a filter
sized by the number of evaluation seeds. What is left of a text are a few clusters:
seeds near each other, with the words around them. Seeds alone go through the join
of hashes; equal seeds at equal steps are one row, so repeated words make no rows of
their own. The words are fetched once for each pair of a cluster and an item, which
is verified on every diagonal that has a hit: exactly, and with substitutions.

Defined results: null and empty texts have no words and leak nothing, nor do rows
without an id; an item of fewer than SPAN words cannot be found; repeated texts are
reported under each id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.llm.rolling import run_pairs, runs, scramble
from ivlattice.operators.sortedruns import in_runs
from ivlattice.session import durable, spread

#: Words are maximal runs of Unicode letters and digits of the lower-cased text.
WORD = r"[\p{L}\p{N}]+"
SPAN = 12
#: Places of a window that count; the others may be substituted.
MASKS = ((0, 1, 3, 4, 6, 7, 9, 10, 11), (0, 2, 3, 5, 6, 8, 9, 11))
#: Bits of the filter for each evaluation seed, of which PROBES are set; 2 in 10,000 other seeds pass it.
BITS_A_SEED, PROBES = 32, 4
#: The filter is sent to every task and never larger than this: 16 million seeds. Beyond, it lets
#: more seeds through and the join alone decides; the result is the same.
MOST_FILTER_BYTES = 64 << 20
BLOCK_BYTES = 1 << 16
#: Ways in which the training seeds of one hash are spread in the join.
SALT = 8
MOST_REMEMBERED = 500_000

_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1) for i in range(SPAN)]


class Words:
    """Word hashes of texts, remembering the hashes of words seen, up to a fixed number."""

    def __init__(self) -> None:
        self.find = regex.compile(WORD).findall
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for w in self.find((text or "").lower()):
            h = known.get(w)
            if h is None:
                if len(known) >= MOST_REMEMBERED:
                    known.clear()
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            out.append(h)
        return out


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Spaced-seed hash of every window of SPAN words (uint64)."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, mask + 1, np.uint64)
    for at in MASKS[mask]:
        acc += words[at : at + n] * _ODD[at]
    return scramble(acc)


CLUSTERS = "id long, lo int, words array<long>, hits array<struct<mask:int,seed:long,at:int,step:int,n:int>>"
_HIT = pa.struct([("mask", pa.int32()), ("seed", pa.int64()), ("at", pa.int32()), ("step", pa.int32()), ("n", pa.int32())])


def _places(seed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's places of each seed, one array for each probe."""
    low, high = seed & np.uint64(0xFFFFFFFF), (seed >> np.uint64(32)) | np.uint64(1)
    for j in range(PROBES):
        yield (low + np.uint64(j) * high) & np.uint64(bits - 1)


def _pass(keep: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Indices of the seeds that the filter lets through."""
    at = np.arange(len(seed))
    for j in range(PROBES):
        place = list(_places(seed[at], 8 * len(keep)))[j]
        at = at[(keep[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def _clusters(texts: DataFrame, id_column: str, reach: int, shared: Broadcast | None) -> DataFrame:
    """Seeds that pass the filter (all without one), in clusters less than 2 * ``reach`` apart.

    ``words`` of a cluster stand from ``lo`` on, ``reach`` words before its first seed
    to ``reach`` words after its last; places of hits count from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words()
        keep = shared.value if shared is not None else None
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = [(doc, found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) if len(found := reader.hashes(text.as_py())) >= SPAN]
                if not kept:
                    continue
                # one pass over the words of the whole batch; windows across two texts are left out
                words = np.concatenate([np.array(w, np.uint64) for _, w in kept])
                ends = np.cumsum([len(w) for _, w in kept])
                of = np.repeat(np.arange(len(kept)), [len(w) for _, w in kept])
                mask, seed, at = [], [], []
                for m in range(len(MASKS)):
                    s = seed_hashes(words, m)
                    good = np.flatnonzero(np.arange(len(s)) + SPAN <= ends[of[: len(s)]])
                    good = good if keep is None else good[_pass(keep, s[good])]
                    mask.append(np.full(len(good), m)), seed.append(s[good]), at.append(good)
                mask, seed, at = np.concatenate(mask), np.concatenate(seed), np.concatenate(at)
                if not len(at):
                    continue
                place = np.unique(at)
                new = np.r_[True, (np.diff(place) >= SPAN + 2 * reach) | (of[place[1:]] != of[place[:-1]])]
                first, last = place[new], place[np.r_[np.flatnonzero(new)[1:], len(place)] - 1]
                text = of[first]
                start = np.r_[0, ends[:-1]][text]
                lo, hi = np.maximum(first - reach, start), np.minimum(last + SPAN + reach, ends[text])
                cluster = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((at, seed, mask, cluster))
                cluster, mask, seed, at = cluster[order], mask[order], seed[order], at[order]
                one, step, n = runs(cluster * len(MASKS) + mask, seed, at)
                hits = [mask[one], seed[one].view(np.int64), at[one] - lo[cluster[one]], step, n]
                hits = pa.StructArray.from_arrays([pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(hits, _HIT)], fields=list(_HIT))
                many = np.r_[0, np.cumsum(np.bincount(cluster[one], minlength=len(first)))]
                size = np.r_[0, np.cumsum(hi - lo)]
                flat = np.concatenate([words[a:b] for a, b in zip(lo.tolist(), hi.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kept[i][0] for i in text.tolist()], pa.int64()),
                        pa.array((lo - start).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(flat.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), hits),
                    ],
                    names=["id", "lo", "words", "hits"],
                )

    rows = texts.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return (spread(rows) if shared is not None else rows).mapInArrow(run, CLUSTERS)


def _filter(seeds: DataFrame) -> np.ndarray:
    """Bits of the evaluation seeds, built in blocks by the tasks and put together here: MOST_FILTER_BYTES at most."""
    n = seeds.count()
    bits = min(8 * MOST_FILTER_BYTES, 1 << max(20, (BITS_A_SEED * n - 1).bit_length()))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, np.uint8)
        with np.errstate(over="ignore"):
            for pdf in batches:
                for place in _places(pdf["seed"].to_numpy(np.int64).view(np.uint64), bits):
                    np.bitwise_or.at(own, (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        blocks = own.reshape(-1, BLOCK_BYTES)
        used = np.flatnonzero(blocks.any(1))
        yield pd.DataFrame({"block": used, "content": [blocks[i].tobytes() for i in used]})

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf.groupby("block")["content"]
        return of.agg(lambda parts: np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts]).tobytes()).reset_index()

    schema = "block long, content binary"
    out = np.zeros((bits // 8 // BLOCK_BYTES, BLOCK_BYTES), np.uint8)
    for row in in_runs(seeds.mapInPandas(part, schema), ["block"], put_together, schema, most=64).collect():
        out[row["block"]] = np.frombuffer(row["content"], np.uint8)
    return out.ravel()


def verify(doc: np.ndarray, p: int, item: np.ndarray, q: int, substitutions: int) -> tuple[int, int]:
    """(longest exact run, longest stretch with at most so many substitutions) on the hit's diagonal.

    Both must touch the hit's span.
    """
    before, after = min(p, q), min(len(doc) - p, len(item) - q)
    same = doc[p - before : p + after] == item[q - before : q + after]
    at = before
    miss = np.flatnonzero(~same)
    edges = np.concatenate([[-1], miss, [len(same)]])
    exact = tolerant = 0
    for i in range(len(edges) - 1):
        if edges[i] + 1 < at + SPAN and edges[i + 1] > at:
            exact = max(exact, int(edges[i + 1] - edges[i] - 1))
        j = min(i + 1 + substitutions, len(edges) - 1)
        if edges[i] + 1 < at + SPAN and edges[j] > at:
            tolerant = max(tolerant, int(edges[j] - edges[i] - 1))
    return exact, tolerant


def stretches(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, miss: np.ndarray, substitutions: int) -> tuple[int, int]:
    """As ``verify``, over all pieces [lo, hi) of one diagonal with hits at ``at`` and differing words at ``miss``."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    at, miss = np.unique(at), np.unique(miss)
    exact = tolerant = 0
    for a, b in zip(lo[first].tolist(), hi[np.r_[first[1:], len(lo)] - 1].tolist()):
        edges = np.r_[a - 1, miss[(miss >= a) & (miss < b)], b]
        for more in (0, substitutions):
            i = np.arange(len(edges) - 1)
            start, end = edges[i] + 1, edges[np.minimum(i + 1 + more, len(edges) - 1)]
            hit = np.r_[at, np.iinfo(np.int64).max][np.searchsorted(at, start - SPAN, side="right")]
            best = int((end - start)[hit < end].max(initial=0))
            exact, tolerant = max(exact, best) if more == 0 else exact, max(tolerant, best)
    return exact, tolerant


def _pair(doc: np.ndarray, item: np.ndarray, hits: list[np.ndarray], substitutions: int) -> tuple[int, int]:
    """Longest exact and near stretch of a cluster and an item over all diagonals with a hit."""
    if all((hits[j] == 1).all() for j in (2, 5)):
        start, end, shift = hits[0], hits[0] + SPAN, hits[3] - hits[0]
    else:
        h = np.array([x for six in zip(*(c.tolist() for c in hits)) for x in run_pairs(*six, SPAN)], np.int64)
        start, end, shift = h[:, 0], h[:, 1], h[:, 2] - h[:, 0]
    exact = near = 0
    for d in np.unique(shift).tolist():
        own = shift == d
        a, b = max(0, -d), min(len(doc), len(item) - d)
        miss = np.flatnonzero(doc[a:b] != item[a + d : b + d]) + a
        # a stretch that touches a run of hits touches one of them
        at = np.concatenate([np.r_[np.arange(s, e - SPAN, SPAN), e - SPAN] for s, e in zip(start[own].tolist(), end[own].tolist())])
        x, y = stretches(np.array([a]), np.array([b]), at, miss, substitutions)
        exact, near = max(exact, x), max(near, y)
    return exact, near


def overlaps(docs: DataFrame, items: DataFrame, substitutions: int = 2) -> DataFrame:
    """doc_id, item_id, exact_words, near_words of every pair with a hit.

    ``exact_words``: the longest run of equal words through a hit; ``near_words``:
    the longest stretch with at most ``substitutions`` differing words. Neither has a
    bound: between two hits of a diagonal all words are compared, and beyond the
    last one a stretch ends within SPAN * (substitutions + 1) words, as every exact
    run of SPAN words is a hit.
    """
    reach = SPAN * (substitutions + 1)
    e = durable(_clusters(items, "item_id", reach, None))
    item_hits = e.select(F.col("id").alias("item_id"), F.col("lo").alias("item_lo"), F.inline("hits")).withColumnsRenamed({"at": "at2", "step": "step2", "n": "n2"})
    keep = docs.sparkSession.sparkContext.broadcast(_filter(item_hits.select("seed").distinct()))
    d = durable(_clusters(docs, "doc_id", reach, keep))
    # one seed may stand in a third of all texts: its rows are dealt to SALT places, the fewer of the items copied to each
    salt = F.pmod(F.xxhash64("id", "lo"), F.lit(SALT)).cast("int")
    doc_hits = d.select(F.col("id").alias("doc_id"), "lo", salt.alias("salt"), F.inline("hits"))
    salted = item_hits.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    key = ["doc_id", "lo", "item_id", "item_lo"]
    hits = doc_hits.join(salted, ["mask", "seed", "salt"]).groupBy(*key).agg(F.collect_set(F.struct("at", "step", "n", "at2", "step2", "n2")).alias("hits"))
    pairs = hits.join(d.select(F.col("id").alias("doc_id"), "lo", F.col("words").alias("dw")), ["doc_id", "lo"])
    pairs = pairs.join(e.select(F.col("id").alias("item_id"), F.col("lo").alias("item_lo"), F.col("words").alias("ew")), ["item_id", "item_lo"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, six, dw, ew = batch.columns
            told = []
            for a, b, h in zip(dw, ew, six):
                columns = [c.to_numpy().astype(np.int64) for c in h.values.flatten()]
                told.append(_pair(a.values.to_numpy(), b.values.to_numpy(), columns, substitutions))
            yield pa.RecordBatch.from_arrays([doc, item, *(pa.array([t[i] for t in told], pa.int32()) for i in (0, 1))], names=["doc_id", "item_id", "exact_words", "near_words"])

    checked = pairs.select("doc_id", "item_id", "hits", "dw", "ew").mapInArrow(check, "doc_id long, item_id long, exact_words int, near_words int")
    return checked.groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max("near_words").alias("near_words"))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id where the document holds at least SPAN consecutive words of the item."""
    return overlaps(docs, items).filter(F.col("exact_words") >= SPAN).select("doc_id", "item_id")
