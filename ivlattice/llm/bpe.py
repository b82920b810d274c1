"""Byte-pair encoding with a public vocabulary of ranks.

A piece of text becomes a doubly linked list of byte symbols and a priority queue
of the ranks of neighbouring pairs. The lowest rank is merged first; queue entries
whose symbols have changed since are skipped. A piece of n bytes costs
O(n log n), so a run of one million letters is no trap. Decoding concatenates
vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ivlattice.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The vocabulary travels to every task; a file beyond this size is refused.
MOST_VOCABULARY_BYTES = 64 << 20
#: Pieces remembered by a task, and the longest piece worth remembering.
MOST_REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return content


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # symbol i spans piece[i:end[i]]; end[i] is also its right neighbour; 0 marks a symbol that was merged away
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.append((r, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if mid == 0 or mid >= n or end[mid] != stop:
            continue  # stale: one of the two symbols has changed
        end[i], end[mid] = stop, 0
        if stop < n:
            left[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        before = left[i]
        if before >= 0:
            r = ranks.get(piece[before:stop])
            if r is not None:
                heapq.heappush(queue, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of short pieces up to a fixed number."""

    def __init__(self, content: bytes, pattern: str = PATTERN) -> None:
        self.ranks = parse_ranks(content)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def extend(self, text: str, ids: array) -> None:
        known, add = self.known, ids.extend
        for piece in self.pieces(text):
            got = known.get(piece)
            if got is None:
                got = tuple(merge(piece.encode("utf-8", "replace"), self.ranks))
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(known) >= MOST_REMEMBERED:
                        known.clear()
                    known[piece] = got
            add(got)

    def encode(self, text: str | None) -> list[int]:
        ids = array("i")
        self.extend(text or "", ids)
        return ids.tolist()


def decode(ids: list[int], content: bytes) -> str:
    strings = {i: b for b, i in parse_ranks(content).items()}
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


def decode_ids(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, text: the vocabulary's strings of the ids, one after the other.

    Null and empty lists give an empty text; bytes that are no UTF-8 are replaced; an
    id that the vocabulary lacks fails the query.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: b for b, i in parse_ranks(shared.value).items()}
        for batch in batches:
            texts = [b"".join(map(strings.__getitem__, one or ())).decode("utf-8", "replace") for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids array<int>; null and empty texts give an empty list.

    Texts stay where they are read, unless the scan has fewer splits than there are
    cores. Special tokens are not known to the vocabulary, so their names are
    ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids, ends = array("i"), [0]
            for t in batch.column(1):
                encoder.extend(t.as_py() or "", ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")
