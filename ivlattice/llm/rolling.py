"""Window hashes of many texts at once: polynomial prefix sums over code points, modulo 2**64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SALT1, _SALT2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _SALT1
    x = (x ^ (x >> np.uint64(27))) * _SALT2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n, kept per process."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more entry: the end)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def prefix(points: np.ndarray) -> np.ndarray:
    p, _ = powers(len(points) + 1)
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(scramble(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)], dtype=np.uint64, out=out[1:])
    return out


def window_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of points[start:end], equal for equal content wherever it stands."""
    _, inverse = powers(len(pre))
    return scramble((pre[end] - pre[start]) * inverse[start])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, in a few passes whatever w is."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(of: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry, step and number of places of each run of one seed at equal steps (periodic text).

    Entries are looked at in their order; ``of`` tells records apart.
    """
    n = len(of)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.r_[False, (of[1:] == of[:-1]) & (seed[1:] == seed[:-1])]
    step = np.where(same, np.diff(place, prepend=place[:1]), 0)
    # an entry goes on with a run if it is the second of it or keeps its step
    new = ~same | (np.r_[False, same[:-1]] & (step != np.r_[0, step[:-1]]))
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, n])
    return first, np.where(count > 1, step[np.minimum(first + 1, n - 1)], 0), count


def run_pairs(p: int, d: int, n: int, q: int, d2: int, n2: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, partner_start) of two runs of one seed of length k, one for each diagonal if their steps are equal."""
    if n > 1 and n2 > 1 and d == d2 and d <= k:
        for j in range(1 - n, n2):
            at = max(0, -j)
            yield p + at * d, p + (min(n, n2 - j) - 1) * d + k, q + (at + j) * d
    else:
        for x in range(p, p + n * max(d, 1), max(d, 1)):
            for y in range(q, q + n2 * max(d2, 1), max(d2, 1)):
                yield x, x + k, y
