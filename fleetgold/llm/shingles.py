"""Shingles, their 64-bit hashes and MinHash signatures, for many texts at once in numpy.

Equal shingles have equal hashes; different ones differ but for a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from fleetgold.llm.common import mix, seeds

BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base's inverse modulo 2**64.
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True

#: Scrambled code points of the first plane.
_COMMON = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))

_powers = {1: np.ones(1, np.uint64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _powers[int(base)] = np.cumprod(steps)
    return known[:n]


def _windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` items of each text, and how many each has; a shorter text is one run.

    A run's hash is the sum of its items times powers of the base. Runs of 2, 4, 8, ... items come from two of half
    the length, and a run of any length from those.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    # Every place of the whole array first, in order; then those where a run begins.
    half, long = np.concatenate([hashes, np.zeros(size, np.uint64)]), 1
    sums, done = None, 0
    while done < size:
        if size & long:
            part = half[done : done + len(hashes)]
            sums = part if sums is None else sums + part * _power(BASE, size + 1)[done]
            done += long
        if done < size:
            raised = half[long:] * _power(BASE, size + 1)[long]
            raised += half[:-long]
            half = raised
            long *= 2
    begins = np.ones(len(hashes), bool)
    whole, less = counts >= size, (counts > 0) & (counts < size)
    begins[(ends[whole][:, None] - np.arange(1, size)).ravel()] = False
    for i in np.flatnonzero(less):
        begins[starts[i] + 1 : ends[i]] = False
    out = sums[begins]
    out += np.uint64(size)
    place = np.cumsum(made) - made
    for i in np.flatnonzero(less):  # one run, shorter
        at, n = starts[i], counts[i]
        out[place[i]] = (hashes[at : at + n] * _power(BASE, n)).sum(dtype=np.uint64) + np.uint64(n)
    return mix(out), made


def word_shingles(texts: Sequence[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, one after the other, and their number per text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = SPACE[data]
    inside = ~space
    begins = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)))])
    words = mix((sums[ends] - sums[begins]) * _power(BACK, len(data))[begins])
    borders = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(begins, borders)]))
    return _windows(words, counts, size)


def char_shingles(texts: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for shingles of characters."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if chars.max(initial=0) < len(_COMMON):
        mixed = _COMMON[chars]
    else:
        mixed = mix(chars.astype(np.uint64) + np.uint64(1))
    return _windows(mixed, np.array([len(t) for t in texts], np.int64), size)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int, piece: int = 1 << 16) -> np.ndarray:
    """``n`` MinHash values (unsigned 32-bit) for every text that has shingles.

    The hashes are scrambled already, so a product with an odd number is one more order of them.
    Works through the shingles in pieces that stay in cache; a text may span pieces.
    """
    counts = counts[counts > 0]
    out = np.full((n, len(counts)), 0xFFFFFFFF, np.uint32)
    if not len(counts):
        return out.T
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    factors = (seeds(n, 7) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    ends = np.cumsum(counts)
    starts = ends - counts
    room = np.empty(piece, np.uint32)
    for a in range(0, len(low), piece):
        part = low[a : a + piece]
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part), "left")
        cuts = np.maximum(starts[first:last] - a, 0)
        view = room[: len(part)]
        for k in range(n):
            np.multiply(part, factors[k], out=view)
            row = out[k, first:last]
            np.minimum(row, np.minimum.reduceat(view, cuts), out=row)
    return out.T


def sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text."""
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def banded(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit number for the values of each band of each text."""
    texts, n = values.shape
    grouped = values.astype(np.uint64).reshape(texts, bands, n // bands) + np.uint64(1)
    out = np.zeros((texts, bands), np.uint64)
    for k in range(n // bands):
        out = mix(out + grouped[:, :, k])
    return out
