"""Vectorised window sampling over flat sequences: hashes, words, anchors.

Every window of ``length`` elements is represented by its anchor, the k-gram
in it with the smallest hash (leftmost of equals).  Equal windows have equal
anchors at equal places, so two windows need comparing only where their
anchors are equal.  Consecutive windows with one anchor form a run; the
elements that a run's windows span are its context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Elements scanned at a time; places must fit the low bits of a sort key.
PIECE = 1 << 19
_PLACE = np.uint64(24)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = (n + 0xFFFF) >> 16 << 16
            inverse = pow(int(_BASE), -1, 1 << 64)
            for name, base in (("up", int(_BASE)), ("down", inverse)):
                seq = np.full(size, np.uint64(base))
                seq[0] = 1
                setattr(cls, name, np.multiply.accumulate(seq))
        return cls.up, cls.down


class Sums:
    """Prefix sums that give the hash of any stretch of a sequence."""

    def __init__(self, elements: np.ndarray):
        n = len(elements)
        up, self.down = _Powers.upto(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(elements * up[:n], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * _STEP)

    def grams(self, k: int) -> np.ndarray:
        t = self.total
        return mix((t[k:] - t[:-k]) * self.down[: len(t) - k])


def byte_elements(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and each document's first word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[raw]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    head[edge] |= solid[edge]
    tail[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, off)


def word_elements(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Sums(byte_elements(raw)).of(starts, ends)


def window_hashes(elements: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window at each of some places."""
    return Sums(mix(elements)).of(starts, starts + length)


@dataclass
class Runs:
    """Runs of windows with one anchor: document (row), first window in it,
    windows, hashes of the anchor and of the context."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    n = len(key) - w + 1
    blocks = -(-len(key) // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _piece(elements: np.ndarray, off: np.ndarray, length: int, gram: int) -> Runs | None:
    size = np.diff(off) - length + 1
    rows = np.flatnonzero(size > 0)
    if not len(rows):
        return None
    size = size[rows]
    sums = Sums(elements)
    grams = sums.grams(gram)
    key = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _window_minima(key, length - gram + 1)
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(off[rows] - (ends - size), size)
    least = least[at]
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    a, count = at[first], np.diff(np.append(first, len(least)))
    row = rows[np.searchsorted(ends, first, "right")]
    place = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return Runs(row, a - off[row], count, grams[place], sums.of(a, a + count - 1 + length))


def runs(elements: np.ndarray, off: np.ndarray, length: int, gram: int, piece: int = PIECE) -> list[Runs]:
    """Runs of all windows of every document of a flat batch.

    A batch above ``piece`` elements is cut; pieces of one document overlap by
    a window less one element, so that each window lies in exactly one.
    """
    if off[-1] <= piece:
        found = _piece(elements, off, length, gram)
        return [found] if found is not None else []
    out = []
    for i in range(len(off) - 1):
        at = int(off[i])
        while at < off[i + 1]:
            to = min(at + piece, int(off[i + 1]))
            found = _piece(elements[at:to], np.array([0, to - at]), length, gram)
            if found is not None:
                found.row[:] = i
                found.start += at - int(off[i])
                out.append(found)
            if to == off[i + 1]:
                break
            at = to - length + 1
    return out
