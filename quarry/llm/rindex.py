"""A run-length index: run-compressed Burrows-Wheeler transform of a
collection, with suffix-array samples at the ends of runs.

For the place i of a text, let before(i) be the start of the suffix that
precedes suffix i in sorted order and common(i) the length both share.  Unless
i is sampled at the start of a run, the two suffixes have equal letters in
front, so before(i) = before(i - 1) + 1 and common(i) = common(i - 1) - 1: both
follow from the closest sample at or left of i.  Streaming the collection over
its samples thus yields its matching statistics with itself, from as many
values as the transform has runs.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling, in which only suffixes that still have equals
    are sorted again; a text that ends is smaller than one that goes on."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length() + 1)
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key[: max(0, n - j)] |= symbols[j:] + 1
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    # A suffix's rank is where its group of equals begins.
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, size)
    live = np.flatnonzero(np.repeat(size > 1, size))
    have = width
    while len(live):
        own = order[live]
        after = own + have
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own] * np.int64(n + 1) + second
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[live] = own
        new = np.ones(len(live), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(live)))
        rank[own] = np.repeat(live[at], size)
        live = live[np.repeat(size > 1, size)]
        have *= 2
    return order


class RunIndex:
    """Samples of a collection of byte strings, each closed by its own end."""

    def __init__(self, parts: list[bytes]):
        m = len(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + m
        text = np.empty(n, np.int32)
        closes = self.starts + sizes
        inner = np.ones(n, bool)
        inner[closes] = False
        text[inner] = raw.astype(np.int32) + m
        text[closes] = np.arange(m)
        # End marks are one letter for the order (what follows them then
        # orders suffixes that end alike), and each its own in front of a suffix.
        order = suffix_order(np.maximum(text - (m - 1), 0))
        letters = text[order - 1]  # place 0 wraps to the last end mark
        head = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
        self.n, self.letters = n, letters[head]
        self.lengths = np.diff(np.append(head, n))
        # Samples, by place: the first suffix of each run and, before it, the
        # last of the run above.
        place, above = order[head], np.concatenate(([-1], order[head[1:] - 1]))
        by = np.argsort(place)
        self.place, self.above = place[by], above[by]
        self.common = self._shared(text, self.place, self.above)

    @staticmethod
    def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at a and b share."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        x, y = a[live], b[live]
        while len(live):
            # No two suffixes are equal and none runs past its end mark, so
            # places stay within the text while letters agree.
            same = text[x] == text[y]
            live, x, y = live[same], x[same] + 1, y[same] + 1
            out[live] += 1
        return out

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place: before(i), and the length shared with it."""
        at = np.arange(self.n)
        near = np.searchsorted(self.place, at, "right") - 1
        gone = at - self.place[near]
        before = np.where(self.above[near] >= 0, self.above[near] + gone, -1)
        return before, np.maximum(self.common[near] - gone, 0)


def first_places(index: RunIndex, length: int, rank: np.ndarray) -> np.ndarray:
    """For every place, the least rank of the places whose next ``length``
    letters equal its own (its own rank, if an end mark is nearer)."""
    before, common = index.stream()
    jump = np.where(common >= length, before, np.arange(index.n))
    # Equal windows are neighbours in sorted order: double along the chain to
    # its head, collect the least rank there and hand it down.
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    low = np.full(index.n, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(low, jump, rank)
    return low[jump]
