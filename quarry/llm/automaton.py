"""A suffix automaton over integer sequences."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts all substrings of the sequences added so far; every state knows
    the first sequence (by the number given with it) that has its substrings,
    if sequences are added in ascending order."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first = [-1]

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], number: int = 0) -> None:
        nxt, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
                continue
            cur = len(size)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            first.append(number)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._split(p, c, q)
            last = cur

    def matches(self, sequence: list[int], most: int) -> tuple[list[int], list[int]]:
        """Matching statistics: for each place, how long a suffix of what was
        read so far occurs in a sequence added (``most`` at most), and the first
        sequence it occurs in."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        state, length, out, where = 0, 0, [], []
        for c in sequence:
            q = nxt[state].get(c)
            while q is None and state:
                state = link[state]
                length = size[state]
                q = nxt[state].get(c)
            if q is not None:
                state = q
                length += 1
            while state and size[link[state]] >= most:
                state = link[state]
            if length > most:
                length = most
            out.append(length)
            where.append(first[state])
        return out, where
