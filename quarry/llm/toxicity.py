"""Toxicity by a string-subsequence kernel with Nystroem landmarks.

The kernel compares words by the runs of four letters they have in common in
the same order: these may stretch over up to ``SPAN`` + 1 places, each place of
gap costs a factor ``DECAY``, and a word's ends count as letters.  Letters
lose case, common digit stand-ins become letters, other signs inside a word fall
away, letters spelled out one by one join, and a word of one or two letters is
also read together with the word behind it, so gapped and padded spellings stay
close to the plain word.  A word that the kernel finds near an insult is also read
with each of its letters left out, so that one letter put into an insult or written
twice changes nothing, unless clean texts have the word.  The accented letters of the corpus' languages are
letters of their own, other accents fall away.

A support vector machine on the Nystroem map of some landmark words is trained
as for bags: a toxic text has at least one toxic word, a clean text hardly any.
Its first witnesses are the words that, or whose beginnings, are far more frequent
in toxic texts than chance explains; then those of the toxic texts' words join that the machine takes
for toxic.  Witnesses and clean words are its examples; witnesses, landmarks
(the most frequent witnesses, those least like the others, and the hardest clean
words) and the hardest clean words are chosen anew after each fit.  As the
kernel is a dot product of subsequence weights, landmarks and machine collapse
into one weight per subsequence: a word's score is a sum of table entries.  A
text's score is that of its ``WORST`` worst distinct words, squared, so that one
very telling word counts as much as several less telling ones, as a probability
by logistic calibration for the corpus' mixture of toxic and clean texts, moved so
that ``THRESHOLD`` stands for even odds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices

DECAY = 0.6
SPAN = 5
CLASSES = 40
SIZE = CLASSES**4
LANDMARKS = 640
#: Labelled texts of either class the model is fitted on at most, those with
#: the smallest hash of their id.
PER_CLASS = 1500
#: Labelled texts of more characters are left out of the fit, which bounds what
#: the driver holds of the others: their distinct words.
FIT_CHARS = 20_000
#: Distinct clean words among the examples at most: half evenly spaced in hash
#: order, half those that look worst.
CLEAN_WORDS = 8_000
ROUNDS = 2
#: Words of a text, worst first, that its score is made of.
WORST = 3
#: Score from which a word is also read with one letter left out, and letters that
#: are to stay (chosen by cross-validation on learnable labels).
NEAR, REST = 1.2, 4
THRESHOLD = 0.7
#: Digits and signs commonly written for letters (fixed values).
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Letters with a class of their own, some together (fixed values).
OWN_CLASSES = ["é", "è", "êë", "à", "âá", "ä", "ö", "óô", "ü", "ûùú", "íîï", "ñç", "ß"]
_OFFSETS = [(a, b, c) for c in range(3, SPAN + 1) for b in range(2, c) for a in range(1, b)]
_LETTERS = 0x3000


def _letter_classes() -> np.ndarray:
    """Class of each character: 1 to 26 for plain Latin letters, 27 to 39 for
    the accented letters above and, by their number, for other letters; 0 for
    what falls away, 255 for white space."""
    out = np.zeros(_LETTERS + 1, np.uint8)
    own = {c: 27 + i for i, group in enumerate(OWN_CLASSES) for c in group}
    for c in range(_LETTERS):
        ch = STAND_INS.get(chr(c), chr(c)).lower()
        base = unicodedata.normalize("NFD", ch)[0]
        if ch.isspace():
            out[c] = 255
        elif ch in own:
            out[c] = own[ch]
        elif "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif ch.isalpha():
            out[c] = 27 + c % 13
    out[_LETTERS] = 39
    return out


_CLASS = _letter_classes()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, where words start (and the end), and the first
    word of each text (and the end)."""
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    cls = _CLASS[np.minimum(raw, _LETTERS)]
    # A text begins a word whatever it begins with.
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    solid = (cls != 255) & (cls != 0)
    gap = np.cumsum(cls == 255)
    at = np.flatnonzero(solid)
    # Of a letter written over and over, two remain.
    again = np.zeros(len(at), bool)
    again[2:] = (cls[at[2:]] == cls[at[1:-1]]) & (cls[at[2:]] == cls[at[:-2]]) & (gap[at[2:]] == gap[at[:-2]])
    at = at[~again]
    gaps = gap[at]
    new = np.ones(len(at), bool)
    new[1:] = gaps[1:] != gaps[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(at)))
    # Letters spelled out one by one: a one-letter word joins a one-letter
    # word right before it in the same text.
    single = size == 1
    where = at[starts]
    text = np.searchsorted(begins, where, "right") - 1
    join = np.zeros(len(starts), bool)
    join[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    starts, text = starts[~join], text[~join]
    return _with_joined(cls[at], np.append(starts, len(at)), text, len(texts))


def _with_joined(letters: np.ndarray, starts: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Behind each word of one or two letters, that word and the next as one."""
    size = np.diff(starts)
    short = np.flatnonzero((size[:-1] <= 2) & (text[1:] == text[:-1])) if len(size) > 1 else np.zeros(0, np.int64)
    if len(short):
        copies = np.ones(len(size), np.int64)
        copies[short] += 1
        of = np.repeat(np.arange(len(size)), copies)
        second = np.zeros(len(of), bool)
        second[1:] = of[1:] == of[:-1]
        own = size[of] + np.where(second, size[np.minimum(of + 1, len(size) - 1)], 0)
        ends = np.cumsum(own)
        inner = np.arange(ends[-1]) - np.repeat(ends - own, own)
        letters = letters[np.repeat(starts[:-1][of], own) + inner]
        starts, text = np.concatenate(([0], ends)), text[of]
    return letters, starts, np.searchsorted(text, np.arange(n + 1))


def distinct(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each distinct word, and of which distinct word each is; words
    are compared letter by letter."""
    raw, edges = letters.tobytes(), starts.tolist()
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(edges, edges[1:], strict=False)), np.int64, len(edges) - 1)
    first = np.empty(len(known), np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    return first, of


def _spelled(letters: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen words, each between two end marks (class 0), in one row."""
    size = np.diff(starts)[chosen] + 2
    ends = np.cumsum(size)
    row = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    inner = np.ones(len(row), bool)
    inner[ends - 1] = False
    inner[ends - size] = False
    word = np.repeat(np.arange(len(chosen)), size - 2)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    row[inner] = letters[starts[:-1][chosen][word] + place]
    return row, np.concatenate(([0], ends))


def subsequences(row: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of gaps: words, four-letter subsequences, weight of one."""
    word = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for a, b, c in _OFFSETS:
        n = len(row) - c
        if n > 0:
            i = np.flatnonzero(word[:n] == word[c:])
            yield word[i], ((row[i] * CLASSES + row[i + a]) * CLASSES + row[i + b]) * CLASSES + row[i + c], DECAY ** (c - 3)


def lengths(edges: np.ndarray) -> np.ndarray:
    """The norm of a word's weights, all its subsequences taken as distinct."""
    n = np.diff(edges)
    out = np.zeros(len(n))
    for _, _, c in _OFFSETS:
        out += np.maximum(n - c, 0) * DECAY ** (2 * (c - 3))
    return np.sqrt(np.maximum(out, 1e-9))


def _pieces(row: np.ndarray, edges: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some words at a time."""
    for i in range(0, len(edges) - 1, n):
        own = edges[i : i + n + 1]
        yield row[own[0] : own[-1]], own - own[0]


def word_scores(row: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Normalised sum of the table's entries over each word's subsequences."""
    parts = [np.zeros(0)]
    for own, own_edges in _pieces(row, edges, 20_000):
        out = np.zeros(len(own_edges) - 1)
        for word, sub, weight in subsequences(own, own_edges):
            out += weight * np.bincount(word, table[sub], len(out))
        parts.append(out / lengths(own_edges))
    return np.concatenate(parts)


def _shortened(row: np.ndarray, edges: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen words with each of their letters left out in turn, between end
    marks, and which word each comes from.  Of a letter written twice one is."""
    size = np.diff(edges)[chosen]
    of = np.repeat(np.arange(len(chosen)), size - 2)
    ends = np.cumsum(size - 2)
    left_out = 1 + np.arange(len(of)) - np.repeat(ends - (size - 2), size - 2)
    first = edges[:-1][chosen][of]
    new = row[first + left_out] != row[first + left_out - 1]
    of, left_out, first = of[new], left_out[new], first[new]
    own = size[of] - 1
    ends = np.cumsum(own)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - own, own)
    place += place >= np.repeat(left_out, own)
    return row[np.repeat(first, own) + place], np.concatenate(([0], ends)), of


def _written(row: np.ndarray, edges: np.ndarray, chosen: np.ndarray) -> list[bytes]:
    raw = row.astype(np.uint8)
    return [raw[a + 1 : b - 1].tobytes() for a, b in zip(edges[:-1][chosen].tolist(), edges[1:][chosen].tolist(), strict=True)]


@dataclass(frozen=True)
class Tolerance:
    """What a word may be but for one letter: words that the machine was shown as
    insults.  Words of clean texts that are so by chance are exempt."""

    insults: frozenset[bytes] = frozenset()
    exempt: frozenset[bytes] = frozenset()


def tolerant_scores(row: np.ndarray, edges: np.ndarray, table: np.ndarray, tolerance: Tolerance) -> np.ndarray:
    """Scores of words, each the best of its own and those it has with one letter
    left out if that leaves an insult, so that a letter put into one, or written
    twice, changes nothing.  Only words that the kernel finds near one by the gapped
    subsequences which the letter leaves are looked at so."""
    out = word_scores(row, edges, table)
    near = np.flatnonzero((out >= NEAR) & (np.diff(edges) - 3 >= REST)) if tolerance.insults else np.zeros(0, np.int64)
    near = near[[w not in tolerance.exempt for w in _written(row, edges, near)]] if len(near) else near
    for at in range(0, len(near), 4000):
        some = near[at : at + 4000]
        views, view_edges, of = _shortened(row, edges, some)
        fits = np.flatnonzero([w in tolerance.insults for w in _written(views, view_edges, np.arange(len(of)))])
        if len(fits):
            size = np.diff(view_edges)[fits]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size, size)
            chosen = views[np.repeat(view_edges[:-1][fits], size) + place]
            np.maximum.at(out, some[of[fits]], word_scores(chosen, np.concatenate(([0], ends)), table))
    return out


class Landmarks:
    """Kernel values against some words, through their few subsequences; some
    words at a time, as each has few of all their subsequences."""

    TOGETHER = 64

    def __init__(self, row: np.ndarray, edges: np.ndarray):
        self.parts = []
        for own, own_edges in _pieces(row, edges, self.TOGETHER):
            found = list(subsequences(own, own_edges))
            known = np.unique(np.concatenate([s for _, s, _ in found]))
            weights = np.zeros((len(known) + 1, len(own_edges) - 1), np.float32)
            for word, sub, weight in found:
                np.add.at(weights, (np.searchsorted(known, sub) + 1, word), weight)
            self.parts.append((known, weights / lengths(own_edges).astype(np.float32)))
        self.place = np.zeros(SIZE, np.int32)

    def kernel(self, row: np.ndarray, edges: np.ndarray) -> np.ndarray:
        out = []
        for own, own_edges in _pieces(row, edges, 2000):
            found, size = list(subsequences(own, own_edges)), lengths(own_edges).astype(np.float32)[:, None]
            columns = []
            for known, weights in self.parts:
                self.place[known] = np.arange(1, len(known) + 1)
                part = np.zeros((len(own_edges) - 1, weights.shape[1]), np.float32)
                for word, sub, weight in found:
                    at = self.place[sub]
                    some = np.flatnonzero(at)
                    word, at = word[some], at[some]
                    if len(word):
                        head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                        part[word[head]] += np.float32(weight) * np.add.reduceat(weights[at], head, axis=0)
                self.place[known] = 0
                columns.append(part / size)
            out.append(np.concatenate(columns, 1))
        return np.concatenate(out)

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """One weight per subsequence for a combination of the landmarks."""
        out, at = np.zeros(SIZE, np.float32), 0
        for known, weights in self.parts:
            out[known] += weights[1:] @ alpha[at : at + weights.shape[1]].astype(np.float32)
            at += weights.shape[1]
        return out


def worst_of(score: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The ``WORST`` highest scores of each text, squared (0 for none above 0),
    from those of its words."""
    n = len(firsts) - 1
    out = np.zeros((n, WORST))
    text = np.repeat(np.arange(n), np.diff(firsts))
    order = np.lexsort((-score, text))
    place = np.arange(len(order)) - firsts[text[order]]
    some = place < WORST
    out[text[order][some], place[some]] = np.maximum(score[order][some], 0) ** 2
    return out


@dataclass
class Model:
    """A weight per subsequence, and the calibration of a text's worst words."""

    table: np.ndarray
    slope: np.ndarray
    shift: float
    tolerance: Tolerance = Tolerance()
    #: How likely a text is toxic whose words say nothing, and clean though they
    #: say it is toxic.
    floor: float = 0.0
    chance: float = 0.0
    #: Added to the log odds: a class of which few were taken weighs more, and the
    #: threshold stands for even odds.
    moved: float = 0.0

    def worst(self, texts: list[str]) -> np.ndarray:
        letters, starts, firsts = words_of(texts)
        if len(starts) < 2:
            return np.zeros((len(texts), WORST))
        first, of = distinct(letters, starts)
        row, edges = _spelled(letters, starts, first)
        # Each distinct word of a text once.
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        pairs = np.unique(text * np.int64(len(first)) + of)
        text, of = pairs // len(first), pairs % len(first)
        return worst_of(tolerant_scores(row, edges, self.table, self.tolerance)[of], np.searchsorted(text, np.arange(len(texts) + 1)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is toxic."""
        p = self.probability(self.worst(texts))
        return 1 / (1 + (1 - p) / np.maximum(p, 1e-12) * np.exp(-self.moved))

    def probability(self, worst: np.ndarray) -> np.ndarray:
        seen = 1 / (1 + np.exp(-np.clip(worst @ self.slope + self.shift, -50, 50)))
        return self.floor + (1 - self.chance - self.floor) * seen


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, margin: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Support vector machine with squared losses by Newton steps; the last
    column of x is the constant.  A negative example is to lie below minus its
    margin (hinge), a positive one within ``TUBE`` above its margin."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(rounds):
        f = x @ w
        over = (y > 0) & (f > margin + TUBE)
        active = (y * f < margin) | over
        xa = x[active]
        weighted = xa * cost[active][:, None].astype(xa.dtype)
        target = y * margin + np.where(over, TUBE, 0)
        step = np.linalg.solve(ridge + weighted.T @ xa, weighted.T @ target[active])
        if np.abs(step - w).max() < 1e-5:
            break
        w = step
    return w


def _logistic(x: np.ndarray, target: np.ndarray, w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft targets, none but the last below
    zero: projected Newton steps, halved while they do not help."""

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -50, 50)
        return float(np.sum(np.logaddexp(0, z) - target * z) + 5e-3 * w @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (target - p) - 1e-2 * w
        free = (w > 0) | (slope > 0)
        free[-1] = True
        h = (x[:, free] * (p * (1 - p) + 1e-9)[:, None]).T @ x[:, free] + 1e-2 * np.eye(int(free.sum()))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h, slope[free])
        size = 1.0
        while size > 1e-4:
            new = w + size * step
            new[:-1] = np.maximum(new[:-1], 0)
            if (after := loss(new)) < now - 1e-9:
                break
            size /= 2
        else:
            break
        w, now = new, after
    return w


#: Most of the texts that show no sign of being toxic, and of those that do, that
#: the calibration may take to be labelled otherwise.
MOST_FLOOR, MOST_CHANCE = 0.3, 0.05


def _platt(margin: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, float, float]:
    """Logistic slopes (a worse word's at least that of the next) and shift, with
    Platt's softened targets; the share of toxic texts among those that show no
    sign of it, and of clean ones among those that do.

    Whether a text shows it is a hidden variable: a toxic text may have words the
    machine does not know, a clean one may have an insult's letters by chance.
    Expectation maximisation tells these apart, so that they do not flatten the
    slopes.
    """
    pos, neg = y.sum(), (~y).sum()
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    x = np.concatenate((np.cumsum(margin, axis=1), np.ones((len(margin), 1))), 1)
    w, shown, k = np.zeros(x.shape[1]), y.astype(float), x.shape[1] - 1
    floor, chance = 0.01, 0.01
    for _ in range(rounds):
        w = _logistic(x, low + (high - low) * shown, w)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        shown = np.where(y, p * (1 - chance) / np.maximum(p * (1 - chance) + (1 - p) * floor, 1e-12), p * chance / np.maximum(p * chance + (1 - p) * (1 - floor), 1e-12))
        floor = min(MOST_FLOOR, (1 - shown)[y].sum() / max(1.0, (1 - shown).sum()))
        chance = min(MOST_CHANCE, shown[~y].sum() / max(1.0, shown.sum()))
    return np.cumsum(w[:k][::-1])[::-1], float(w[k]), float(floor), float(chance)


#: A witness is at least this much more frequent, by share of texts, in toxic
#: texts than in clean ones.
PURE = 4


def _telling(hits: np.ndarray, misses: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio for being more frequent in toxic texts, less the
    log of the number of candidates: positive where chance is no explanation
    though all were looked at.  Minus infinity where not nearly pure."""
    total = hits + misses

    def part(k: np.ndarray, n: int) -> np.ndarray:
        want = np.maximum(total * n / (n_toxic + n_clean), 1e-9)
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / want), 0)

    value = part(hits, n_toxic) + part(misses, n_clean) - np.log(max(1, np.count_nonzero(total > 1)))
    return np.where(_pure(hits, misses, n_toxic, n_clean), value, -np.inf)


#: A witness' margin: its log odds less the first number, by the second, within
#: these bounds, and how far above it may lie.
ODDS, MARGINS, TUBE = (2.0, 1.6), (0.4, 3.0), 0.25


def _pure(hits: np.ndarray, misses: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return (hits > 0) & (hits * n_clean > PURE * misses * n_toxic)


#: Letters of the word beginnings that may tell, beside whole words.
FRONTS = (4, 5, 6, 7)


def _evidence(raw: bytes, edges: np.ndarray, of: np.ndarray, bag: np.ndarray, toxic: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """By distinct word: the most telling of itself and its beginnings, each
    counted by the texts that have it."""
    n, at = len(edges) - 1, edges.tolist()
    best = np.full(n, -np.inf)
    for size in (*FRONTS, 0):
        known: dict[bytes, int] = {}
        own = np.full(n, -1)
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if not size or b - a - 2 > size:
                key = raw[a : a + 1 + size] if size else raw[a:b]
                own[i] = known.setdefault(key, len(known))
        pairs = np.unique(bag * np.int64(len(known) + 1) + own[of] + 1)
        owner, key = pairs // (len(known) + 1), pairs % (len(known) + 1)
        owner, key = owner[key > 0], key[key > 0] - 1
        hits = np.bincount(key[toxic[owner]], minlength=len(known))
        misses = np.bincount(key[~toxic[owner]], minlength=len(known))
        value = np.append(_telling(hits, misses, *sizes), -np.inf)
        best = np.maximum(best, value[own])
    return best


def _spread(kernel: np.ndarray, n: int) -> np.ndarray:
    """Rows one after another, each least like those before it."""
    chosen, near = [], np.full(len(kernel), -np.inf)
    for _ in range(min(n, len(kernel))):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, kernel[chosen[-1]])
        near[chosen[-1]] = np.inf
    return np.array(chosen, np.int64)


def fit(bags: list[tuple[bytes, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from bags: the distinct words of a text (letters by class, a
    zero byte after each) and its label.  A clean and a toxic bag stand for so many
    texts of the corpus, whose mixture probabilities are about.

    A machine that has not seen a fourth of either class's texts calibrates on
    these; the one that is used has seen all.
    """
    toxic = np.array([y for _, y in bags], bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(SIZE, np.float32), np.zeros(WORST), 4.0 if len(bags) and toxic.all() else -4.0)
    flat = np.frombuffer(b"".join(b for b, _ in bags), np.uint8)
    ends = np.flatnonzero(flat == 0)
    letters = flat[flat != 0]
    starts = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
    counts = np.array([b.count(0) for b, _ in bags])
    first, of = distinct(letters, starts)
    row, edges = _spelled(letters, starts, first)
    words = Words(row, edges, of, np.repeat(np.arange(len(bags)), counts))
    aside = np.zeros(len(bags), bool)
    for y in (True, False):
        aside[np.flatnonzero(toxic == y)[3::4]] = True
    at = np.concatenate(([0], np.cumsum(counts)))
    use = aside if toxic[aside].any() and (~toxic[aside]).any() else np.ones(len(bags), bool)
    every = np.ones(len(bags), bool)
    (unseen, insults), (table, known) = _machine(words, toxic, ~aside), _machine(words, toxic, every)
    worst = worst_of(tolerant_scores(row, edges, unseen, _tolerance(words, toxic, ~aside, unseen, insults))[of], at)[use]
    slope, shift, floor, chance = _platt(worst, toxic[use])
    # The threshold is where a text of the corpus is as likely toxic as not.
    moved = float(np.log(stands_for[1] / stands_for[0]) + np.log(THRESHOLD / (1 - THRESHOLD)))
    return Model(table, slope, shift, _tolerance(words, toxic, every, table, known), floor, chance, moved)


def _tolerance(words: Words, toxic: np.ndarray, use: np.ndarray, table: np.ndarray, insults: frozenset[bytes]) -> Tolerance:
    """The insults, and the words of clean texts in use, of no toxic one, that are
    one but for a letter."""
    n, learn = len(words.edges) - 1, use[words.bag]
    of, bag = words.of[learn], words.bag[learn]
    clean = (np.bincount(of[~toxic[bag]], minlength=n) > 0) & (np.bincount(of[toxic[bag]], minlength=n) == 0)
    raised = tolerant_scores(words.row, words.edges, table, Tolerance(insults)) > word_scores(words.row, words.edges, table)
    return Tolerance(insults, frozenset(_written(words.row, words.edges, np.flatnonzero(clean & raised))))


@dataclass
class Words:
    """Distinct words between end marks, and which of them each text has."""

    row: np.ndarray
    edges: np.ndarray
    of: np.ndarray
    bag: np.ndarray

    def spelled(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(self.edges)[chosen]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return self.row[np.repeat(self.edges[:-1][chosen], size) + place], np.concatenate(([0], ends))


def _machine(words: Words, toxic: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, frozenset[bytes]]:
    """The weight of each subsequence, from the texts in use, and the insults: first
    witnesses that tell as whole words."""
    n, table = len(words.edges) - 1, np.zeros(SIZE, np.float32)
    learn = use[words.bag]
    of, bag = words.of[learn], words.bag[learn]
    in_clean, in_toxic = np.bincount(of[~toxic[bag]], minlength=n), np.bincount(of[toxic[bag]], minlength=n)
    sizes = int((toxic & use).sum()), int((~toxic & use).sum())
    score, limit = _evidence(words.row.astype(np.uint8).tobytes(), words.edges, of, bag, toxic, sizes), 0.0
    open_words = _pure(in_toxic, in_clean, *sizes)
    # The more evidence for a word, the wider its margin.
    odds = np.log((in_toxic + 0.5) / (in_clean + 0.5) * (sizes[1] / max(1, sizes[0])))
    odds = np.clip((odds - ODDS[0]) / ODDS[1], *MARGINS)
    if not (score > 0).any():
        limit = score[open_words].max(initial=-np.inf)
    clean = np.flatnonzero((in_clean > 0) & ~open_words)
    seeds = np.flatnonzero(open_words & (score >= limit) & (score > -np.inf))
    witness = seeds
    insults = frozenset(_written(words.row, words.edges, seeds[_telling(in_toxic, in_clean, *sizes)[seeds] > 0]))
    for last in range(ROUNDS - 1, -1, -1):
        if not len(witness) or not len(clean):
            return table, insults
        even = clean[np.linspace(0, len(clean) - 1, min(len(clean), CLEAN_WORDS // 2)).astype(int)]
        hard = clean[np.argsort(-score[clean], kind="stable")][: CLEAN_WORDS // 2]
        own = np.union1d(even, hard)
        many = witness[np.lexsort((witness, -in_toxic[witness]))]
        # Landmarks: frequent witnesses, then those least like them, and clean words.
        half, fewer = LANDMARKS * 5 // 16, LANDMARKS * 3 // 16
        apart = many[: LANDMARKS * 2]
        apart = apart[_spread(Landmarks(*words.spelled(apart)).kernel(*words.spelled(apart)), half)]
        marks = np.unique(np.concatenate((many[:half], apart, hard[:fewer], even[:: max(1, len(even) // fewer)][:fewer])))
        land = Landmarks(*words.spelled(marks))
        kernel = land.kernel(*words.spelled(marks)).astype(np.float64)
        value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
        root = vector * (1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
        examples = np.concatenate((witness, own))
        x = land.kernel(*words.spelled(examples)) @ root.astype(np.float32)
        y = np.where(np.arange(len(examples)) < len(witness), 1.0, -1.0)
        margin = np.where(y > 0, odds[examples], 1.0)
        cost = np.where(y > 0, 10.0 * max(1.0, len(own) / len(witness)) ** 0.5, 10.0)
        w = _svm(np.concatenate((x, np.ones((len(x), 1), np.float32)), 1), y, cost, margin)
        table = land.table(root @ w[:-1])
        if last:
            # Words of toxic texts that the machine takes for toxic join.
            score, limit = word_scores(words.row, words.edges, table), -w[-1]
            witness = np.union1d(seeds, np.flatnonzero(open_words & (score >= limit)))
    return table, insults


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            out = []
            for text in batch.column("text").to_pylist():
                letters, starts, _ = words_of([text])
                first, _ = distinct(letters, starts) if len(starts) > 1 else (np.zeros(0, int), None)
                out.append(b"".join(letters[starts[i] : starts[i + 1]].tobytes() + b"\0" for i in first.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bag"])


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows that are not held out.

    At most ``per_class`` ids of either label are taken, by hash; the distinct
    words of those of their texts that have at most ``FIT_CHARS`` characters,
    found where the texts lie, come to the driver.  Rows without an id or a label
    of 0 or 1 do not count; of an id labelled twice the label 1 does.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Two times per_class rows of two numbers: a bound for the broadcast.
    picked = doc_rows(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    bags = picked.where(F.length("text") <= FIT_CHARS).mapInArrow(_bags, "doc_id long, bag binary")
    label = {r.doc_id: r.toxic for r in chosen.collect()}
    found = sorted((r.doc_id, bytes(r.bag)) for r in bags.collect())
    many = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = np.bincount([*label.values(), 0, 1], minlength=2) - 1
    clean, toxic = (max(1, many.get(y, 0)) / max(1, int(taken[y])) for y in (0, 1))
    return fit([(b, label[i]) for i, b in found], (clean, toxic))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id``, ``score``, from the text alone.

    A map over rows with the model (2.6 million weights, 10 MB) in its closure.
    Null and empty texts score as texts without a word; equal texts score alike;
    texts of any length are read whole; other columns are no input and fall away;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                score = model.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, score double")
