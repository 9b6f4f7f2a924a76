"""A quality classifier: boosted trees over statistics of a document's text.

Statistics of every whole text are computed where it lies, a batch of texts at a
time, and staged; a bounded number of labelled rows of them fit the trees
(``histogram_trees``), whose arrays then score all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import histogram_trees
from .common import doc_rows, slices, staged, text_buffer
from .quality import STOP_WORDS
from .rolling import Sums, byte_elements, mix, word_elements, word_spans
from .toxicity import is_held_out

#: Labelled rows of either class that a fit takes at most, by a hash of their id.
PER_CLASS = 10_000
#: Score from which a document counts as good.
THRESHOLD = 0.5
#: Text bytes whose statistics are computed at a time.
SLICE = 2 << 20
STATISTICS = [
    "log_chars", "log_words", "log_lines", "word_length", "longest_word", "capitals", "digits", "signs", "points", "marks", "foreign",
    "spaces", "distinct_words", "commonest_word", "same_word_again", "distinct_pairs", "function_words", "repeated_lines",
    "ended_lines", "words_without_letters", "words_ending_in_signs", "capital_words", "entropy",
]


def _class(*parts: str | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for p in parts:
        table[[ord(c) for c in p] if isinstance(p, str) else list(p)] = True
    return table


_UPPER, _LOWER, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_SIGNS, _MARKS, _END = _class("#$%&*|<>{}[]\\^~_="), _class("!?"), _class(".!?:;")
_POINTS = _class(range(33, 48), range(58, 65), range(91, 97), range(123, 127)) & ~_SIGNS
_SPACE, _WIDE, _LATER = _class(" ", range(9, 14)), _class(range(128, 256)), _class(range(128, 192))
_LETTER = _UPPER | _LOWER | _WIDE
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _hashes(words: list[str]) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(word_elements(np.concatenate(raw), np.concatenate(([0], ends[:-1])), ends))


_STOPS = _hashes(STOP_WORDS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: distinct values, and the count of the commonest."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
    most = np.zeros(n)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(o))).astype(float))
    return np.bincount(o[first], minlength=n).astype(float), most


@dataclass
class Tally:
    """What a batch of texts holds: sums by text, and hashes of words, pairs of
    neighbouring words and lines with the text that each is of."""

    sums: np.ndarray
    longest: np.ndarray
    letters: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    lines: tuple[np.ndarray, np.ndarray]

    def statistics(self) -> np.ndarray:
        n = len(self.sums)
        size, later, words, length, upper, digit, sign, point, mark, wide, space, same, pair_count, stops, ended, without, signed, capital = self.sums.T
        chars, some, rows = np.maximum(size - later, 1.0), np.maximum(words, 1.0), np.maximum(np.bincount(self.lines[0], minlength=n), 1.0)
        distinct, most = _distinct(*self.words, n)
        pairs, _ = _distinct(*self.pairs, n)
        kinds, _ = _distinct(*self.lines, n)
        lines = np.bincount(self.lines[0], minlength=n).astype(float)
        share = self.letters / np.maximum(size, 1)[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        return np.stack([
            np.log1p(chars), np.log1p(words), np.log1p(lines), length / some, np.log1p(self.longest), upper / chars, digit / chars, sign / chars,
            point / chars, mark / some, (wide - later) / chars, space / chars, distinct / some, most / some, same / some,
            pairs / np.maximum(pair_count, 1.0),
            stops / some, (lines - kinds) / rows, ended / rows, without / some, signed / some, capital / some, entropy,
        ], 1).astype(np.float32)


def tally(raw: np.ndarray, off: np.ndarray) -> Tally:
    """The tally of a flat batch (UTF-8 and offsets)."""
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n), size)
    count = lambda table: np.bincount(doc[table[raw]], minlength=n).astype(float)
    starts, ends, first = word_spans(raw, off)
    of = np.repeat(np.arange(n), np.diff(first))
    by_word = lambda which: np.bincount(of[which], minlength=n).astype(float)
    later = np.concatenate(([0], np.cumsum(_LATER[raw])))
    length = (ends - starts - (later[ends] - later[starts])).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    h = word_elements(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    beside = of[1:] == of[:-1]
    pair = mix(h[:-1][beside]) + h[1:][beside] if len(h) else h
    none = np.zeros(n)
    by = [none] * 4
    if len(starts):
        letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
        folded = word_elements(_FOLD[raw], starts, ends)
        by = [by_word(x) for x in (_among(folded, _STOPS), letters[ends] == letters[starts], _SIGNS[raw[ends - 1]], _UPPER[raw[starts]])]
    stops, without, signed, capital = by
    # Lines that hold a word: between breaks and the ends of texts.
    cut = np.unique(np.concatenate((off, np.flatnonzero(raw == 10) + 1)))
    a, b = cut[:-1], cut[1:]
    b = b - ((b > a) & (raw[np.maximum(b, 1) - 1] == 10)) if len(raw) else b
    solid = np.concatenate(([0], np.cumsum(~_SPACE[raw])))
    held = solid[b] > solid[a]
    a, b = a[held], b[held]
    line_of = np.searchsorted(off, a, "right") - 1
    line = Sums(byte_elements(raw)).of(a, b) if len(a) else np.zeros(0, np.uint64)
    sums = np.stack([
        size.astype(float), count(_LATER), np.diff(first).astype(float), np.bincount(of, length, n), count(_UPPER), count(_DIGIT), count(_SIGNS), count(_POINTS),
        count(_MARKS), count(_WIDE), count(_SPACE), np.bincount(of[1:][beside & (h[1:] == h[:-1])], minlength=n), np.bincount(of[1:][beside], minlength=n),
        stops, np.bincount(line_of[_END[raw[b - 1]]], minlength=n), without, signed, capital,
    ], 1)
    letters = np.bincount(doc * 256 + raw, minlength=256 * n).reshape(n, 256)
    return Tally(sums, longest, letters, (of, h), (of[1:][beside], pair), (line_of, line))


def tally_of_one(raw: np.ndarray, piece: int) -> Tally:
    """The tally of a long text in pieces that end at a line break, or else
    behind a word (a line of more than a piece counts as several)."""
    at, parts, before = 0, [], None
    while at < len(raw):
        to = min(at + piece, len(raw))
        if to < len(raw):
            for kind in (raw[at:to] == 10, _SPACE[raw[at:to]]):
                if len(found := np.flatnonzero(kind)):
                    to = at + int(found[-1]) + 1
                    break
            else:
                to = at + piece + int(np.argmax(_SPACE[raw[at + piece :]])) + 1 if _SPACE[raw[at + piece :]].any() else len(raw)
        t = tally(raw[at:to], np.array([0, to - at]))
        if len(t.words[1]):
            if before is not None:  # the pair of words that the cut parts
                own = t.words[1][:1]
                t.pairs = (np.zeros(len(t.pairs[0]) + 1, np.int64), np.concatenate((mix(before) + own, t.pairs[1])))
                t.sums[0, 11] += float(before[0] == own[0])
                t.sums[0, 12] += 1
            before = t.words[1][-1:]
        parts.append(t)
        at = to
    joined = lambda name: tuple(np.concatenate(x) for x in zip(*(getattr(t, name) for t in parts), strict=True))
    return Tally(sum(t.sums for t in parts), np.max([t.longest for t in parts], axis=0), sum(t.letters for t in parts), joined("words"), joined("pairs"), joined("lines"))


def statistics_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text of a flat batch (UTF-8 and offsets)."""
    if len(off) == 2 and len(raw) > 2 * SLICE:
        return tally_of_one(raw, SLICE).statistics()
    return tally(raw, off).statistics()


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` of every whole text, as an array of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                values = statistics_of(*text_buffer(batch.column("text")))
                rows = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "stats"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, stats array<float>")


def train(stats: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> histogram_trees.Flat:
    """Trees from labelled rows that are not held out.

    At most ``per_class`` ids of either label are taken, by hash, and weighted
    so that the classes stand as in all learnable labels; every fifth tells when
    to stop.  Rows without an id or a label of 0 or 1 do not count; of an id
    labelled twice the label 1 does, of documents with one id the least statistics.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    many = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Two times per_class rows of two numbers: a bound for the broadcast and for what comes back.
    picked = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("stats").alias("stats"))
    rows = sorted(picked.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], np.int64)
    x = np.array([r["stats"] for r in rows], float).reshape(-1, len(STATISTICS))
    weight = np.array([many[q] / max(1, int((y == q).sum())) for q in y.tolist()])
    aside = np.zeros(len(y), bool)
    for q in (0, 1):
        aside[np.flatnonzero(y == q)[4::5]] = True
    return histogram_trees.fit(x, y, weight / weight.mean() if len(weight) else weight, aside)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: ``doc_id`` and ``score``, the chance that the text is good, from
    the text alone.

    Null and empty texts score as texts without a word; equal texts score alike;
    texts of any length are read whole, long ones in pieces (a task holds a text
    and some 20 bytes for each of its words); other columns are no input and fall away.
    Without learnable labels of both kinds every score is their share (one half
    where there are none).  An empty table gives an empty result.
    """
    stats = staged(statistics(docs), "statistics")
    trees = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.predict(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
