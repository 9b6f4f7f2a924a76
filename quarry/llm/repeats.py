"""Distributed search for repeated windows, shared by both span removers.

Documents lie in blocks (by a hash of id and text), windows meet in buckets (by
a hash of their anchor, see ``rolling``).  Anchors only bring windows together;
whether windows are equal is decided on their contents, by an index.

1. Scan: every text is cut into runs of windows with one anchor.  Buckets tell
   which anchors occur more than once, and answer the blocks that have them.
2. Contexts: each block reads its texts again and cuts out the contents of the
   runs with such anchors, each distinct content once, with the places it has
   in the block.
3. Index: a bucket's contents are the reference shards.  An index of each shard
   (a suffix automaton or a run-length index, by the caller) is built, the same
   contents stream through it, and its matching statistics say where each window
   occurs first.  The answer goes to the blocks, by content.
4. Cut: a block puts answers, places and texts together.

A content that any number of documents share is one row a block, and its places
never leave the block.  Where one anchor has very many contexts (the edges of a
passage that very many documents share), its windows are contents of their own,
which meet in buckets by a hash of the whole window: a second scan asks for these
in the same way.  Such anchors are a list of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import carried, doc_rows, slices, staged, text_buffer

#: Text bytes scanned at a time, runs a task gathers before it sends them, and
#: bytes and places of contents a block gathers.
SCAN = 512 << 10
GATHER = 250_000
BODIES = 8 << 20
#: Bytes of input a block has, about.
BLOCK = 16 << 20
#: Contexts of one anchor a task reports at a time at most (to be counted), and
#: anchors that are split in all at most.
REPORT = 512
SPLIT = 1 << 16

SEEN = [np.uint64, np.uint16, np.int32]  # anchor, context, block (-1: answered)
HOT = [np.uint64, np.uint32]  # anchor, contexts
CONTENT = [np.uint64, np.int32, np.uint32, np.uint8, np.int64, np.uint32, np.uint32, np.uint8, np.uint32]
# ... anchor, block, content, whether without id, doc, start, windows, more than one place, bytes
PLACE = [np.uint32, np.uint8, np.int64, np.int64, np.uint32]  # content, whether without id, doc, version, start
FIRST = [np.uint32, np.uint32, np.uint32, np.uint8, np.int64, np.int64]  # content, from, to, whether without id, doc, start
ANSWERED = -1


@dataclass(frozen=True)
class Windows:
    """What is compared: ``length`` units, anchored by ``gram`` of them."""

    length: int
    gram: int
    words: bool
    #: Whether an earlier start in the same document counts as earlier.
    within: bool
    #: Contexts beyond which an anchor's windows are contents of their own.
    most: int


@dataclass
class Shard:
    """Distinct contents in document order: bodies, and where each occurs
    first (whether without id, document, first window)."""

    bodies: list[bytes]
    none: np.ndarray
    doc: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.bodies)


#: Takes a shard; gives for all windows of its contents, one content after the
#: other, the content and the place in it where each occurs first, and the number
#: of windows of each content.
Index = Callable[[Shard, Windows], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pack(cols: list[np.ndarray], kinds: list) -> bytes:
    """Columns by byte planes, which compress well."""
    n = len(cols[0])
    parts = [np.array([n], np.int64).tobytes()]
    for c, kind in zip(cols, kinds, strict=True):
        parts.append(np.ascontiguousarray(c.astype(kind)).view(np.uint8).reshape(n, -1).T.tobytes() if n else b"")
    return b"".join(parts)


def _unpack(data: bytes, kinds: list) -> tuple[list[np.ndarray], int]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out, at


def _unpacked(packs: list, kinds: list) -> list[np.ndarray]:
    held = [_unpack(p, kinds)[0] for p in packs]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, k) for k in kinds]


def _heads(*cols: np.ndarray) -> np.ndarray:
    """Where a new group of equal values begins, in sorted columns."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cut_by(key: np.ndarray, cols: list[np.ndarray], kinds: list, bodies: list[bytes] | None = None) -> tuple[np.ndarray, list[bytes]]:
    """One pack for each value of a key."""
    order = np.argsort(key, kind="stable")
    key, cols = key[order], [c[order] for c in cols]
    at = _heads(key)
    ends = np.append(at[1:], len(key)) if len(at) else at
    packs = [_pack([c[a:b] for c in cols], kinds) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    if bodies is not None:
        packs = [p + b"".join([bodies[i] for i in order[a:b].tolist()]) for p, a, b in zip(packs, at.tolist(), ends.tolist(), strict=True)]
    return key[at], packs


def _rows(names: str, *cols) -> pa.RecordBatch:
    """A batch by the names and kinds of a schema string."""
    kinds = {"int": pa.int32(), "byte": pa.int8(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows have no id, and the ids (0 without)."""
    ids = batch.column("doc_id")
    return ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)


def _elements(batch: pa.RecordBatch, spec: Windows):
    raw, off = text_buffer(batch.column("text"))
    if not spec.words:
        return rolling.byte_elements(raw), off
    starts, ends, first = rolling.word_spans(raw, off)
    return rolling.word_elements(raw, starts, ends), first


TOLD = "bucket int, block int, data binary"
ASKED = "block int, data binary"


def _told(held: list[list[np.ndarray]], spec: Windows, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task tells of its runs: to the buckets, each anchor and its
    contexts; past them to the blocks, the anchors it knows to recur."""
    anchor, context, block, none, doc = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((doc, none, block, context, anchor))
    anchor, context, block, none, doc = (c[order] for c in (anchor, context, block, none, doc))
    at = _heads(anchor)
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(anchor))))
    if spec.within:
        recurs = (np.bincount(group) > 1)[group]
    else:
        other = (doc != doc[at][group]) | (none != none[at][group])
        recurs = (np.bincount(group, other) > 0)[group]
    # Of anchors that recur here, the contexts count; each block is answered.
    back = np.flatnonzero(recurs)
    back = back[np.lexsort((block[back], anchor[back]))]
    back = back[_heads(anchor[back], block[back])]
    blocks, packs = _cut_by(block[back], [anchor[back]], [np.uint64])
    yield _rows(TOLD, blocks % buckets, blocks, packs)
    head = _heads(anchor, context)
    head = head[recurs[head]]
    place = np.arange(len(head)) - np.searchsorted(group[head], group[head])
    some = head[place < REPORT]
    alone = _heads(anchor, context, block)
    alone = alone[~recurs[alone]]
    cols = [np.concatenate((anchor[alone], anchor[some])), np.concatenate((context[alone], context[some]))]
    cols.append(np.concatenate((block[alone], np.full(len(some), ANSWERED, np.int32))))
    to, packs = _cut_by((cols[0] % np.uint64(buckets)).astype(np.int32), cols, SEEN)
    yield _rows(TOLD, to, [None] * len(to), packs)


def _by_window(runs: rolling.Runs, elements: np.ndarray, off: np.ndarray, spec: Windows, hot: np.ndarray) -> rolling.Runs:
    """Windows of hot anchors as runs of their own, anchored by their hash."""
    own = np.flatnonzero(np.isin(runs.anchor, hot))
    n = runs.count[own]
    row, start = np.repeat(runs.row[own], n), np.repeat(runs.start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    anchor = rolling.window_hashes(elements, off[row] + start, spec.length)
    return rolling.Runs(row, start, np.ones(len(row), np.int64), anchor, np.zeros(len(row), np.uint64))


def _scan(spec: Windows, buckets: int, hot: np.ndarray | None = None):
    """Runs of all windows or, with ``hot``, the windows of these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in slices(whole, "text", SCAN):
                elements, off = _elements(batch, spec)
                none, doc = _ids(batch)
                block = batch.column("block").to_numpy()
                for r in rolling.runs(elements, off, spec.length, spec.gram):
                    if hot is not None:
                        r = _by_window(r, elements, off, spec, hot)
                    held.append([r.anchor, r.context.astype(np.uint16), block[r.row], none[r.row], doc[r.row]])
                    n += len(r.row)
                if n >= GATHER:
                    yield from _told(held, spec, buckets)
                    held, n = [], 0
        if held:
            yield from _told(held, spec, buckets)

    return run


def _answer(spec: Windows, buckets: int):
    """One bucket: to each block those of its anchors that recur; without a
    block, the anchors of too many contexts."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table.column("block")))
        out = [pa.RecordBatch.from_arrays([known.column(c).combine_chunks() for c in ("block", "data")], names=["block", "data"])] if known.num_rows else []
        packs = table.filter(pc.is_null(table.column("block"))).column("data")
        anchor, context, block = _unpacked([p.as_buffer() for p in packs], SEEN)
        if len(anchor):
            order = np.lexsort((context, anchor))
            anchor, context, block = (c[order] for c in (anchor, context, block))
            at = _heads(anchor)
            size = np.diff(np.append(at, len(anchor)))
            group = np.repeat(np.arange(len(at)), size)
            recurs = (size > 1) | (np.minimum.reduceat(block, at) == ANSWERED)
            ask = recurs[group] & (block != ANSWERED)
            out.append(_rows(ASKED, *_cut_by(block[ask], [anchor[ask]], [np.uint64])))
            contexts = np.bincount(group[_heads(anchor, context)], minlength=len(at))
            hot = np.flatnonzero(contexts > spec.most)
            hot = hot[np.lexsort((anchor[at[hot]], -contexts[hot]))][: max(1, SPLIT // buckets)]
            if len(hot):
                out.append(_rows(ASKED, [ANSWERED], [_pack([anchor[at[hot]], contexts[hot]], HOT)]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows(ASKED, [], [])])

    return run


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows with one block and kind."""
    if not batch.num_rows:
        return
    block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
    at = _heads(block, kind)
    for a, b in zip(at.tolist(), np.append(at[1:], len(block)).tolist(), strict=True):
        yield int(block[a]), int(kind[a]), batch.slice(a, b - a)


def _placed(df: DataFrame, parts: int) -> DataFrame:
    """A partition for each block, its rows by kind."""
    return df.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "kind")


CUT = "kind byte, bucket int, block int, data binary"
CONTENTS, PLACES = 0, 1


class _Gathered:
    """Distinct contents of a block and their places."""

    def __init__(self, block: int, buckets: int):
        self.block, self.buckets, self.next = block, buckets, 0
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bodies, self.places, self.size, self.n = [], [], 0, 0

    def add(self, bodies: list[bytes], anchor, none, doc, version, start, count) -> None:
        known, at = self.known, np.empty(len(bodies), np.int64)
        for i, body in enumerate(bodies):
            k = known.get(body)
            if k is None:
                k = known[body] = len(known)
                self.bodies.append(body)
                self.size += len(body)
            at[i] = k
        self.places.append([at, anchor, none, doc, version, start, count])
        self.n += len(bodies)

    def full(self) -> bool:
        return self.size >= BODIES or self.n >= GATHER

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        at, anchor, none, doc, version, start, count = (np.concatenate(c) for c in zip(*self.places, strict=True))
        order = np.lexsort((start, doc, none, at))
        at, anchor, none, doc, version, start, count = (c[order] for c in (at, anchor, none, doc, version, start, count))
        head = _heads(at)
        more = np.diff(np.append(head, len(at))) > 1
        sizes = np.array([len(b) for b in self.bodies])
        own = np.full(len(head), self.block)
        cols = [anchor[head], own, at[head] + self.next, none[head], doc[head], start[head], count[head], more, sizes]
        to, packs = _cut_by((anchor[head] % np.uint64(self.buckets)).astype(np.int32), cols, CONTENT, self.bodies)
        yield _rows(CUT, [CONTENTS] * len(to), to, [self.block] * len(to), packs)
        yield _rows(CUT, [PLACES], [None], [self.block], [_pack([at + self.next, none, doc, version, start], PLACE)])
        self.next += len(self.known)
        self._clear()


def _contexts(spec: Windows, buckets: int, hot: np.ndarray):
    """Blocks of answers and texts: contents and places of the runs asked for."""

    def cut(batch: pa.RecordBatch, asked: np.ndarray, into: _Gathered) -> None:
        elements, off = _elements(batch, spec)
        none, doc = _ids(batch)
        version = batch.column("version").to_numpy()
        raw = None if spec.words else memoryview(text_buffer(batch.column("text"))[0])
        split = {}
        asks = lambda anchor: asked[np.minimum(np.searchsorted(asked, anchor), len(asked) - 1)] == anchor
        found = rolling.runs(elements, off, spec.length, spec.gram)
        if len(hot):
            found += [_by_window(r, elements, off, spec, hot) for r in found]
        for i, r in enumerate(found):
            want = asks(r.anchor)
            if len(hot) and 2 * i < len(found):
                want &= ~np.isin(r.anchor, hot)
            want = np.flatnonzero(want)
            if not len(want):
                continue
            row, start, count, anchor = r.row[want], r.start[want], r.count[want], r.anchor[want]
            ends = start + count + (spec.length - 1)
            if spec.words:
                bodies = []
                for k, a, b in zip(row.tolist(), start.tolist(), ends.tolist(), strict=True):
                    if k not in split:
                        split[k] = batch.column("text")[k].as_py().encode().split()
                    bodies.append(b" ".join(split[k][a:b]))
            else:
                base = off[row]
                bodies = [bytes(raw[a:b]) for a, b in zip((base + start).tolist(), (base + ends).tolist(), strict=True)]
            into.add(bodies, anchor, none[row], doc[row], version[row], start, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        asked, into = np.zeros(0, np.uint64), None
        for whole in batches:
            for block, kind, rows in _segments(whole):
                if into is None or into.block != block:
                    if into is not None:
                        yield from into.flush()
                    held, asked, into = [], None, _Gathered(block, buckets)
                if kind == 0:
                    held += [_unpack(p.as_buffer(), [np.uint64])[0][0] for p in rows.column("data")]
                    continue
                if asked is None:
                    asked, held = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64), []
                if len(asked):
                    for batch in slices(rows, "text", SCAN):
                        cut(batch, asked, into)
                        if into.full():
                            yield from into.flush()
        if into is not None:
            yield from into.flush()

    return run


def _indexed(spec: Windows, index: Index, part: int):
    """One bucket of contents: where each of their windows occurs first."""

    def run(table: pa.Table) -> pa.Table:
        cols, bodies = [], []
        for p in table.column("data"):
            raw = p.as_buffer()
            got, at = _unpack(raw, CONTENT)
            cols.append(got)
            ends = at + np.cumsum(got[8].astype(np.int64))
            view = memoryview(raw)
            bodies += [bytes(view[a:b]) for a, b in zip(np.append(at, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        anchor, block, content, none, doc, start, count, more, size = (np.concatenate(c) for c in zip(*cols, strict=True))
        # Equal bodies are one content.
        known: dict[bytes, int] = {}
        of = np.fromiter((known.setdefault(b, len(known)) for b in bodies), np.int64, len(bodies))
        del bodies
        names = list(known)
        del known
        order = np.lexsort((start, doc, none, of))
        head = order[_heads(of[order])]  # by content: its first holder
        holders = np.bincount(of)
        several = (holders > 1) | (np.bincount(of, more) > 0)
        # Anchors by anchor; one that has a single content in a single place
        # has nothing to be compared with.
        by = np.lexsort((start[head], doc[head], none[head], anchor[head]))
        at = _heads(anchor[head][by])
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
        alive = (np.bincount(group) > 1) | (np.bincount(group, several[by]) > 0)
        by, group = by[alive[group]], group[alive[group]]
        out = [[] for _ in range(6)]  # content (of names), from, to, none, doc, start
        bounds = _heads(group)
        ends = np.append(bounds[1:], len(by))
        total = np.cumsum(size[head][by].astype(np.int64)) if len(by) else by
        a = 0
        while a < len(bounds):
            # Anchors up to about a part share an index.
            b = a + 1
            floor = total[bounds[a]] - size[head][by[bounds[a]]]
            while b < len(bounds) and total[ends[b] - 1] - floor <= part:
                b += 1
            own = by[bounds[a] : ends[b - 1]]
            own = own[np.lexsort((start[head][own], doc[head][own], none[head][own]))]
            shard = Shard([names[i] for i in own.tolist()], none[head][own], doc[head][own], start[head][own].astype(np.int64))
            source, where, windows = index(shard, spec)
            base = np.cumsum(windows) - windows
            whose = np.repeat(np.arange(len(shard)), windows)
            inner = np.arange(len(whose)) - base[whose]
            # Stretches of windows that occur first in one line.
            line = shard.start[source] + where - inner
            new = _heads(whose, shard.none[source], shard.doc[source], line)
            which, end = whose[new], np.append(new[1:], len(whose))
            # A content that occurs once, here and nowhere before, has no answer.
            alone = (np.bincount(which, minlength=len(shard)) == 1) & (source[base] == np.arange(len(shard))) & ~several[own]
            told = ~alone[which]
            new, which, end = new[told], which[told], end[told]
            first = (own[which], inner[new], end - base[which], shard.none[source[new]], shard.doc[source[new]], line[new])
            for c, v in zip(out, first, strict=True):
                c.append(v)
            a = b
        if not out[0] or not sum(map(len, out[0])):
            return pa.Table.from_batches([_rows(ASKED, [], [])])
        first = [np.concatenate(c) for c in out]
        # To every holder of a content.
        order = np.argsort(first[0], kind="stable")
        first = [c[order] for c in first]
        lo, hi = np.searchsorted(first[0], of, "left"), np.searchsorted(first[0], of, "right")
        n = hi - lo
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(lo, n) + inner
        to, packs = _cut_by(np.repeat(block, n), [np.repeat(content, n), *(c[at] for c in first[1:])], FIRST)
        return pa.Table.from_batches([_rows(ASKED, to, packs)])

    return run


def _spans(answers: list, places: list, spec: Windows) -> dict[tuple, bytes]:
    """By document and version: merged (first window, end) pairs that occurred
    earlier."""
    content, a, b, none, doc, line = _unpacked(answers, FIRST)
    if not len(content):
        return {}
    order = np.argsort(content, kind="stable")
    content, a, b, none, doc, line = (c[order] for c in (content, a, b, none, doc, line))
    own, no_id, in_doc, version, start = _unpacked(places, PLACE)
    lo, hi = np.searchsorted(content, own, "left"), np.searchsorted(content, own, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    no_id, in_doc, version, start = (np.repeat(c, n) for c in (no_id, in_doc, version, start.astype(np.int64)))
    later = (no_id > none[at]) | ((no_id == none[at]) & (in_doc > doc[at]))
    if spec.within:
        later |= (no_id == none[at]) & (in_doc == doc[at]) & (start > line[at])
    no_id, in_doc, version = no_id[later], in_doc[later], version[later]
    first, end = start[later] + a[at[later]], start[later] + b[at[later]]
    order = np.lexsort((first, version, in_doc, no_id))
    no_id, in_doc, version, first, end = (c[order] for c in (no_id, in_doc, version, first, end))
    head = _heads(no_id, in_doc, version)
    pairs = np.stack([first, end], 1).astype("<u4")
    ends = np.append(head[1:], len(first))[: len(head)]
    return {
        (None if x else d, v): pairs[i:j].tobytes()
        for x, d, v, i, j in zip(no_id[head].tolist(), in_doc[head].tolist(), version[head].tolist(), head.tolist(), ends.tolist(), strict=True)
    }


def covered(spans: bytes | None, units: int, length: int) -> np.ndarray:
    """Mask of the units of a text that lie in a stretch of repeated windows."""
    step = np.zeros(units + 1, np.int32)
    if spans:
        pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1] - 1 + length, -1)
    return np.cumsum(step[:-1]) > 0


def _parts(docs: DataFrame) -> int:
    """Partitions for an input of this size, as far as the plan knows it."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // BLOCK)) if size < 1 << 60 else least


def without_repeated(
    docs: DataFrame, spec: Windows, index: Index, part: int, cut: Callable[[str, bytes | None], tuple], schema: str, buckets: int | None = None, carry: bool = False
) -> DataFrame:
    """``cut`` of every text and the stretches of its windows that occurred
    earlier, with ``doc_id`` and, with ``carry``, the row as it came in ``_row``.

    ``part`` is the bytes of contents an index holds, about.  Blocks and
    buckets follow the input's size.
    """
    parts = _parts(docs)
    buckets = buckets or parts
    version = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    texts = doc_rows(docs, carry).withColumn("version", version)
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "version"), F.lit(parts)).cast("int"))
    plain = texts.select("doc_id", "text", "version", "block")


    def answered(hot: np.ndarray | None = None) -> DataFrame:
        told = plain.mapInArrow(_scan(spec, buckets, hot), TOLD)
        return staged(told.groupBy("bucket").applyInArrow(_answer(spec, buckets), ASKED), "asked")

    asked = answered()
    found = asked.where(F.col("block") == ANSWERED).select("data").collect()  # at most SPLIT anchors
    hot = np.unique(_unpacked([bytes(r.data) for r in found], HOT)[0])
    if len(hot):
        asked = asked.unionByName(answered(hot))
    kind = lambda n: F.lit(n).cast("byte").alias("kind")
    answers = asked.where(F.col("block") != ANSWERED).select("block", kind(0), "data")
    both = answers.unionByName(plain.select("*", kind(1)), allowMissingColumns=True)
    contexts = staged(_placed(both, parts).mapInArrow(_contexts(spec, buckets, hot), CUT), "contexts")
    contents = contexts.where(F.col("kind") == CONTENTS).select("bucket", "data")
    firsts = staged(contents.groupBy("bucket").applyInArrow(_indexed(spec, index, part), ASKED), "firsts")
    places = contexts.where(F.col("kind") == PLACES).select("block", kind(1), "data")
    three = firsts.select("block", kind(0), "data").unionByName(places).unionByName(texts.select("*", kind(2)), allowMissingColumns=True)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [kinds[c.split()[1]] for c in schema.split(", ")]
    row, row_schema = carried(texts)
    whole_row = [row] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, spans = None, ([], []), None
        for whole in batches:
            for block, k, rows in _segments(whole):
                if block != now:
                    now, held, spans = block, ([], []), None
                if k < 2:
                    held[k].extend(p.as_buffer() for p in rows.column("data"))
                    continue
                if spans is None:
                    spans, held = _spans(*held, spec), ([], [])
                for batch in slices(rows, "text", SCAN):
                    keys = zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), strict=True)
                    done = [cut(t, spans.get(x)) for t, x in zip(batch.column("text").to_pylist(), keys, strict=True)]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
                    own = [batch.column("doc_id"), *arrays, *(batch.column(c) for c in whole_row)]
                    yield pa.RecordBatch.from_arrays(own, names=["doc_id", *names, *whole_row])

    return _placed(three, parts).mapInArrow(run, f"doc_id long, {schema}{row_schema}")
