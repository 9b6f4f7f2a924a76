"""Retrieval packing: sequences filled with lexical neighbours of a seed.

Documents are routed by their words, wherever they lie in the corpus: a tree of
centroids of weighted word vectors, fitted on a sample that grows with the corpus
up to a bound, has a leaf for about each group of shards, and a leaf's documents
meet in one task, which encodes them (their words are alike, so most are known by
then).  There a second tree, fitted on the group's own documents and their ids,
parts them into shards.  A shard has a BM25 inverted index over token ids; the next
unused document is the seed of a window, all its terms ask the index for unused
neighbours, and these fill the window best first.  The document that crosses the
window's end is cut and its rest seeds the next window, so only a shard's last
window is not full; that one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import doc_rows, slices, text_buffer
from .tokens import UnitEncoder

LENGTH = 2048
#: Ids a shard holds before it is packed (a longer document is a shard).
SHARD = 2 << 20
#: Bytes of text that a shard is meant to have, which give about so many ids.
TEXT = 5 << 20
#: Shards of a group, which one task holds.
TOGETHER = 8
#: Documents the routing tree is fitted on, about (half grow it, the others tell
#: how much its leaves will hold): for each group, at least and at most.  At most
#: as many of a node's documents place its centroids; the tree's fan-out.
PER_GROUP, SAMPLE, MOST, PLACING, FAN = 64, 4096, 65_536, 2048, 8
#: Places of a routing vector; words are dealt to them by a hash of their size
#: and first letters, ids within a group by their number.
PLACES, LETTERS, ID_PLACES = 4096, 6, 1024
K1, B = 1.2, 0.75


class Bm25Shard:
    """Inverted index of one shard: postings by term, with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], ends: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        of = np.repeat(np.arange(len(docs)), sizes)
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        n = max(1, len(docs))
        bits = n.bit_length()
        top = int(flat.max(initial=0))
        keys = (flat << bits | of)[flat != ends]
        del of, flat
        keys.sort()
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(keys))).astype(np.float64)
        term, self.doc = keys[head] >> bits, keys[head] & ((1 << bits) - 1)
        self.n = len(docs)
        self.first = np.searchsorted(term, np.arange(top + 2))
        df = np.diff(self.first)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if len(sizes) else 1.0))
        self.weight = idf[term] * times * (K1 + 1) / (times + norm[self.doc])
        # Terms of many documents have a dense row of weights, the others
        # are added by posting; terms of one document find nobody else.
        many = np.flatnonzero(df > max(16, n >> 3))
        self.row = np.full(len(df), -1)
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), n), np.float32)
        heavy = self.row[term] >= 0
        self.dense[self.row[term[heavy]], self.doc[heavy]] = self.weight[heavy]
        self.held = np.arange(n)
        shared = np.flatnonzero(df[term] > 1)
        shared = shared[np.argsort(self.doc[shared], kind="stable")]
        self.ask_term = term[shared]
        self.ask_first = np.searchsorted(self.doc[shared], np.arange(n + 1))

    def shrink(self, unused: np.ndarray) -> None:
        """Let go of used documents' dense weights once they are over half."""
        if 2 * np.count_nonzero(unused) < len(self.held):
            keep = unused[self.held]
            self.dense, self.held = np.ascontiguousarray(self.dense[:, keep]), self.held[keep]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document (of those not let go) for all terms of one."""
        asks = self.ask_term[self.ask_first[doc] : self.ask_first[doc + 1]]
        row = self.row[asks]
        heavy = np.zeros(len(self.dense), np.float32)
        heavy[row[row >= 0]] = 1
        score = np.zeros(self.n)
        score[self.held] = heavy @ self.dense
        rare = asks[row < 0]
        for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist(), strict=True):
            score[self.doc[a:b]] += self.weight[a:b]
        return score

    def best(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term, best first, one at a time."""
        score = np.where(unused, self.scores(doc), 0.0)
        while self.n:
            at = int(score.argmax())
            if score[at] <= 0:
                return
            score[at] = 0
            yield at

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        return np.array(list(self.best(doc, unused)), np.int64)


def pack_shard(docs: list[np.ndarray], ends: int, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard."""
    index = Bm25Shard(docs, ends)
    unused = np.ones(len(docs), bool)
    pieces, sequence, fill, lowest = [], 0, 0, 0

    def place(doc: int) -> bool:
        """Put a whole document, cut where windows end; says if one ended."""
        nonlocal sequence, fill
        at, size, ended = 0, len(docs[doc]), False
        unused[doc] = False
        while at < size:
            take = min(size - at, length - fill)
            pieces.append((doc, at, take, sequence, fill))
            at, fill = at + take, fill + take
            if fill == length:
                sequence, fill, ended = sequence + 1, 0, True
        return ended

    while True:
        while lowest < len(docs) and not unused[lowest]:
            lowest += 1
        if lowest == len(docs):
            return pieces
        # What crossed the last window's end is the seed of this one.
        seed = pieces[-1][0] if fill else lowest
        if not fill:
            place(seed)
        index.shrink(unused)
        for doc in index.best(seed, unused):
            if place(doc):
                break
        else:
            # No neighbour is left: the next document in order goes on.
            while lowest < len(docs) and not unused[lowest]:
                lowest += 1
            if lowest < len(docs) and fill:
                place(lowest)


def without_padding(pieces: list[tuple[int, int, int, int, int]], length: int) -> list[tuple[int, int, int, int, int]]:
    """The same pieces with a last sequence that is not full cut into sequences of
    a power of two, the largest first."""
    if not pieces or (fill := pieces[-1][4] + pieces[-1][2]) == length:
        return pieces
    last = pieces[-1][3]
    sizes = [1 << i for i in range(fill.bit_length() - 1, -1, -1) if fill >> i & 1]
    ends = np.cumsum(sizes).tolist()
    out, k = [p for p in pieces if p[3] < last], 0
    for doc, start, size, _, at in (p for p in pieces if p[3] == last):
        while size:
            take = min(size, ends[k] - at)
            out.append((doc, start, take, last + k, at - (ends[k] - sizes[k])))
            start, size, at = start + take, size - take, at + take
            k += at == ends[k]
    return out


def places_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which places the words of each text have, and the bytes of each text."""
    raw, off = text_buffer(texts)
    starts, ends, first = rolling.word_spans(raw, off)
    size = ends - starts
    padded = np.append(raw, np.zeros(LETTERS, np.uint8))
    key = size.astype(np.uint64)
    for j in range(LETTERS):
        key = key * np.uint64(257) + np.where(size > j, padded[starts + j], 0).astype(np.uint64)
    place = (rolling.mix(key) % np.uint64(PLACES)).astype(np.int64)
    has = np.zeros(len(texts) * PLACES, bool)
    has[np.repeat(np.arange(len(texts)) * PLACES, np.diff(first)) + place] = True
    return has.reshape(len(texts), PLACES), np.diff(off)


def id_places(docs: list[np.ndarray]) -> np.ndarray:
    """Which of ``ID_PLACES`` places the ids of each document have, as bits."""
    out = np.zeros((len(docs), ID_PLACES // 8), np.uint8)
    for at in range(0, len(docs), CHUNK):
        some = docs[at : at + CHUNK]
        has = np.zeros(len(some) * ID_PLACES, bool)
        of = np.repeat(np.arange(len(some)) * ID_PLACES, [len(d) for d in some])
        has[of + np.concatenate(some) % ID_PLACES] = True
        out[at : at + CHUNK] = np.packbits(has.reshape(len(some), ID_PLACES), axis=1)
    return out


#: Documents of the sample that a leaf grows from at least.
LEAST = 32
#: Documents whose vectors are looked at together.
CHUNK = 512


class Router:
    """A tree of centroids.  Leaves are given shards by what documents that the
    tree has not grown from put into them: several shards, dealt by row, to a
    leaf that holds more than one; one to small leaves that follow each other."""

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, target: float):
        """``sample`` has a row of bits for each document; ``target`` is what a
        shard is to hold of all their ``sizes``."""
        grow, tell = (slice(0, None, 2), slice(1, None, 2)) if len(sample) >= 2 * LEAST else (slice(0, None), slice(0, None))
        bits, n = sample[grow], len(sample[grow])
        df = np.zeros(8 * bits.shape[1])
        for at in range(0, n, CHUNK):
            df += np.unpackbits(bits[at : at + CHUNK], axis=1).sum(axis=0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        share = sizes[grow] / target * (sizes.sum() / max(1.0, sizes[grow].sum()))
        self.root = self._grow(bits, np.arange(n), share, np.random.default_rng(5))
        seen = np.zeros(self.leaves)
        told = sample[tell]
        for i in range(0, len(told), CHUNK):
            own = sizes[tell][i : i + CHUNK]
            np.add.at(seen, self.leaf(np.unpackbits(told[i : i + CHUNK], axis=1)), own)
        seen *= sizes.sum() / max(1.0, sizes[tell].sum()) / target
        self.first, self.copies = np.zeros(self.leaves, np.int64), np.ones(self.leaves, np.int64)
        self.shards, fill = 0, 2.0
        for i, held in enumerate(seen.tolist()):
            if fill + held > 1:
                self.copies[i] = max(1, int(np.ceil(held)))
                self.shards, fill = self.shards + int(self.copies[i]), held if held <= 1 else 2.0
                self.first[i] = self.shards - self.copies[i]
            else:
                self.first[i], fill = self.shards - 1, fill + held

    def _vectors(self, bits: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits, axis=1) * self.idf
        return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]

    def _grow(self, bits: np.ndarray, own: np.ndarray, share: np.ndarray, rng) -> int:
        whole = share[own].sum()
        if whole > 1 and len(own) >= 2 * LEAST:
            k = int(min(FAN, max(2, np.ceil(whole)), len(own) // LEAST))
            part = self._vectors(bits[own if len(own) <= PLACING else np.sort(rng.choice(own, PLACING, replace=False))])
            mid = part[rng.choice(len(part), k, replace=False)]
            for _ in range(6):
                of = (part @ mid.T).argmax(1)
                for j in range(k):
                    if (of == j).any():
                        m = part[of == j].sum(0)
                        mid[j] = m / max(np.sqrt((m * m).sum()), 1e-9)
            del part
            of = np.concatenate([(self._vectors(bits[own[i : i + CHUNK]]) @ mid.T).argmax(1) for i in range(0, len(own), CHUNK)])
            kept = np.unique(of)
            if len(kept) > 1:
                at = len(self.nodes)
                self.nodes.append((np.ascontiguousarray(mid[kept].T), []))
                self.nodes[at][1].extend([self._grow(bits, own[of == j], share, rng) for j in kept])
                return at
        self.leaves += 1
        return -self.leaves

    def leaf(self, has: np.ndarray) -> np.ndarray:
        """The leaf of each document, from its places."""
        x = has * self.idf
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -node - 1
                continue
            mid, children = self.nodes[node]
            best = (x[own] @ mid).argmax(1)
            todo += [(c, own[best == j]) for j, c in enumerate(children) if (best == j).any()]
        return out

    def route(self, has: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The shard of each of ``len(rows)`` documents."""
        leaf = self.leaf(has)
        return self.first[leaf] + rows % self.copies[leaf]


def router(docs: DataFrame) -> Router:
    """A router of a table to groups, from the words of some of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                has, size = places_of(batch.column("text"))
                packed = [b.tobytes() for b in np.packbits(has, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(packed, pa.binary())], names=["size", "places"])

    some = doc_rows(docs)
    count, held = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = min(MOST, max(SAMPLE, PER_GROUP * held // (TOGETHER * TEXT)))
    some = some.sample(wanted / count, seed=3) if count > wanted else some
    found = sorted((bytes(r.places), r.size) for r in some.mapInArrow(run, "size long, places binary").collect())
    sizes = np.array([n for _, n in found], float)
    sample = np.frombuffer(b"".join(p for p, _ in found), np.uint8).reshape(len(found), PLACES // 8)
    return Router(sample, sizes, TOGETHER * TEXT * max(1, len(found)) / max(1, count))


def parted(docs: list[np.ndarray]) -> list[list[int]]:
    """The documents of a group by shard, each in their order; what a shard has
    beyond one and a half times its size goes on as another."""
    sizes = np.array([len(d) for d in docs], float)
    if sizes.sum() <= 1.5 * SHARD:
        return [list(range(len(docs)))]
    bits = id_places(docs)
    some = np.unique(np.linspace(0, len(docs) - 1, min(len(docs), PLACING)).astype(np.int64))
    tree = Router(bits[some], sizes[some], SHARD * sizes[some].sum() / sizes.sum())
    shard = np.concatenate([tree.route(np.unpackbits(bits[i : i + CHUNK], axis=1), np.arange(i, min(i + CHUNK, len(docs)))) for i in range(0, len(docs), CHUNK)])
    out: list[list[int]] = []
    last, held = -1, 0.0
    for i in np.argsort(shard, kind="stable").tolist():
        if shard[i] != last or held >= 1.5 * SHARD:
            out.append([])
            last, held = shard[i], 0.0
        out[-1].append(i)
        held += sizes[i]
    return out


#: Partitions that groups are dealt to at most; a partition sorts its groups.
PARTITIONS = 8192

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, padded long, ids binary"
)


def pack(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    ``start`` and ``length`` place the piece in its document's ids (end id
    included), ``sequence_id`` and ``offset`` in its sequence; ``padded`` is
    the sequence's size, ``length`` or a power of two.  Texts are shuffled once, to
    their group, in which they come by id and text; a task holds a group's ids at a
    time, cut where it outgrows its size, and a very long text whole.  A null or
    empty text is the end id alone; rows that share an id, or have none, are packed
    each; other columns fall away; an empty table has no pieces.
    """

    routes = router(docs)
    shared = docs.sparkSession.sparkContext.broadcast(routes)
    # A number for each partition that the shuffle deals to it.
    n = min(PARTITIONS, max(1, routes.shards))
    dealt_to = F.pmod(F.hash("id"), F.lit(n)).alias("p")
    own = {r.p: r.id for r in docs.sparkSession.range(40 * n).groupBy(dealt_to).agg(F.min("id").alias("id")).collect()}
    number = np.array([own.get(i, 40 * n + i) for i in range(n)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                has, size = places_of(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                rows = np.array([zlib.crc32(str(t.as_py() if i is None else i).encode()) for i, t in zip(ids, batch.column("text"), strict=True)], np.int64)
                group = shared.value.route(has, rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number[group % n]), pa.array(group), batch.column("text")], names=["doc_id", "p", "grp", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36

        def flush(names: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for part in parted(ids):
                yield shard([names[i] for i in part], [ids[i] for i in part])

        def shard(names: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal base
            pieces = without_padding(pack_shard(ids, end_id, length), length)
            last = pieces[-1][3]
            padded = np.zeros(last + 1, np.int64)
            np.add.at(padded, [p[3] for p in pieces], [p[2] for p in pieces])
            bodies = [ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces]
            cols = [
                pa.array([names[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([int(padded[p[3]]) for p in pieces], pa.int64()),
                pa.array(bodies if with_ids else [None] * len(pieces), pa.binary()),
            ]
            base += last + 1
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

        encoder, end = UnitEncoder.load(vocabulary, pattern), np.array([end_id], "<u4").tobytes()
        names, ids, held, last = [], [], 0, None
        for batch in (s for w in batches for s in slices(w, "text", 1 << 20)):
            coded = encoder.encode(batch.column("text").to_pylist())
            for doc_id, group, raw in zip(batch.column("doc_id").to_pylist(), batch.column("grp").to_pylist(), coded, strict=True):
                if ids and (group != last or held >= 1.5 * TOGETHER * SHARD):
                    yield from flush(names, ids)
                    names, ids, held = [], [], 0
                names.append(doc_id)
                ids.append(np.frombuffer(raw + end, "<u4"))
                held, last = held + len(ids[-1]), group
        if ids:
            yield from flush(names, ids)

    dealt = doc_rows(docs).mapInArrow(deal, "doc_id long, p long, grp long, text string")
    dealt = dealt.repartition(n, "p").sortWithinPartitions("grp", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, SCHEMA)
