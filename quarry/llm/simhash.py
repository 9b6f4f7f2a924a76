"""SimHash near-duplicates, linked through sharded BK-trees.

Fingerprints within two bits of each other agree on at least two of four
16-bit blocks, so each distinct fingerprint joins the six shards named by a
pair of blocks and its value there.  A shard is one BK-tree: children hang on
the integer distance to their parent and a search follows only edges within
the radius of its own distance.  Shards above ``SHARD`` members are cut again
by the same rule on the bits not yet fixed (8-bit, then 4-bit blocks), after
which at most 256 distinct values can share a shard: no shard is unbounded
and no pair is lost.  A shard's answer is a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, keyed_rows, row_key, same_row, slices, staged
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD = 1024


def shingle_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of each 3-word shingle of UTF-8 text, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bitwise majority (over half) of the hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 17):
        bits = np.unpackbits(hashes[at : at + (1 << 17)].view(np.uint8), bitorder="little")
        total += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            found = [fingerprint(shingle_hashes(t.encode())) for t in batch.column("text").to_pylist()]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), signed], names=["doc_id", "key", "fp"])


class BkTree:
    """A node, and its subtrees by integer Hamming distance to it."""

    __slots__ = ("value", "at", "children")

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.value, self.at, self.children = values[0], int(at[0]), {}
        rest, where = values[1:], at[1:]
        if len(rest):
            far = np.bitwise_count(rest ^ self.value)
            for d in np.unique(far):
                own = far == d
                self.children[int(d)] = BkTree(rest[own], where[own])

    def search(self, values: np.ndarray, at: np.ndarray, radius: int, found: list) -> None:
        """Append ``(query places, node place)`` for all within the radius."""
        far = np.bitwise_count(values ^ self.value).astype(np.int16)
        near = at[far <= radius]
        if len(near):
            found.append((near, self.at))
        for d, child in self.children.items():
            go = np.abs(far - d) <= radius
            if go.any():
                child.search(values[go], at[go], radius, found)


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all of a shard's values within the radius."""
    n = len(values)
    v, at, found = np.array(values, np.int64).view(np.uint64), np.arange(n), []
    BkTree(v, at).search(v, at, radius, found)
    top = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    links = []
    for near, node in found:
        for i in near.tolist():
            a, b = root(i), root(node)
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((values[i], values[node]))
    return links


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [link for values in batch.column("members").to_pylist() for link in spanning_links(values)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs(free: list[int], size: int) -> list[tuple[int, list[int]]]:
    """Ways to fix two of four blocks of the free bits: (mask, bits left)."""
    blocks = [free[i : i + size] for i in range(0, 4 * size, size)]
    return [
        (sum(1 << b for i in two for b in blocks[i]), [b for i in range(4) if i not in two for b in blocks[i]])
        for two in combinations(range(4), 2)
    ]


def _levels() -> list[dict[int, list[int]]]:
    """For each level, the finer masks that a mask is cut into."""
    first = _pairs(list(range(64)), 16)
    out, now = [{0: [m for m, _ in first]}], first
    for size in (8, 4):
        cut, nxt = {}, []
        for mask, left in now:
            finer = [(mask | m, rest) for m, rest in _pairs(left, size)]
            cut[mask] = [m for m, _ in finer]
            nxt += finer
        out.append(cut)
        now = list(dict(((m, (m, r)) for m, r in nxt)).values())
    return out


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect distinct fingerprints ``fp`` within the radius."""
    links, todo = None, fps.select("fp", F.lit(0).cast("long").alias("mask"))
    levels = _levels()
    for depth, cut in enumerate(levels):
        if depth == 0:
            finer = F.array(*(F.lit(_signed(m)) for m in cut[0]))
        else:
            finer = F.element_at(
                F.create_map(*(x for m, into in cut.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(i)) for i in into))))),
                F.col("mask"),
            )
        keyed = todo.select("fp", F.explode(finer).alias("mask")).select(
            "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")
        ).distinct()
        size = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        sized = keyed.join(size, ["mask", "value"])
        last = depth == len(levels) - 1
        if not last:
            sized = staged(sized, "shards")
        shards = (sized if last else sized.where(F.col("n") <= SHARD)).groupBy("mask", "value").agg(
            F.sort_array(F.collect_set("fp")).alias("members")
        )
        own = shards.select("members").mapInArrow(_shard_links, "a long, b long")
        links = own if links is None else links.unionByName(own)
        if last:
            break
        todo = sized.where(F.col("n") > SHARD).select("fp", "mask")
        if todo.isEmpty():
            break
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over fingerprint links.
    Null and empty texts have fingerprint zero.  Rows without an id take part
    and carry their group's smallest id, null if none has one.  Repeated rows
    each give a row; texts of any length are hashed whole, some shingles at a
    time; extra columns are ignored; an empty table gives an empty result.
    """
    marks, member = _members(docs)
    return marks.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints; fingerprints with their component's
    smallest id and the row (by id, null last, then key) that stands for it."""
    keyed = doc_rows(docs).withColumn("key", row_key())
    marks = staged(keyed.mapInArrow(_marks, "doc_id long, key long, fp long"), "marks")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")
    fps = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(first).alias("first"))
    roots = connected_components(fingerprint_links(fps))
    by_fp = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", "first", F.coalesce("root", "fp").alias("root"))
    lowest = by_fp.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first").alias("stays"))
    return marks, by_fp.join(lowest, "root").select("fp", "component_id", "stays")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole: one of each component, that with the
    smallest id (without ids, with the smallest hash of its text).  Of rows
    equal in id and text the first by their other columns, written as JSON,
    stays, so that every run keeps the same row."""
    _, member = _members(docs)
    stays = member.select(F.col("stays.id").alias("doc_id"), F.col("stays.key").alias("key")).distinct()
    found = keyed_rows(docs).alias("d").join(stays.alias("s"), same_row("d", "s"), "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"row.`{c}`") for c in docs.columns if c != "text")))
    return found.groupBy("doc_id", "key").agg(F.min_by("row", others).alias("row")).select("row.*")
