"""Byte-level BPE as a monoid: encode halves, join at a re-encoded boundary.

The split pattern consumes a text left to right and its matches ("pieces")
depend only on what follows a match's start, so

* pieces of the left half stay as they are unless they, or what the pattern
  looked at behind them, touch the cut, and
* once a piece of the joined text starts where a piece of the right half
  starts, all later pieces are those of the right half.

A join re-splits from the last safe piece of the left half, through a window
that doubles until both conditions hold inside it, and encodes only the pieces
of that window again.  Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import doc_rows, slices

#: Characters a leaf holds at most; longer texts become trees.
LEAF = 1 << 10
WINDOW = 64
#: Characters behind a match's end that the split pattern can look at: two
#: for a contraction that did not come about, one for a white-space run.
LOOK = 3


@dataclass
class Codec:
    """Ranks and split pattern of a byte-level BPE."""

    encoding: tiktoken.Encoding
    pattern: regex.Pattern

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Codec(own, regex.compile(pattern))

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text).astype(np.uint32, copy=False)

    def pieces(self, text: str, starts: list[int], end: int) -> np.ndarray:
        """Ids of known pieces, each by itself: what follows a piece decides
        where it ends, so a slice must not be split anew."""
        ends = [*starts[1:], end]
        one = self.encoding._encode_single_piece
        return np.array([i for a, b in zip(starts, ends, strict=True) for i in one(text[a:b])], np.uint32)


@dataclass
class Node:
    """An encoded span: its text, where its pieces start, ids by part.

    ``ids`` holds arrays for consecutive runs of pieces; ``at`` the first
    character of each run.  Runs are cut where a join needs it.
    """

    text: str
    starts: list[int]
    at: list[int]
    ids: list[np.ndarray]


def _leaf(codec: Codec, text: str) -> Node:
    starts = [m.start() for m in codec.pattern.finditer(text)]
    return Node(text, starts, [0], [codec.ids(text)])


def _within(node: Node, a: int, b: int) -> list[int]:
    return node.starts[bisect.bisect_left(node.starts, a) : bisect.bisect_left(node.starts, b)]


def _until(codec: Codec, node: Node, cut: int) -> tuple[list[int], list[np.ndarray]]:
    """Runs of a node before piece start ``cut``; the one around it is cut."""
    k = bisect.bisect_left(node.at, cut)
    at, ids = node.at[:k], node.ids[:k]
    if k and (k == len(node.at) or node.at[k] != cut):
        end = node.at[k] if k < len(node.at) else len(node.text)
        behind = codec.pieces(node.text, _within(node, cut, end), end)
        ids[-1] = ids[-1][: len(ids[-1]) - len(behind)]
    return at, ids


def _from(codec: Codec, node: Node, cut: int) -> tuple[list[int], list[np.ndarray]]:
    """Runs of a node from piece start ``cut`` on; the one around it is cut."""
    if cut >= len(node.text):
        return [], []
    k = bisect.bisect_right(node.at, cut) - 1
    at, ids = [cut, *node.at[k + 1 :]], node.ids[k:]
    if node.at[k] != cut:
        before = codec.pieces(node.text, _within(node, node.at[k], cut), cut)
        ids = [ids[0][len(before) :], *ids[1:]]
    return at, ids


def join(codec: Codec, left: Node, right: Node) -> Node:
    """The node of the concatenated text."""
    if not left.text or not right.text:
        return right if not left.text else left
    text, edge = left.text + right.text, len(left.text)
    first = len(left.starts) - 1
    while first > 0 and left.starts[first] > edge - LOOK:
        first -= 1
    safe = left.starts[first]
    known = set(right.starts)
    width = WINDOW
    while True:
        end = min(len(text), edge + width)
        window, fresh, meet = text[safe:end], [], None
        for m in codec.pattern.finditer(window):
            p = safe + m.start()
            if p >= edge and p - edge in known:
                meet = p
                break
            # A match that ends this close to the window's end could be
            # longer, or other, with more text in view.
            if safe + m.end() > end - LOOK and end < len(text):
                break
            fresh.append(p)
        else:
            meet = len(text) if end == len(text) else None
        if meet is not None:
            break
        width *= 2
    at_l, ids_l = _until(codec, left, safe)
    at_r, ids_r = _from(codec, right, meet - edge)
    mid = codec.pieces(text, fresh, meet) if fresh else np.zeros(0, np.uint32)
    j = bisect.bisect_left(right.starts, meet - edge)
    return Node(
        text,
        left.starts[:first] + fresh + [edge + p for p in right.starts[j:]],
        at_l + [safe] + [edge + p for p in at_r],
        [*ids_l, mid, *ids_r],
    )


def encode_tree(codec: Codec, text: str, leaf: int = LEAF) -> Node:
    """Encode halves recursively, joining neighbours on the way up."""
    if len(text) <= leaf:
        return _leaf(codec, text)
    half = len(text) // 2
    return join(codec, encode_tree(codec, text[:half], leaf), encode_tree(codec, text[half:], leaf))


def encode(codec: Codec, text: str, leaf: int = LEAF) -> np.ndarray:
    """Ids of a whole text; a text of one leaf needs no piece positions."""
    if len(text) <= leaf:
        return codec.ids(text)
    return np.concatenate(encode_tree(codec, text, leaf).ids)


def decode(codec: Codec, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    """Bytes of a sequence of ids, concatenated up the tree."""
    if len(ids) <= leaf:
        return codec.encoding.decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode(codec, ids[:half], leaf) + decode(codec, ids[half:], leaf)


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (uint32, little-endian), ``decoded`` bytes.

    A map over rows: no shuffle, and memory for one 8 MB run of rows (or one
    longer text) at a time.  Null and empty texts have no ids; rows that repeat
    give theirs each; other columns fall away; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                ids = [encode(codec, t, leaf) for t in batch.column("text").to_pylist()]
                back = [decode(codec, x, leaf) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array(back, pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return doc_rows(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def bpe_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """As :func:`bpe_round_trip`, without decoding."""
    return bpe_round_trip(docs, ranks, pattern).select("doc_id", "ids")


def default_paths() -> tuple[str, str]:
    """The installed multilingual vocabulary and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
