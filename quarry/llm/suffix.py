"""Byte-span removal through a run-length index of repetitive contexts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import with_text
from .repeats import Shard, Windows, covered, without_repeated
from .rindex import RunIndex, first_places

BYTES = 100
GRAM = 24
#: Contexts of one anchor beyond which its windows are contents of their own.
MOST = 8_000
#: Bytes of contents indexed together, about; an anchor's stay together.
PART = 1 << 17


def first_places_of(shard: Shard, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The content, and the place in it, where each window of each content
    occurs first in document order."""
    index = RunIndex(shard.bodies)
    size = np.diff(np.append(index.starts, index.n))
    # Places by document, then by where they lie in it; a document's contents
    # follow each other.
    new = np.ones(len(shard), bool)
    new[1:] = (shard.doc[1:] != shard.doc[:-1]) | (shard.none[1:] != shard.none[:-1])
    source = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    line = (group << 40) + shard.start - index.starts
    first = first_places(index, spec.length, np.arange(index.n) + np.repeat(line, size))
    # Places where a window begins: the last ones of a content are no such.
    windows = size - spec.length
    at = np.repeat(index.starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    of = source[first[at] >> 40]
    return of, (first[at] & ((1 << 40) - 1)) - shard.start[of], windows


def remove_repeated_bytes(docs: DataFrame, length: int = BYTES, gram: int = GRAM, buckets: int | None = None, whole_rows: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``
    (bytes: a cut may fall inside a character; with ``whole_rows`` text without
    the rests of such characters, and the row as it came in ``_row``).

    A byte goes if one of the strings of ``length`` bytes over it starts
    earlier as well: in a document with a smaller id, or further left in the
    same one.  Rows that share an id and a start are not earlier than each
    other; rows without an id come last, as one document.  Null and empty texts
    have no bytes; texts of any length are read whole; extra columns are ignored
    (kept in ``_row``); an empty table gives an empty result.  Strings are
    compared byte by byte, not by hashes.
    """
    spec = Windows(length, gram, words=False, within=True, most=MOST)

    def cut(text: str, found: bytes | None) -> tuple:
        raw = text.encode()
        if not found:
            return len(raw), 0, 0, text if whole_rows else raw
        gone = covered(found, len(raw), length)
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return len(raw), int(gone.sum()), n_spans, kept.decode("utf-8", "ignore") if whole_rows else kept

    kind = "string" if whole_rows else "binary"
    schema = f"n_bytes long, n_removed long, n_spans long, kept {kind}"
    return without_repeated(docs, spec, first_places_of, PART, cut, schema, buckets, whole_rows)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated bytes removed from their texts."""
    return with_text(remove_repeated_bytes(docs, whole_rows=True), docs, "kept")
