"""Media columns: bytes as AVI motion-JPEG, read back frame by frame.

A payload is cut into frames of 24 x 24 grey samples.  Each frame is a
lossless JPEG (process 14, predictor 1: the left neighbour) and stands alone,
so every frame is an intra frame; an AVI file holds them in ``00dc`` chunks
with an ``idx1`` index.  Reading parses the RIFF lists and the index, decodes
the frames it lists, and cuts the film into shots where the histogram
difference of neighbours stands out from those around it.

Frames of many documents are coded in step: one array operation handles the
same sample of all of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_rows, slices

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
FILL = 255
#: Text bytes coded at a time.
BATCH = 1 << 20
#: Huffman code lengths of the difference categories 0 to 8; text has many
#: differences of 7 bits (letter to space).
LENGTHS = {0: 3, 1: 4, 2: 4, 3: 3, 4: 3, 5: 3, 6: 4, 7: 2, 8: 5}
PEEK = 13
BINS = 16


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: category to (code, length)."""
    code, last, out = 0, 0, {}
    for n, category in sorted((n, c) for c, n in lengths.items()):
        code <<= n - last
        out[category] = (code, n)
        code, last = code + 1, n
    return out


def _table(lengths: dict[int, int]) -> bytes:
    """A DHT segment's body."""
    order = [c for _, c in sorted((n, c) for c, n in lengths.items())]
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes([0, *counts, *order])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head() -> bytes:
    """All of a frame before its entropy-coded data."""
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            _segment(0xC4, _table(LENGTHS)),
            _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])),
        )
    )


@lru_cache(maxsize=1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference, at difference + 255."""
    codes, bits, size = _codes(LENGTHS), np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << n) - 1
        code, length = codes[n]
        bits[d + 255], size[d + 255] = code << n | extra, length + n
    return bits, size


@lru_cache(maxsize=8)
def _decoder(head: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Difference and bit count by the next 13 bits; height and width."""
    at, height, width, lengths = 2, 0, 0, {}
    if head[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while True:
        mark, kind, size = struct.unpack_from(">BBH", head, at)
        body = head[at + 4 : at + 2 + size]
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("one component of 8 bits is expected")
        elif kind == 0xC4:
            at_value = 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    lengths[body[at_value]] = n
                    at_value += 1
        elif kind == 0xDA:
            if body[3] != 1:
                raise ValueError("predictor 1 is expected")
            break
        at += 2 + size
    diff, used = np.zeros(1 << PEEK, np.uint8), np.zeros(1 << PEEK, np.int64)
    for category, (code, length) in _codes(lengths).items():
        total = length + category
        if total > PEEK:
            continue
        for extra in range(1 << category):
            d = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
            first = (code << category | extra) << (PEEK - total)
            diff[first : first + (1 << (PEEK - total))] = d & 255
            used[first : first + (1 << (PEEK - total))] = total
    return diff, used, height, width


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each row of 576 samples."""
    n = len(samples)
    grid = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    table, width = _encoder()
    at = (diff + 255).reshape(n, FRAME)
    bits, size = table[at], width[at]
    for _ in range(2):  # two, then four samples to a word
        bits = bits[:, ::2] << size[:, 1::2] | bits[:, 1::2]
        size = size[:, ::2] + size[:, 1::2]
    ends = np.cumsum(size, axis=1)
    starts = (ends - size).astype(np.int64)
    words = np.zeros((n, FRAME * PEEK // 64 + 3), np.uint64)
    rows = np.arange(n)
    left, where = (starts & 63).astype(np.uint64), starts >> 6
    room = np.uint64(64) - left
    for j in range(bits.shape[1]):
        b, s, r = bits[:, j], size[:, j], room[:, j]
        over = s > r
        high = np.where(over, b >> np.where(over, s - r, 0), b << np.where(over, 0, r - s))
        low = np.where(over, b << np.where(over, np.uint64(64) - (s - r), 0), 0)
        words[rows, where[:, j]] |= high
        words[rows, where[:, j] + 1] |= low
    total = ends[:, -1].astype(np.int64)
    # The last byte is filled up with ones.
    raw = words.astype(">u8").view(np.uint8).reshape(n, -1)
    count = -(-total // 8)
    raw[rows, count - 1] |= ((1 << (count * 8 - total)) - 1).astype(np.uint8)
    flat = raw[np.arange(raw.shape[1]) < count[:, None]]
    twice = 1 + (flat == 0xFF)
    out = np.repeat(flat, twice)
    out[np.cumsum(twice)[twice == 2] - 1] = 0
    edges = np.cumsum(np.add.reduceat(twice, np.cumsum(count) - count)).tolist()
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *edges], edges, strict=False)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of JPEG frames, a row each."""
    size = len(jpeg_head())
    head = frames[0][:size]
    scans = [f[size:-2] for f in frames]
    if any(f[:size] != head or f[-2:] != b"\xff\xd9" for f in frames):
        raise ValueError("frames differ in their headers or are cut short")
    diff, used, height, width = _decoder(head)
    if (height, width) != (SIDE, SIDE):
        raise ValueError("unexpected frame size")
    raw = np.frombuffer(b"".join(scans) + bytes(4), np.uint8)
    stuffed = np.flatnonzero(raw[:-1] == 0xFF) + 1
    stuffed = stuffed[raw[stuffed] == 0]
    begins = np.cumsum([0] + [len(s) for s in scans])[:-1]
    begins = begins - np.searchsorted(stuffed, begins)
    raw = np.delete(raw, stuffed).astype(np.uint32)
    raw = np.concatenate((raw, np.zeros(4, np.uint32)))
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = begins.astype(np.int64) * 8
    out = np.empty((FRAME, len(frames)), np.uint8)
    for j in range(FRAME):
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - PEEK)
        before = out[j - 1] if j % SIDE else out[j - SIDE] if j else np.uint8(128)
        out[j] = diff[key] + before
        at += used[key]
    return np.ascontiguousarray(out.T)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(scans: list[bytes], size: int) -> bytes:
    """An AVI file of frames; ``size`` is kept as the payload's true length."""
    head = jpeg_head()
    chunks, index, at, most = [], [], 4, 0
    for scan in scans:
        body = b"".join((head, scan, b"\xff\xd9"))
        chunk = _chunk(b"00dc", body)
        index.append((at, len(body)))
        chunks.append(chunk)
        at += len(chunk)
        most = max(most, len(body))
    n = len(scans)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 10_000, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    lists = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    entry = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    entry["id"], entry["flags"] = b"00dc", 0x10
    entry["at"], entry["size"] = zip(*index, strict=True)
    body = b"".join(
        (b"AVI ", lists, _chunk(b"qlen", struct.pack("<Q", size)), _list(b"movi", b"".join(chunks)), _chunk(b"idx1", entry.tobytes()))
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """Frames by the index of an AVI file, its rate, and the stored length."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index, rate, size = 12, 0, None, 0, -1
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            name = data.index(b"strh", at) + 8
            scale, per = struct.unpack_from("<II", data, name + 20)
            rate = per // scale
        elif kind == b"idx1":
            index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), n // 16, at + 8)
        elif kind == b"qlen":
            size = struct.unpack_from("<Q", data, at + 8)[0]
        at += 8 + n + (n & 1)
    if index is None or not movi:
        raise ValueError("no index")
    starts = (index["at"].astype(np.int64) + movi + 8).tolist()
    return [data[a : a + n] for a, n in zip(starts, index["size"].tolist(), strict=True)], rate, size


def shots(frames: np.ndarray, first: np.ndarray, span: int = 4) -> np.ndarray:
    """Whether a shot begins at each frame; ``first`` marks films' starts.

    The difference of a frame to the one before it is the sum of absolute
    differences of their 16-bin histograms.  It begins a shot if it is more
    than twice the mean of the differences up to ``span`` frames away in the
    same film, itself left out, and more than a fourth of the samples.  All
    in whole numbers.
    """
    n = len(frames)
    hist = np.bincount(((frames >> 4) + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    step = np.zeros(n, np.int64)
    step[1:] = np.abs(np.diff(hist, axis=0)).sum(1)
    step[first] = 0
    film = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], n)
    total = np.concatenate(([0], np.cumsum(step)))
    at = np.arange(n)
    a = np.maximum(at - span, begins[film] + 1)
    b = np.minimum(at + span + 1, ends[film])
    around, count = total[b] - total[np.minimum(a, b)] - step, np.maximum(b - a - 1, 0)
    return first | ((step * count > 2 * around) & (4 * step > FRAME) & (count > 0))


def media_column(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id`` and ``media``, an AVI file of the text's UTF-8 bytes
    filled up with 255 to a positive multiple of a frame.

    A map over rows.  Null and empty texts are one frame of filling; equal
    texts give equal files; other columns fall away; an empty table gives no rows.
    A text is one file, which a task holds whole; the format's sizes have 32 bits,
    so a file of 4 GB or more is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH):
                raws = [t.encode() for t in batch.column("text").to_pylist()]
                films = [max(1, -(-len(r) // FRAME)) for r in raws]
                data = b"".join(r.ljust(n * FRAME, bytes([FILL])) for r, n in zip(raws, films, strict=True))
                samples = np.frombuffer(data, np.uint8).reshape(-1, FRAME)
                scans = [s for at in range(0, len(samples), 4096) for s in encode_frames(samples[at : at + 4096])]
                out, at = [], 0
                for raw, n in zip(raws, films, strict=True):
                    out.append(avi(scans[at : at + n], len(raw)))
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "media"])

    return doc_rows(docs).mapInArrow(run, "doc_id long, media binary")


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per film: id, file, payload with filling, stored length, rate, shots."""
    files = batch.column("media").to_pylist()
    at = 0
    while at < len(files):
        to, held = at, 0
        films = []
        while to < len(files) and (to == at or held < BATCH):
            films.append(read_avi(files[to]))
            held += len(films[-1][0]) * FRAME
            to += 1
        frames = [f for film in films for f in film[0]]
        samples = np.concatenate([decode_frames(frames[i : i + 4096]) for i in range(0, len(frames), 4096)])
        first = np.zeros(len(samples), bool)
        begins = np.cumsum([0] + [len(f[0]) for f in films])
        first[begins[:-1]] = True
        cuts = shots(samples, first)
        for k, (got, rate, size) in enumerate(films):
            a, b = begins[k], begins[k + 1]
            yield at + k, files[at + k], samples[a:b], size, rate, np.flatnonzero(cuts[a:b]), len(got)
        at = to


def clip_rows(media: DataFrame) -> DataFrame:
    """A row per shot: ``doc_id``, ``clip``, first frame and end, times in
    seconds, and the mean histogram of its frames as ``levels``.

    Rows without a film have no shots; the film of an empty text is one frame of
    filling and one shot; rows that repeat give their shots again; a film of any
    length is read whole; other columns fall away; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for i, _, samples, _, rate, cuts, n in _read(batch):
                for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True)):
                    levels = np.bincount(samples[a:b].ravel() >> 4, minlength=BINS) // (b - a)
                    rows.append((ids[i].as_py(), k, a, b, a / rate, b / rate, levels.tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "levels"],
            )

    return media.where("media IS NOT NULL").select("doc_id", "media").mapInArrow(
        run, "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double, levels array<long>"
    )


def film_features(media: DataFrame) -> DataFrame:
    """A row per film, from its stored bytes: true and stored payload length,
    hashes of payload and file, and ``feature``: frames, the shots' first
    frames, and a checksum of all frames' histograms.

    Rows without a film are left out; else as :func:`clip_rows`.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, file, samples, size, rate, cuts, n in _read(batch):
                payload = samples.tobytes()
                levels = np.bincount(samples.ravel() >> 4, minlength=BINS)
                feature = f"frames={n};rate={rate};shots={'+'.join(map(str, cuts.tolist()))};levels={'+'.join(map(str, levels.tolist()))}"
                rows.append(
                    (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature)
                )
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.where("media IS NOT NULL").select("doc_id", "media").mapInArrow(run, schema)
