"""Length-delimited binary records of token ids, with a separate offset index.

A data file is a run of frames: payload length (unsigned 64 bits), masked
CRC-32 of those 8 bytes, payload, masked CRC-32 of the payload.  The payload is
the document id (signed 64 bits), a byte that says whether there is one, the
bytes per id (2 or 4), and the ids.  All numbers are little-endian.  The index
file beside it has, for each record, its offset in the data file and the number
of ids before it in that file, so that records can be read in any order.

Files are written whole by one task attempt under a name of its own; only the
names a finished task returned are ever read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, shared_dir, slices
from .tokens import UnitEncoder

MAGIC = b"LDRIDX01"
HEAD = struct.Struct("<QI")
FRONT = struct.Struct("<qBB")
INDEX = np.dtype([("offset", "<u8"), ("start", "<u8")])
#: Bytes read from a data file at a time.
CHUNK = 8 << 20


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated and offset, so that checksums of data that holds
    checksums stay useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next frame begins."""
    size, check = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"bad length checksum at {at}")
    payload = data[at + HEAD.size : at + HEAD.size + size]
    end = at + HEAD.size + size
    if len(payload) != size or struct.unpack_from("<I", data, end)[0] != masked_crc(payload):
        raise ValueError(f"bad payload checksum at {at}")
    return payload, end + 4


def _payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return FRONT.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, bytes]:
    """Document id and little-endian unsigned 32-bit ids of a payload."""
    doc_id, known, width = FRONT.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=FRONT.size).astype("<u4").tobytes()


#: Bytes of text that a file is made of, about, and index entries written at a time.
FILE, ENTRIES = 32 << 20, 1 << 16
MANIFEST = "path string, records long, ids long, first_id long, first_hash long, first_deal int"


def write_records(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end_id: int = 0) -> list:
    """Write all documents in ascending ``doc_id`` order; returns the manifest,
    a row per file, in that order.

    Rows are range-partitioned by id (then by a hash of the text and of their place
    in the input, so that rows that share an id, or have none, spread), one file per
    partition, as many as ``FILE`` bytes of text make.  Rows without an id come
    last; rows equal in id and text come in either order, which shows nowhere.
    """
    held = doc_rows(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(held) // FILE))
    keyed = doc_rows(docs).withColumn("hash", F.xxhash64("text")).withColumn("deal", F.hash(F.monotonically_increasing_id()))
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("deal")]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.load(vocabulary, pattern)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, offsets, starts, at, start, first = None, array("Q"), array("Q"), 0, 0, None
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{name}.records")
                    first = tuple(batch.column(c)[0].as_py() for c in ("doc_id", "hash", "deal"))
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    data = frame(_payload(doc_id, ids, width))
                    out.write(data)
                    offsets.append(at)
                    starts.append(start)
                    at += len(data)
                    start += len(ids)
        rows = []
        if out is not None:
            out.close()
            with store.open_output_stream(f"{name}.index") as f:
                f.write(MAGIC + struct.pack("<QQ", len(offsets), at))
                for i in range(0, len(offsets), ENTRIES):
                    part = np.empty(len(offsets[i : i + ENTRIES]), INDEX)
                    part["offset"], part["start"] = offsets[i : i + ENTRIES], starts[i : i + ENTRIES]
                    f.write(part.tobytes())
            rows = [(f"{name}.records", len(offsets), start, *first)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string()] + [pa.int64()] * 4 + [pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=["path", "records", "ids", "first_id", "first_hash", "first_deal"],
        )

    files = ranged.mapInArrow(run, MANIFEST).collect()  # a row per file
    return sorted(files, key=lambda r: (r.first_id is None, r.first_id or 0, r.first_hash, r.first_deal))


def record_at(file, offset: int) -> tuple[int | None, bytes]:
    """The record whose frame begins at an offset of an open data file."""
    file.seek(offset)
    head = file.read(HEAD.size)
    payload, _ = unframe(head + file.read(HEAD.unpack(head)[0] + 4), 0)
    return parse(payload)


def read_index(store: fs.FileSystem, path: str) -> np.ndarray:
    """Offsets and starts of all records of a data file, from its index."""
    with store.open_input_file(path.removesuffix("records") + "index") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{path}: no index")
    return np.frombuffer(raw, INDEX, offset=24)


def read_records(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Read files back: ``doc_id``, ``start`` (ids of all records before it),
    ``ids`` (little-endian unsigned 32-bit).  Every checksum is verified."""
    base, rows = 0, []
    for r in manifest:
        rows.append((r.path, r.records, base))
        base += r.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(store, row["path"])
                with store.open_input_file(row["path"]) as f:
                    ends = np.append(index["offset"][1:].astype(np.int64), f.size())
                    i = 0
                    while i < len(index):
                        begin = int(index["offset"][i])
                        to = max(i + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
                        f.seek(begin)
                        data, at = f.read(int(ends[to - 1]) - begin), 0
                        ids, bodies = [], []
                        for _ in range(i, to):
                            payload, at = unframe(data, at)
                            doc_id, body = parse(payload)
                            ids.append(doc_id)
                            bodies.append(body)
                        starts = index["start"][i:to].astype(np.int64) + row["base"]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts), pa.array(bodies, pa.binary())],
                            names=["doc_id", "start", "ids"],
                        )
                        i = to

    schema = "path string, records long, base long"
    files = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def read_shuffled(spark: SparkSession, folder: str, manifest: list, seed: int = 0) -> DataFrame:
    """All records in an order fixed by ``seed``: ``(place, doc_id, ids)``.

    Only the index files are read to draw the order (by a hash of seed, file and
    offset); then each record is read at its offset, file by file within a task,
    so that neighbours in the order come from anywhere in the data.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                offset = read_index(store, path)["offset"].astype(np.int64)
                for i in range(0, len(offset), 100_000):
                    part = offset[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(part)], names=["path", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, offsets = batch.column("path").to_pylist(), batch.column("offset").to_pylist()
            found: list[tuple] = [()] * len(paths)
            for path in dict.fromkeys(paths):
                with store.open_input_file(path) as f:
                    for i in (k for k, p in enumerate(paths) if p == path):
                        found[i] = record_at(f, offsets[i])
            ids = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("place"), ids, pa.array([x[1] for x in found], pa.binary())], names=["place", "doc_id", "ids"])

    files = spark.createDataFrame([(r.path,) for r in manifest], "path string").repartition(max(1, len(manifest)))
    place = F.xxhash64(F.lit(seed), "path", "offset").alias("place")
    drawn = files.mapInArrow(entries, "path string, offset long").select(place, "path", "offset")
    return drawn.orderBy("place", "path", "offset").mapInArrow(run, "place long, doc_id long, ids binary")


def record_round_trip(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as records into the shared folder and read them back.

    Null and empty texts are records of the end id alone; an empty table
    writes no file; rows that share an id are all kept; a text of any length is one
    record, which a task holds whole; other columns fall away.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    return read_records(spark, folder, write_records(docs, folder, vocabulary, pattern, end_id))
