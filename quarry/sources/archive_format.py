"""Tar archives as a Spark format: batch source, stream source and sink.

``spark.read.format("archive")`` has a partition for each archive,
``spark.readStream.format("archive")`` reads each archive once, in the order of
arrival, and ``df.write.format("archive")`` writes archives whose manifest is
published by the commit of the job.
"""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

SCHEMA = "archive string, member string, content binary"
NAMES = ["archive", "member", "content"]
MANIFEST = "archive string, path string, members long"
_ENDS = (".tar", ".tar.gz", ".tgz", ".tar.zst")
#: Bytes of members that a batch holds at most, but for a larger member alone.
BATCH = 8 << 20
#: Where a folder of archives keeps what its writers say of them.
_SAID, _DONE = "_manifests", "_committed"


def opened_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def arrivals(path: str) -> list[tuple[int, str]]:
    """``(modified, path)`` of the archives of a folder, or of those that a path
    with wildcards names, oldest first.  Of a folder that this format has written
    only archives of committed jobs count, from when these were committed."""
    scheme = re.match(r"^[a-z0-9+]+://|^file:", path)
    store, full = opened_store(path)
    parts = full.split("/")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    base = "/".join(parts[:wild]) or "/"
    own = lambda p: f"{scheme[0]}{p}" if scheme else p
    if wild == len(parts) and (jobs := _committed(store, full)):
        return sorted((t, own(d["path"])) for t, said in jobs.values() for d in _entries(store, full, said))
    listed = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if wild < len(parts) else None
    if listed is None:
        one = store.get_file_info(full)
        listed = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(full, recursive=True, allow_not_found=True))
    fits = lambda p: len(p.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, p.split("/"), parts)) if wild < len(parts) else p.endswith(_ENDS) or p == full
    return sorted((f.mtime_ns or 0, own(f.path)) for f in listed if f.type == fs.FileType.File and fits(f.path))


def _committed(store: fs.FileSystem, root: str) -> dict[str, tuple[int, list[str]]]:
    """Committed jobs: when, and the names of their manifests."""
    jobs = {}
    for f in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{_DONE}", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as body:
                jobs[f.base_name.removesuffix(".json")] = (f.mtime_ns or 0, json.loads(body.read()))
    return jobs


def _entries(store: fs.FileSystem, root: str, names: list[str]) -> Iterator[dict]:
    for name in names:
        with store.open_input_stream(f"{root.rstrip('/')}/{_SAID}/{name}") as body:
            yield from map(json.loads, body.read().decode().splitlines())


def members(path: str, suffix: str = "") -> Iterator[tuple[str, str, bytes]]:
    """Files of a plain, gzip or zstd tar in any store that pyarrow opens, streamed."""
    store, name = opened_store(path)
    with store.open_input_file(name) as f:
        head = f.read(4)
    kind = "zstd" if head == b"\x28\xb5\x2f\xfd" else "gzip" if head[:2] == b"\x1f\x8b" else None
    with store.open_input_stream(name, compression=kind) as f, tarfile.open(fileobj=f, mode="r|") as tar:
        for m in tar:
            if m.isfile() and m.name.endswith(suffix):
                yield path, m.name, tar.extractfile(m).read()


def batches(path: str, suffix: str = "") -> Iterator[pa.RecordBatch]:
    """The same, some members at a time."""
    held: list[tuple[str, str, bytes]] = []
    size = 0
    kinds = [pa.string(), pa.string(), pa.binary()]
    for row in members(path, suffix):
        held.append(row)
        size += len(row[2])
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=NAMES)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        # Without an archive one empty partition, which reads nothing.
        return [InputPartition(p) for _, p in sorted(arrivals(self.path), key=lambda x: x[1])] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.value is not None:
            yield from batches(partition.value, self.suffix)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and name of the last archive that arrived; an archive
    has to come into its folder whole (by a rename) and later than those before."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.last = (0, "")

    @staticmethod
    def _of(offset: dict) -> tuple[int, str]:
        return int(offset["modified"]), offset["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        there = arrivals(self.path)
        self.last = max(self.last, there[-1] if there else (0, ""))
        return {"modified": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = self._of(start), self._of(end)
        self.last = max(self.last, last)
        return [InputPartition(p) for t, p in arrivals(self.path) if first < (t, p) <= last]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.value, self.suffix)


@dataclass
class _Written(WriterCommitMessage):
    """What one task has written: its manifest's path, and all its files."""

    manifest: str | None
    files: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are appended; write into a new folder to replace")
        self.folder, self.job = options["path"].rstrip("/"), options.get("job") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A tar for each run of rows of one archive, members streamed; then the
        task's manifest.  Names carry the attempt, so attempts never meet."""
        store, root = opened_store(self.folder)
        attempt = f"{self.job}-{TaskContext.get().taskAttemptId()}"
        now, out, tar, n, done, files = None, None, None, 0, [], []

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()
                done.append({"archive": now, "path": files[-1], "members": n})

        try:
            for batch in iterator:
                for name, file, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in NAMES), strict=True):
                    if tar is None or name != now:
                        close()
                        store.create_dir(root, recursive=True)
                        now, n = name, 0
                        safe = re.sub(r"[^A-Za-z0-9._=-]", "_", str(name))
                        files.append(f"{root}/{safe}-{attempt}-{len(files)}.tar")
                        out = store.open_output_stream(files[-1])
                        tar = tarfile.open(fileobj=out, mode="w|")
                    info = tarfile.TarInfo(file)
                    info.size = len(body or b"")
                    tar.addfile(info, io.BytesIO(body or b""))
                    n += 1
            close()
            if not done:
                return _Written(None)
            store.create_dir(f"{root}/{_SAID}", recursive=True)
            manifest = f"{root}/{_SAID}/{attempt}.json"
            with store.open_output_stream(manifest) as f:
                f.write("".join(json.dumps(d) + "\n" for d in done).encode())
            return _Written(manifest, files)
        except BaseException:
            _removed(store, files)
            raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One file that names the manifests of finished tasks: with it all of the
        job's archives are there, before it none is."""
        store, root = opened_store(self.folder)
        store.create_dir(f"{root}/{_DONE}", recursive=True)
        names = [posixpath.basename(m.manifest) for m in messages if m is not None and m.manifest]
        with store.open_output_stream(f"{root}/{_DONE}/.{self.job}") as f:
            f.write(json.dumps(names).encode())
        store.move(f"{root}/{_DONE}/.{self.job}", f"{root}/{_DONE}/{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = opened_store(self.folder)
        for m in messages:
            if m is not None:
                _removed(store, [*m.files, *([m.manifest] if m.manifest else [])])


def _removed(store: fs.FileSystem, files: list[str]) -> None:
    for name in files:
        if store.get_file_info(name).type == fs.FileType.File:
            store.delete_file(name)


class ArchiveSource(DataSource):
    """``spark.dataSource.register(ArchiveSource)`` gives the format ``archive``:
    options ``path`` (a folder, an archive, or a path with wildcards) and, to read,
    ``suffix`` of the members wanted; rows to write are to be grouped by
    ``archive`` (:func:`quarry.sources.sinks.write_archives` does so)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def manifest(spark: SparkSession, folder: str, job: str | None = None) -> DataFrame:
    """``(archive, path, members)`` of the archives of committed jobs (or of one)."""
    folder = folder.rstrip("/")
    jobs = _committed(*opened_store(folder))
    found = [f"{folder}/{_SAID}/{n}" for name, (_, said) in jobs.items() if job in (None, name) for n in said]
    return spark.read.schema(MANIFEST).json(found) if found else spark.createDataFrame([], MANIFEST)
