"""Shared plumbing: staging tables, document selection, byte views of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without an id order after all others in operators that need an order.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a session whose tasks all run in this process gets a
    temporary folder; on a cluster it is an error, as executors would each
    write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: list[list] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end, unless ``kept``."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            release(df)


def kept(df: DataFrame) -> DataFrame:
    """A staged table that outlives the ``scratch`` it was staged in."""
    for inside in _scratch:
        inside[:] = [d for d in inside if d is not df]
    return df


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage with
    files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    kept(df)
    spark, path = df.sparkSession, spark_path(df.sparkSession, df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spark_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def doc_rows(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty), nothing else; with
    ``carry`` the row as it came, in one struct ``_row``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")] if carry else []),
    )


def carried(df: DataFrame) -> tuple[str, str]:
    """Name and DDL of the carried struct, for schemas; empty without one."""
    if "_row" not in df.columns:
        return "", ""
    return "_row", f", _row {df.schema['_row'].dataType.simpleString()}"


def with_text(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows as they came, with a new text and, where there is one, a new
    ``n_chars``."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def row_key() -> F.Column:
    """A hash of the text that, beside the id, tells rows apart; never null."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, the row's ``key`` and the row as it came, in a struct ``row``
    (whatever its columns are called)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key().alias("key"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


def same_row(a: str, b: str) -> F.Column:
    """Whether two aliased tables' ``doc_id`` (null like null) and ``key`` agree."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``n + 1`` offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    off = off.astype(np.int64)
    if not len(off):
        return raw[:0], np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of at most ``limit`` text bytes
    (a single longer row stands alone)."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
