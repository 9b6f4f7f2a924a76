"""Index files of filings: pipe-delimited quarterly, fixed-width daily."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.codecs import unpack_bytes

MASTER = "path string, cik long, company string, form string, filing_date date, filename string"


def _unzipped(data: bytes) -> bytes:
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return b"\n".join(z.read(n) for n in z.namelist())
    return unpack_bytes(data) or b""


#: Bytes of an index file that are taken apart at once.
PIECE = 1 << 20


def _pieces(data) -> Iterator[bytes]:
    """Whole lines of a file, some at a time."""
    view, at = pa.py_buffer(data), 0
    while at < view.size:
        piece = view.slice(at, min(PIECE, view.size - at)).to_pybytes()
        while at + len(piece) < view.size and b"\n" not in piece:
            piece += view.slice(at + len(piece), min(PIECE, view.size - at - len(piece))).to_pybytes()
        if at + len(piece) < view.size:
            piece = piece[: piece.rindex(b"\n") + 1]
        at += len(piece)
        yield piece


def _master_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.date32(), pa.string()]
    names = ["path", "cik", "company", "form", "filing_date", "filename"]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_buffer()
            packed = data.slice(0, min(4, data.size)).to_pybytes()
            # A plain file is read where it lies; a packed one is unpacked first.
            if packed.startswith((b"PK\x03\x04", b"\x28\xb5\x2f\xfd", b"\x1f\x8b", b"\x78")):
                data = _unzipped(data.to_pybytes())
            for piece in _pieces(data):
                lines = (x.split("|") for x in piece.decode("latin1").splitlines())
                rows = [[c.strip() for c in x] for x in lines if len(x) == 5 and x[0].strip().isdigit()]
                if not rows:
                    continue
                cik, company, form, filed, file = zip(*rows, strict=True)
                days = pd.to_datetime(pd.Series(filed, dtype=object), errors="coerce").dt.date
                columns = [[path.as_py()] * len(rows), [int(x) for x in cik], company, form, days, file]
                yield pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds, strict=True)], names=names)


def master_index(spark: SparkSession, paths: str | list[str], base_url: str = "") -> DataFrame:
    """Rows of quarterly index files (plain, zipped or gzipped), with the
    accession number and the addresses derived from it.  Lines that are no
    rows (header, rule) have no five fields or no number in front."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(_master_rows, MASTER)
    accession = T.accession_of("filename")
    folder = F.regexp_replace("filename", "/[^/]*$", "")
    return rows.withColumns(
        {
            "accession_number": accession,
            "text_url": T.join_url(F.lit(base_url), "filename"),
            "document_url": T.join_url(F.lit(base_url), F.concat_ws("/", folder, T.no_dashes(accession), F.concat(accession, F.lit(".txt")))),
            "homepage_url": T.join_url(F.lit(base_url), F.concat_ws("/", folder, T.no_dashes(accession), F.concat(accession, F.lit("-index.html")))),
        }
    )


def quarters(spark: SparkSession, root: str, years: list[int]) -> DataFrame:
    """Index files of whole years under ``root/year/QTRn``; quarters that are
    not there are skipped."""
    out = None
    for y in years:
        for q in range(1, 5):
            try:
                one = master_index(spark, f"{root}/{y}/QTR{q}/*").withColumns({"year": F.lit(y), "quarter": F.lit(q)})
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], MASTER)


DAILY = ["Form Type", "Company Name", "CIK", "Date Filed", "File Name"]


def daily_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a fixed-width index; column places come from its header line,
    which is small and read first."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("Form"))).first()
    if head is None:
        raise ValueError(f"{path}: no header line")
    header = head["value"]
    if "Form Type" not in header:
        header = header.replace("Form     ", "Form Type", 1)
    at = sorted((header.index(c), c) for c in DAILY)
    ends = [a for a, _ in at[1:]] + [None]

    def cell(a: int, b: int | None) -> Column:
        return F.trim(F.substr("value", F.lit(a + 1), F.lit(b - a if b else 1 << 30)))

    rows = lines.where(~F.startswith("value", F.lit("Form")) & ~F.startswith("value", F.lit("--")))
    out = rows.select(*(cell(a, b).alias(c) for (a, c), b in zip(at, ends, strict=True))).where(F.col("CIK").rlike("^[0-9]+$"))
    return out.withColumn("CIK", F.col("CIK").cast("long")).withColumn("Date Filed", D.lenient_date("`Date Filed`"))


def index_quality(rows: DataFrame, name: str) -> DataFrame:
    """Rows and bad rows of an index: no key, no date or no path."""
    bad = F.col("cik").isNull() | F.col("filing_date").isNull() | (F.coalesce("filename", F.lit("")) == "")
    return rows.groupBy(name).agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"))


def form_list(df: DataFrame, forms: str, description: str) -> DataFrame:
    """Cells like ``3, 3/A`` as one row per form."""
    return df.where(F.col(forms).isNotNull()).select(F.explode(F.split(forms, ", ")).alias("form"), description)
