"""Feed archives: their members as rows, which of a day's files counts, packed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import unpack
from .archive_format import SCHEMA, ArchiveSource, batches

__all__ = ["ArchiveSource"]

def archive_members(paths: DataFrame, path: str = "path", suffix: str = "") -> DataFrame:
    """``(archive, member, content)`` of the archives a table names, each opened
    and unpacked in its task as a stream: one member at a time is in memory."""

    def run(rows):
        for batch in rows:
            for name in batch.column(0).to_pylist():
                yield from batches(name, suffix)

    return paths.select(F.col(path).alias("path")).mapInArrow(run, SCHEMA)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def best_archives(paths: DataFrame, path: str = "path", days: list[str] | None = None, since: int | None = None) -> DataFrame:
    """``(day, path)`` of daily feeds under ``year/QTRn/RAW``: names of eight
    digits, years from ``since`` on, zstd before gzip before plain of a day."""
    parts = F.regexp_extract(path, r"(?:^|/)(\d{4})/QTR([1-4])/RAW/([^/]*)$", 3)
    day = F.regexp_extract(parts, r"^(\d{8})[^/]*\.tar(?:\.(?:gz|zst))?$", 1)
    year = F.regexp_extract(path, r"(?:^|/)(\d{4})/QTR[1-4]/RAW/", 1)
    found = paths.select(day.alias("day"), F.col(path).alias("path"), year.alias("year")).where(F.col("day").rlike("^[0-9]{8}$"))
    if since is not None:
        found = found.where(F.col("year").cast("int") >= since)
    if days is not None:
        found = found.where(F.col("day").isin(days))
    rank = F.when(F.endswith("path", F.lit(".zst")), 0).when(F.endswith("path", F.lit(".gz")), 1).otherwise(2)
    return found.groupBy("day").agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("path"))


def daily_archives(spark: SparkSession, root: str, days: list[str] | None = None, since: int | None = None) -> DataFrame:
    """The feeds under a folder, the best file of each day."""
    return best_archives(listed(spark, root), "path", days, since)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content decompressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", unpack("content").alias("content"))


def segment(content: Column | str, start: int, end: int) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, start + 1, end - start)


def ownership_xml(files: DataFrame, path: str, content: str) -> DataFrame:
    """For each accession, the file that holds the form: the envelope itself,
    a member named .xml, then another sibling."""
    text = F.col(content).cast("string")
    accession = F.regexp_extract(path, r"(\d{10}-\d{2}-\d{6})", 1)
    rank = F.when(F.contains(path, F.lit(".sgml")) & ~F.contains(path, F.lit(".md.")), 0).when(F.endswith(path, F.lit(".xml")), 1).otherwise(2)
    side = F.contains(path, F.lit(".out.")) | F.contains(path, F.lit(".md."))
    fits = files.where(F.contains(text, F.lit("<ownershipDocument")) & ~side).withColumn("accession", accession)
    return fits.groupBy("accession").agg(F.min_by(F.struct(path, content), F.struct(rank.alias("r"), path)).alias("f")).select("accession", f"f.{path}", f"f.{content}")
