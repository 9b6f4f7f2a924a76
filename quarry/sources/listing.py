"""Listings: links of directory pages, paths of archives, plain key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def links(html: Column | str) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(T.col(html), F.lit('href="([^"]+)"'), F.lit(1))


def directory_entries(pages: DataFrame, base: str, html: str) -> DataFrame:
    """``(base, target)``: links of listing pages as absolute paths, those to
    the parent directory left out."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select(base, F.explode(anchors).alias("a")).where(~F.contains("a", F.lit("Parent Directory")))
    target = F.regexp_extract("a", r'(?i)href="([^"]*)"', 1)
    full = F.when(target.rlike("^(/|[a-z]+:)"), target).otherwise(T.join_url(base, target))
    return rows.select(base, full.alias("target")).where("target <> ''").distinct()


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys from a text file, one or more a line, by commas."""
    lines = spark.read.text(path)
    keys = lines.select(F.explode(F.split("value", ",")).alias("key"))
    return keys.select(T.strip("key").alias("key")).where("key <> ''").distinct()


def path_parts(path: Column | str) -> Column:
    """``…/2023/QTR2/acc.htm.zstd`` as year, quarter, accession, suffix."""
    parts = F.split(T.col(path), "/")
    name = F.element_at(parts, -1)
    return F.struct(
        F.try_element_at(parts, F.lit(-3)).try_cast("int").alias("year"),
        F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), "QTR([1-4])", 1).try_cast("int").alias("quarter"),
        F.substring_index(name, ".", 1).alias("accession"),
        F.regexp_extract(name, r"^[^.]*\.([^.]*)", 1).alias("suffix"),
    )


def prefixes(paths: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Distinct first parts of object keys."""
    out = paths.select(F.substring_index(path, "/", 1).alias("prefix")).distinct()
    return out.orderBy("prefix").limit(limit) if limit else out


def with_labels(paths: DataFrame, path: str, suffixes: dict[str, str]) -> DataFrame:
    """Files by directory, each labelled by the first suffix that fits."""
    label = None
    for s, name in suffixes.items():
        hit = F.endswith(F.col(path), F.lit(s))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    item = F.struct(F.col(path).alias("path"), label.otherwise("other").alias("label"))
    return paths.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list(item)).alias("files"))


def discovered(pages: DataFrame, base: str, html: str, local: DataFrame, path: str, form: str | None = None) -> DataFrame:
    """What listing pages name and what is here already, each path once, with
    whether it is here; with ``form``, paths of that form's folder alone."""
    there = directory_entries(pages, base, html).select(F.col("target").alias("path"), F.lit(False).alias("here"))
    here = local.select(F.col(path).alias("path"), F.lit(True).alias("here"))
    both = there.unionByName(here).groupBy("path").agg(F.max("here").alias("here"))
    return both if form is None else both.where(F.contains("path", F.lit(f"/{form}/")))
