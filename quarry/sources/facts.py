"""Company JSON: the ticker map, facts by concept, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_POINT = "struct<val: double, accn: string, end: date, filed: date, fy: int, fp: string, frame: string, form: string>"
_CONCEPT = f"struct<label: string, description: string, units: map<string, array<{_POINT}>>>"
FACTS = f"struct<cik: bigint, entityName: string, facts: map<string, map<string, {_CONCEPT}>>>"


def tickers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    e = raw.select(F.explode(F.map_values(entries)).alias("e"))
    return e.select(T.zfill("e.cik_str").alias("cik"), F.col("e.ticker").alias("ticker"), F.col("e.title").alias("name"))


def company_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(facts, concepts)`` of a file or a folder of them.

    A fact row is one value with its unit, so its id is made of concept,
    accession number, unit, period's end and frame.  Of a concept's labels,
    the first by namespace and file counts.  Missing values are filled: 0 for
    value and year, an empty text for period and frame.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    body = raw.select("file", F.from_json("value", FACTS).alias("b"))
    cik = F.coalesce(F.col("b.cik"), F.regexp_extract("file", r"(\d+)", 1).try_cast("long"))
    spaces = body.select("file", T.zfill(cik).alias("cik"), F.explode("b.facts").alias("namespace", "concepts"))
    concepts = spaces.select("file", "cik", "namespace", F.explode("concepts").alias("fact", "c"))
    units = concepts.select("cik", "namespace", "fact", F.explode("c.units").alias("unit", "points"))
    rows = units.select("cik", "namespace", "fact", "unit", F.inline("points"))
    filled = rows.na.fill({"val": 0.0, "fy": 0, "fp": "", "frame": ""})
    ident = F.concat_ws("_", "fact", F.coalesce("accn", F.lit("")), "unit", F.coalesce(F.col("end").cast("string"), F.lit("")), "frame")
    meta = concepts.groupBy("fact").agg(
        F.min_by(F.struct("c.label", "c.description"), F.struct("namespace", "file")).alias("m")
    )
    return filled.withColumn("id", ident), meta.select("fact", "m.label", "m.description")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def records_by_file(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as text, keyed by their name without suffix."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select(F.substring_index("file", ".", 1).alias("key"), F.col("value").alias("record"))
