"""Order-aware de-duplication and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest ``by``, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(by)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "sequence_key", start: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.asc_nulls_last(c) for c in order))
    return df.withColumn(name, (F.row_number().over(w) + (start - 1)).cast("long"))


def preferred(df: DataFrame, keys: list[str], rank: Column, tie: str) -> DataFrame:
    """The row of each key with the lowest rank, then tie-break."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), F.col(tie).alias("t"))).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def compared(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row beside the value before it, by key and order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w))
