"""Tables as sources: one column of a columnar store, SQL over registered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def column(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Some columns of a columnar table; no other is read."""
    return spark.read.parquet(path).select(*names)


def sql_frame(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """A query over frames, which it names in braces."""
    return spark.sql(text, **views)


def jdbc_frame(spark: SparkSession, url: str, query: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A query that a database answers.

    With a ``key`` (a column of whole numbers, dates or times in the query), rows
    come in partitions by ranges of it: the database is asked for its bounds first,
    then once for each range; rows whose key is null come with the first.  Filters
    and columns of what follows go to the database.  Without a key there is one
    partition.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    whole = reader.option("dbtable", f"({query}) q")
    if key is None:
        return whole.load()
    bounds = spark.read.format("jdbc").options(url=url, **options).option("dbtable", f"(SELECT min({key}) AS lo, max({key}) AS hi FROM ({query}) q) b").load().first()
    lo, hi = bounds[0], bounds[1]
    if lo is None or lo == hi:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(partitions)).load()
