"""Incremental ingest: files that arrive are read once and merged by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import current, publish, switch


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files as (path, content) rows."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return stream.option("pathGlobFilter", pattern).load(folder).select("path", "content")


class _FirstOnly(StatefulProcessor):
    """Of each key the rows of the first batch that has any: the last of these by
    a column.  The state of a key is that it was seen."""

    def __init__(self, by: str | None, keep: int | None):
        self.by, self.keep = by, keep

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, best = self.seen.exists(), None
        for part in rows:
            if known or not len(part):
                continue
            top = part.tail(1) if self.by is None else part.sort_values(self.by, kind="stable", na_position="first").tail(1)
            if best is None or self.by is None or pd.isna(best[self.by].iloc[0]) or top[self.by].iloc[0] >= best[self.by].iloc[0]:
                best = top
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


#: Where the state of streams lies in each executor, and in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_each(stream: DataFrame, key: str, by: str | None = None, keep_hours: float | None = None) -> DataFrame:
    """Rows of keys that no earlier batch had, one for each: the last by ``by``.

    Keys that were seen are the query's state, a bit each, spread over its
    partitions and restored from the checkpoint; with ``keep_hours`` a key is
    forgotten after that time, which bounds the state.
    """
    keep = None if keep_hours is None else int(keep_hours * 3_600_000)
    mode = "None" if keep is None else "ProcessingTime"
    return stream.groupBy(key).transformWithStateInPandas(_FirstOnly(by, keep), stream.schema, "Append", mode)


def ingest_new(
    stream: DataFrame, target: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, by: str | None = None,
    keep_hours: float | None = None,
) -> StreamingQuery:
    """Append the rows of new keys to a table of Parquet files, whatever is
    available now, then stop.

    What was seen is the query's own state, so the target is not read, and a
    query that starts again from its ``checkpoint`` goes on where it ended; the
    file sink's log makes a batch that is run again leave one set of files.  Of
    rows with one key in a batch the last by ``by`` counts.  ``prepare`` works on
    rows of the stream (no aggregates).
    """
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_STORE)  # a query takes its settings when it starts
    try:
        new = first_of_each(prepare(stream), key, by, keep_hours)
        sink = new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        return sink.option("compression", "zstd").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def quarantined(rows: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and those to be fetched again."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return rows.where(good), rows.where(~good).withColumn("is_error", F.lit(True))


def with_second_try(rows: DataFrame, ok: str, again: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(good, errors)``: rows that could not be read are fetched once more by
    ``again`` (from rows to rows of the same columns); what fails twice is an
    error row."""
    good, bad = quarantined(rows, ok)
    second, errors = quarantined(again(bad.drop("is_error")), ok)
    return good.unionByName(second), errors


def with_quarantine(rows: DataFrame, root: str, ok: str, attempt: Callable[[DataFrame], DataFrame], tries: int = 3) -> DataFrame:
    """One run of work that can fail: ``attempt`` gives rows back with ``ok``
    (and with ``tries``, a count, as they came).

    What failed in earlier runs waits in a table below ``root`` and is tried again
    with the new rows; what fails now waits for the next run, until it has had
    ``tries`` of them.  Returns what is good.  The table's next version is written
    whole and then becomes the current one, so a run that breaks off leaves the one
    before.
    """
    spark = rows.sparkSession
    waiting = current(spark, root)
    fresh = rows.withColumn("tries", F.lit(0))
    todo = fresh if waiting is None else fresh.unionByName(waiting.where(F.col("tries") < tries).select(fresh.columns))
    done = attempt(todo.withColumn("tries", F.col("tries") + 1))
    # Written before it is read twice, so that no work is done again.
    held = spark.read.parquet(publish(done, f"{root.rstrip('/')}/runs"))
    good, bad = quarantined(held, ok)
    given_up = [] if waiting is None else [waiting.where(F.col("tries") >= tries)]
    left = bad.select(*rows.columns, "tries")
    for w in given_up:
        left = left.unionByName(w.select(left.columns))
    switch(spark, root, publish(left, root))
    return good.drop("tries")


def fan_out(documents: DataFrame, task: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """One task's work on every document, wherever it lies: an iterator of Arrow
    batches to one of results."""
    return documents.mapInArrow(task, schema)


def event_windows(events: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums by tumbling window, with late rows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    windows = rows.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
