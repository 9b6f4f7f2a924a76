"""Write semantics as functions from (target, source) to the next version.

Files cannot be changed in place, so each returns the whole new table, to be
written beside the old one and switched by :func:`publish`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import not_in_rows


def one_each(df: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """A row for each key: that with the greatest ``by``, then the greatest by
    its columns in their order (by their JSON where they hold maps), so that every
    run takes the same.  Rows without a key all stay."""
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != key))
    plain = F.to_json(rest) if "map<" in df.select(rest.alias("r")).schema.simpleString() else rest
    order = F.struct(F.col(by).alias("by"), plain.alias("rest")) if by else plain
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    best = df.withColumn("_alone", alone).groupBy(key, "_alone").agg(F.max_by(rest, order).alias("row"))
    return best.select(*(F.col(key) if c == key else F.col(f"row.`{c}`") for c in df.columns))


def upsert(target: DataFrame, source: DataFrame, key: str, columns: list[str], by: str | None = None) -> DataFrame:
    """Known keys get the source's ``columns``, new ones all it has.  Of source
    rows with one key the last by ``by`` counts (see :func:`one_each`)."""
    s = one_each(source, key, by).select(F.struct(*(F.col(f"`{c}`") for c in source.columns)).alias("s"))
    t = target.select(F.struct(*(F.col(f"`{c}`") for c in target.columns)).alias("t"))
    joined = t.join(s, F.col(f"t.`{key}`") == F.col(f"s.`{key}`"), "full")

    def pick(c: str):
        old = F.col(f"t.`{c}`")
        if c not in source.columns:
            return old.alias(c)
        new = F.col(f"s.`{c}`")
        if c == key:
            return F.coalesce(old, new).alias(c)
        from_source = F.col("t").isNull() if c not in columns else F.col("s").isNotNull()
        return F.when(from_source, new).otherwise(old).alias(c)

    return joined.select(*(pick(c) for c in target.columns))


def insert_ignore(target: DataFrame, source: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Source rows with new keys join the target; of equal keys, one."""
    fresh = not_in_rows(one_each(source, key, by), target, key)
    return target.unionByName(fresh.select(*target.columns))


def not_done(rows: DataFrame, done: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """Rows whose output is not there yet; all, where it is to be replaced."""
    return rows if replace else not_in_rows(rows, done, key)


def get_or_create(target: DataFrame, source: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Keys of the source the target lacks come in with defaults."""
    fresh = not_in_rows(source.select(key).distinct(), target, key)
    for c in target.columns:
        if c != key:
            fresh = fresh.withColumn(c, F.lit(defaults.get(c)).cast(target.schema[c].dataType))
    return target.unionByName(fresh.select(*target.columns))


def replace_children(target: DataFrame, source: DataFrame, parent: str) -> DataFrame:
    """All rows of the source's parents give way to the source's rows."""
    return not_in_rows(target, source, parent).unionByName(source.select(*target.columns))


def changed(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows that are new or differ from the target's in any column."""
    cols = [c for c in source.columns if c != key]
    t = target.select(F.col(key).alias("_k"), F.struct(*cols).alias("_t"))
    joined = source.join(t, source[key] == t["_k"], "left")
    return joined.where(~F.struct(*(source[c] for c in cols)).eqNullSafe(F.col("_t"))).select(*(source[c] for c in source.columns))


def sync_counts(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """How many of the source's rows are new, changed, or as they were."""
    cols = [c for c in source.columns if c != key]
    t = target.select(F.col(key).alias("_k"), F.struct(*cols).alias("_t"))
    joined = source.join(t, source[key] == t["_k"], "left")
    same = F.struct(*(source[c] for c in cols)).eqNullSafe(F.col("_t"))
    kind = F.when(F.col("_k").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return joined.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def update_where(target: DataFrame, keys: DataFrame, key: str, **values: object) -> DataFrame:
    """Set columns of the rows whose key is listed."""
    k = keys.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = target.join(k, target[key] == k["_k"], "left")
    return joined.select(*(F.when(F.col("_hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


def append_unless(entries: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    return entries.unionByName(new.join(entries.select(*on).distinct(), on, "left_anti").select(*entries.columns))


def content_put(store: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content-addressed insert: new (sha1, content) rows the store lacks."""
    keyed = blobs.select(F.sha1("content").alias("sha1"), "content")
    return one_each(keyed, "sha1").join(store.select("sha1"), "sha1", "left_anti")


def publish(df: DataFrame, root: str, codec: str = "zstd") -> str:
    """Write a new version under ``root`` and return its path; a reader holds
    the version it was given, and a failed write leaves no trace in it."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return path


POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Make a published version the one that :func:`current` reads: its name is
    written beside the pointer and takes its place by a rename."""
    name = version.rstrip("/").rpartition("/")[2]
    fresh, store = _path(spark, f"{root.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    pointer, _ = _path(spark, f"{root.rstrip('/')}/{POINTER}")
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, options)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version the pointer names; None before the first."""
    pointer, store = _path(spark, f"{root.rstrip('/')}/{POINTER}")
    if not store.exists(pointer):
        return None
    name = spark.read.text(pointer.toString()).first()["value"]
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def copy_tables(spark: SparkSession, read: Callable[[str], DataFrame], root: str, depends: dict[str, list[str]]) -> DataFrame:
    """Copy tables into ``root``, each after those it refers to:
    ``(table, place, rows)`` with the place it had in the order."""
    order: list[str] = []
    left = dict(depends)
    while left:
        ready = sorted(t for t, needs in left.items() if not set(needs) & set(left))
        if not ready:
            raise ValueError(f"tables refer to each other: {sorted(left)}")
        order += ready
        left = {t: needs for t, needs in left.items() if t not in ready}
    done = []
    for i, t in enumerate(order):
        read(t).write.mode("overwrite").option("compression", "zstd").parquet(f"{root.rstrip('/')}/{t}")
        done.append((t, i, spark.read.parquet(f"{root.rstrip('/')}/{t}").count()))
    return spark.createDataFrame(done, "table string, place int, rows long")


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]
