"""Join shapes: nesting, semi and anti, key matching, positional zips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a value that one side does not have.
ABSENT = "__NULL__"


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: list[str], name: str = "children") -> DataFrame:
    """Parents with their children as a sorted array; none: an empty one."""
    kept = [*order, *(c for c in children.columns if c not in order and c != child_key)]
    lists = children.groupBy(F.col(child_key).alias("_fk")).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias(name))
    joined = parents.join(lists, parents[parent_key] == lists["_fk"], "left").drop("_fk")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def in_rows(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    k = keys.select(F.col(key or on).alias("_k")).distinct()
    return df.join(k, df[on] == k["_k"], "left_semi")


def not_in_rows(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Null-safe: rows with a null key are never in."""
    k = keys.select(F.col(key or on).alias("_k")).distinct()
    return df.join(k, df[on] == k["_k"], "left_anti")


def matched_values(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' ``value`` by key, over the union of keys."""
    a = truth.select(*keys, F.col("value").alias("truth"))
    b = found.select(*keys, F.col("value").alias("found"))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(c, F.lit(ABSENT)).alias(c) for c in ("truth", "found")))


def zipped(a: DataFrame, b: DataFrame, key: str, items: str) -> DataFrame:
    """Elements of two arrays by key and position, up to the shorter."""
    x = a.select(key, F.posexplode(items).alias("pos", "a"))
    y = b.select(key, F.posexplode(items).alias("pos", "b"))
    return x.join(y, [key, "pos"])


def per_term(df: DataFrame, keep: list[str], terms: list[str], value: Callable[[str], Column], name: str) -> DataFrame:
    """``keep``, ``term`` and a value for each literal term, made from the row in
    one pass: what the value is made of is not copied to each term."""
    items = F.array(*(F.struct(F.lit(t).alias("term"), value(t).alias(name)) for t in dict.fromkeys(terms)))
    return df.select(*keep, F.inline(items))


def looked_up(ids: Column, table: Column) -> Column:
    """Texts of an array of ids from a map; ids it lacks are left out."""
    return F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda x: x.isNotNull())


def related(parents: DataFrame, child: DataFrame, on: Column, alone: Column, with_child: Column) -> DataFrame:
    """Parents for which a condition of theirs holds or that have a child for
    which one of its own does, each once: the first need no join, the others a
    semi-join, so no parent is copied to its children."""
    others = parents.where(~F.coalesce(alone, F.lit(False)))
    return parents.where(alone).unionByName(others.join(child.where(with_child), on, "left_semi"))
