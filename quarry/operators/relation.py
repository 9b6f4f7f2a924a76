"""A keyword-lookup layer over DataFrames: filter, exclude, order, values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUPS: dict[str, Callable[[Column, object], Column]] = {
    "exact": lambda c, v: c.isNull() if v is None else c == v,
    "iexact": lambda c, v: F.lower(c) == str(v).lower(),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "icontains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "startswith": lambda c, v: F.startswith(c, F.lit(v)),
    "endswith": lambda c, v: F.endswith(c, F.lit(v)),
    "in": lambda c, v: c.isin(list(v)),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    # A range of texts, which the reader of a date or timestamp can use.
    "year": lambda c, v: (c >= f"{int(v):04d}-01-01") & (c < f"{int(v) + 1:04d}-01-01"),
    "quarter": lambda c, v: F.quarter(c) == v,
    "range": lambda c, v: c.between(*v),
}


def condition(lookup: str, value: object) -> Column:
    """``name__gte=3`` as a column; an unknown lookup raises."""
    name, _, kind = lookup.partition("__")
    if (kind or "exact") not in LOOKUPS:
        raise ValueError(f"no such lookup: {lookup}")
    return LOOKUPS[kind or "exact"](F.col(name), value)


def filtered(df: DataFrame, **lookups: object) -> DataFrame:
    """Rows for which all lookups hold."""
    return reduce(lambda d, kv: d.where(condition(*kv)), lookups.items(), df)


def excluded(df: DataFrame, **lookups: object) -> DataFrame:
    """Rows for which none of the lookups holds (unknown counts as holding)."""
    return reduce(lambda d, kv: d.where(~condition(*kv)), lookups.items(), df)


def ordered(df: DataFrame, *fields: str) -> DataFrame:
    """``-name`` descends; nulls sort as the largest value."""
    return df.orderBy(*(F.desc_nulls_first(f[1:]) if f.startswith("-") else F.asc_nulls_last(f) for f in fields))


def first(df: DataFrame, key: str) -> DataFrame:
    return ordered(df, key).limit(1)


def last(df: DataFrame, key: str) -> DataFrame:
    return ordered(df, f"-{key}").limit(1)


def values(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*fields)


def values_list(df: DataFrame, *fields: str, flat: bool = False) -> DataFrame:
    if flat and len(fields) != 1:
        raise ValueError("flat takes one field")
    return df.select(*fields)


def annotated(df: DataFrame, **exprs: Column) -> DataFrame:
    return df.withColumns(exprs)


def renamed(df: DataFrame, names: dict[str, str], known: list[str] | None = None) -> DataFrame:
    """Columns under new names; with ``known``, of these alone those there are."""
    out = df.withColumnsRenamed(names)
    return out if known is None else out.select(*(c for c in known if c in out.columns))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of their batch of about ``size``: batches are dealt
    by a hash of the key, so their number needs a count but no order."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def get_or_404(df: DataFrame, **lookups: object):
    """The one row that matches; LookupError for none or several."""
    rows = filtered(df, **lookups).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows) or 'no'} rows for {lookups}")
    return rows[0]


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 3836) -> DataFrame:
    """``n`` rows in an order fixed by a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


#: Markers of bodies that are no content (fixed values).
POISON = ["Access Denied", "Request Rate Threshold Exceeded", "404 Not Found"]


def is_poison(content: Column | str, markers: list[str] | None = None, size: int = 2139) -> Column:
    """Empty, of the size of a refusal page, or with a refusal's marker."""
    c = F.col(content) if isinstance(content, str) else content
    out = c.isNull() | (F.length(c) == 0) | (F.length(c) == size)
    for m in markers or POISON:
        out = out | F.contains(c, F.lit(m))
    return out
