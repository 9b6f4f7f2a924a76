"""Operations within nested records: sorting lists, summaries, rendering."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udf import arrow_udf


def sorted_list(items: Column | str, *fields: str) -> Column:
    """An array of structs in the order of some fields; equals keep theirs."""
    c = T.col(items)
    keyed = F.transform(c, lambda x, i: F.struct(*(x.getField(f).alias(f"k{n}") for n, f in enumerate(fields)), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k.x)


def first_items(items: Column | str, n: int) -> Column:
    return F.slice(T.col(items), 1, n)


def list_support(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Per list column: rows that have any item, and items in all."""
    pairs = F.array(*(F.struct(F.lit(c).alias("list"), F.coalesce(F.size(c), F.lit(0)).alias("n")) for c in lists))
    rows = df.select(key, F.inline(pairs))
    return rows.groupBy("list").agg(F.count_if(F.col("n") > 0).alias("records"), F.sum("n").alias("items"))


@arrow_udf("string")
def metadata_markdown(records: pd.Series) -> pd.Series:
    """A nested JSON record as headings by depth and ``* **key:** value``
    lines; leaves that are empty, zero or false are left out."""

    def lines(x: dict, depth: int) -> list[str]:
        out = []
        for k, v in x.items():
            title = k.replace("-", " ").replace("_", " ").upper()
            for item in v if isinstance(v, list) else [v]:
                if isinstance(item, dict):
                    inner = lines(item, depth + 1)
                    out += ["#" * min(depth, 6) + f" {title}", *inner] if inner else []
                elif item:
                    out.append(f"* **{title}:** {item}")
        return out

    def one(raw: str | None) -> str | None:
        try:
            tree = json.loads(raw) if raw else {}
        except ValueError:
            return None
        return "\n".join(lines(tree, 2)) if isinstance(tree, dict) else None

    return records.map(one)


def section_key(kind: Column | str, form: Column | str, table: dict[str, tuple[str, str]] | None = None) -> Column:
    """The item a section has in annual and in other reports."""
    items = table or {"risk": ("Item 1A", "Item 1A"), "mda": ("Item 7", "Item 2"), "legal": ("Item 3", "Item 1"), "controls": ("Item 9A", "Item 4")}
    annual, other = F.lit("Item 1A"), F.lit("Item 1A")
    for name, (a, b) in items.items():
        annual = F.when(T.col(kind) == name, a).otherwise(annual)
        other = F.when(T.col(kind) == name, b).otherwise(other)
    return F.when(F.startswith(T.col(form), F.lit("10-K")), annual).otherwise(other)


def tallies(df: DataFrame, ok: Column, *by: str) -> DataFrame:
    """Successes and failures of a run."""
    return df.groupBy(*by).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def error_rows(failed: DataFrame, key: str, reason: str) -> DataFrame:
    """What could not be fetched or parsed, as rows that say so."""
    return failed.select(F.col(key), F.lit(True).alias("is_error"), F.lit(False).alias("is_processed"), F.lit(reason).alias("reason"))
