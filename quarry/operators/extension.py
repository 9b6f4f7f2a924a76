"""Where callers plug in functions of their own: answers to prompts, and data of
documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions from a list of prompts to as many answers, by provider type.
PROVIDERS: dict[str, Callable[[list[str]], list[str | None]]] = {}


def register_provider(kind: str, answer: Callable[[list[str]], list[str | None]]) -> None:
    PROVIDERS[kind.strip().lower()] = answer


def answers(prompts: Column, kind: str) -> Column:
    """What a provider answers to each prompt, a batch at a time; no prompt, no
    answer.  An unknown provider raises."""
    answer = PROVIDERS[kind.strip().lower()]

    def run(batch: pd.Series) -> pd.Series:
        asked = batch.dropna()
        return pd.Series(answer(asked.tolist()), index=asked.index, dtype=object).reindex(batch.index)

    return F.pandas_udf(run, "string")(prompts)


def document_data(documents: DataFrame, key: str, content: str, extract: Callable[[str], dict], schema: str) -> DataFrame:
    """``(key, ...)``: what a caller's function makes of each document's text, by
    the fields of ``schema``; a document it fails on gives nulls."""
    kind = documents.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[content], strict=True):
                try:
                    found = extract(text) if text is not None else {}
                except (ValueError, KeyError, IndexError):
                    found = {}
                rows.append([k, *(found.get(n) for n in names)])
            yield pd.DataFrame(rows, columns=[key, *names])

    return documents.select(key, content).mapInPandas(run, f"{key} {kind}, {schema}")


def resolved(companies: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``(key, id_type, id_value, figi)``: each company by its CUSIP or else its
    ticker, looked up in a mapping table of ``(id_type, id_value, figi)``;
    companies with neither are left out."""
    cusip = F.nullif(F.trim("cusip"), F.lit(""))
    known = companies.select(
        key, F.when(cusip.isNotNull(), "ID_CUSIP").otherwise("TICKER").alias("id_type"),
        F.coalesce(cusip, F.nullif(F.trim("ticker"), F.lit(""))).alias("id_value"),
    )
    return known.where("id_value IS NOT NULL").join(mapping, ["id_type", "id_value"], "left").select(key, "id_type", "id_value", "figi")
