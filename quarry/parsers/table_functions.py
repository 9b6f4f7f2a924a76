"""Parsers as SQL table functions: ``FROM files, LATERAL ownership_rows(content) r``.

A form is read once, and all kinds of its rows come from that: ``kind``,
``position`` (in its kind, or in its table where the form numbers rows) and
``fields``, the texts that are there.  A form that cannot be read is one row of
kind ``error``.  (Table functions of whole Arrow columns cannot stand in a lateral
join; these take a row at a time, and rows travel pickled some hundred at once: an
Arrow batch for each call's few rows is dearer.)  Over many forms ``FROM files LATERAL
VIEW inline(ownership_list(content)) r`` is cheaper: a form's rows as one array, made
of whole Arrow columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import holdings, ownership

Row = tuple[str, int, dict[str, str]]
SCHEMA = "kind string, position long, fields map<string, string>"
LISTED = "array<struct<kind: string, position: long, fields: map<string, string>>>"
#: Row makers by function name, and those of form types for ``document_rows``.
FUNCTIONS: dict[str, Callable[[str | bytes | None], Iterator[Row]]] = {}
_FORMS: dict[str, Callable[[str | bytes | None], Iterator[Row]]] = {}


def define(name: str, rows: Callable[[str | bytes | None], Iterator[Row]], *form_types: str) -> None:
    """A table function of a document's content, also for these form types and
    their amendments."""
    FUNCTIONS[name] = rows
    for f in form_types:
        _FORMS[f.strip().upper()] = _FORMS[f.strip().upper() + "/A"] = rows


def _texts(values: dict) -> dict[str, str]:
    """Fields with a text; lists of references are joined by commas."""
    flat = {k: ",".join(v) if isinstance(v, list) else v for k, v in values.items() if k != "sequence_key"}
    return {k: str(v) for k, v in flat.items() if v not in (None, "")}


def _present(values: dict[str, str | list[str]]) -> dict[str, str]:
    """The same of texts and lists of texts alone."""
    return {k: ",".join(v) if type(v) is list else v for k, v in values.items() if v and k != "sequence_key"}


_ERROR = ("error", 1, {"reason": "unreadable form"})


def ownership_rows(content: str | bytes | None) -> Iterator[Row]:
    """A form's eight kinds of rows."""
    r = ownership.record(content, bare=True)
    if r is None:
        yield _ERROR
        return
    yield "submission", 1, _present({c: r[c] for c in ownership.HEAD if c in r})
    for i, owner in enumerate(r["owners"], 1):
        yield "reporting_owner", i, _present(owner)
    first = {"rptowner_cik": r["owners"][0].get("rptowner_cik", "")} if r["owners"] else {}
    for name in ownership.ROWS:
        for row in r[name]:
            yield name.removesuffix("s"), row["sequence_key"], _present(first | row)
    for i, (number, text) in enumerate(r["footnotes"].items(), 1):
        yield "footnote", i, _present({"footnote_id": number, "footnote_text": text})
    for i, signed in enumerate(r["signatures"], 1):
        yield "signature", i, _present(signed)


def holdings_rows(content: str | bytes | None) -> Iterator[Row]:
    """A holdings report, and its holdings."""
    r = holdings.report(content)
    if r.get("error"):
        yield _ERROR
        return
    yield "report", 1, _texts({k: v for k, v in r.items() if k not in ("holdings", "error")})
    for i, h in enumerate(r.get("holdings") or (), 1):
        yield "holding", i, _texts(h)


define("ownership_rows", ownership_rows, "3", "4", "5")
define("holdings_rows", holdings_rows, "13F-HR", "13F-NT")


def _of_one(rows: Callable[[str | bytes | None], Iterator[Row]]):
    class Rows:
        def eval(self, content):
            yield from rows(content)

    return F.udtf(Rows, returnType=SCHEMA, useArrow=False)


def _of_any():
    forms = dict(_FORMS)

    class Rows:
        def eval(self, content, form_type):
            reader = forms.get((form_type or "").strip().upper())
            if reader is not None:
                yield from reader(content)

    return F.udtf(Rows, returnType=SCHEMA, useArrow=False)


#: Documents whose rows are held at once.
_DOCUMENTS = 500


def _of_many(rows: Callable[[str | bytes | None], Iterator[Row]]):
    """The rows of each document as an array of structs, column by column."""

    def some(content: pa.Array) -> pa.Array:
        ends, kinds, places, stops, names, texts = [0], [], [], [0], [], []
        for c in content.to_pylist():
            for kind, place, fields in rows(c):
                kinds.append(kind)
                places.append(place)
                names.extend(fields)
                texts.extend(fields.values())
                stops.append(len(names))
            ends.append(len(kinds))
        fields = pa.MapArray.from_arrays(pa.array(stops, pa.int32()), pa.array(names, pa.string()), pa.array(texts, pa.string()))
        found = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(places, pa.int64()), fields], ["kind", "position", "fields"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    def run(content: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(content.slice(at, _DOCUMENTS)) for at in range(0, max(1, len(content)), _DOCUMENTS)])

    return F.arrow_udf(run, LISTED)


def register_all(spark: SparkSession) -> None:
    """All of them as functions of this session, and ``document_rows(content,
    form_type)``, which has no rows for a form that no parser reads."""
    for name, rows in FUNCTIONS.items():
        spark.udtf.register(name, _of_one(rows))
        spark.udf.register(f"{name.removesuffix('_rows')}_list", _of_many(rows))
    spark.udtf.register("document_rows", _of_any())
