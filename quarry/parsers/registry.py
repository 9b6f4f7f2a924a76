"""Which parser reads which form type; others can be added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf
from . import holdings, html, ownership


@dataclass(frozen=True)
class Parser:
    to_markdown: Callable[[str | bytes | None], str]
    extract: Callable[[str | bytes | None], dict]


_PARSERS: dict[str, Parser] = {}


def register(parser: Parser, *form_types: str) -> None:
    for f in form_types:
        _PARSERS[f.strip().upper()] = parser
        _PARSERS[f.strip().upper() + "/A"] = parser


def parser_for(form_type: str | None) -> Parser | None:
    return _PARSERS.get((form_type or "").strip().upper())


register(Parser(ownership.markdown_of, ownership.ground_truth), "3", "4", "5")
register(Parser(holdings.to_markdown, holdings.report), "13F-HR", "13F-NT")


def text_of(content: str | bytes | None, content_type: str | None, form_type: str | None) -> str:
    """A document as text: its form's parser, else by its content type."""
    parser = parser_for(form_type)
    if parser is not None:
        return parser.to_markdown(content)
    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "ignore")
    if content_type in ("text/html", "application/xml"):
        return html.read(text) or ""
    return text if (content_type or "text/plain").startswith("text/") else ""


@arrow_udf("string")
def extracted_text(content: pd.Series, content_type: pd.Series, form_type: pd.Series) -> pd.Series:
    return pd.Series([text_of(*x) for x in zip(content, content_type, form_type, strict=True)], dtype=object)


def document_text(content: Column | str, content_type: Column | str, form_type: Column | str) -> Column:
    return extracted_text(content, content_type, form_type)


def _layout(text: str) -> str:
    """The plain reader: a text is its own Markdown."""
    return text


#: Engines that turn a document into Markdown, by name.  ``layout`` may be
#: replaced by one that reads more kinds.
ENGINES: dict[str, Callable[[str], str]] = {"fast": lambda text: html.read(text, True) or "", "layout": _layout}


def markdown_of(content: str | bytes | None, content_type: str | None, name: str | None = None, engine: str = "auto") -> str:
    """A document as Markdown by the engine asked for or, for ``auto``, by its
    kind: HTML goes to ``fast``, all else to ``layout``.  What ``fast`` cannot
    read goes to ``layout``; a document no engine reads is empty."""
    low = (name or "").lower()
    is_html = content_type == "text/html" or low.endswith((".htm", ".html"))
    is_pdf = content_type == "application/pdf" or low.endswith(".pdf")
    if is_pdf and ENGINES["layout"] is _layout:
        return ""
    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "ignore")
    wanted = ("fast" if is_html else "layout") if engine == "auto" else engine
    for each in ([wanted, "layout"] if wanted == "layout" or is_html else ["layout"]):
        try:
            return ENGINES[each](text)
        except (ValueError, AssertionError):
            continue
    return ""


@arrow_udf("string")
def document_markdown(content: pd.Series, content_type: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([markdown_of(*x) for x in zip(content, content_type, name, strict=True)], dtype=object)


def register_sql(spark, name: str = "document_text") -> None:
    """The registry as an SQL function of content, content type and form type."""
    spark.udf.register(name, F.pandas_udf(extracted_text.__wrapped__, "string"))
