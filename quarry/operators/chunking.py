"""Cutting long texts: at headings, by section, in fixed steps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf

CHUNK = "array<struct<content: string, start_pos: bigint, end_pos: bigint>>"


def cut_points(text: str, limit: int, heading: str) -> list[int]:
    """Ends of consecutive chunks of at most ``limit`` characters.

    A chunk ends at the last heading in its second half, else behind the last
    line break there, else at the limit.
    """
    from bisect import bisect_right

    heads = [m.start() for m in re.finditer(heading, text, re.M)]
    ends, at, n = [], 0, len(text)
    while at < n:
        to = at + limit
        if to >= n:
            ends.append(n)
            break
        least = at + limit * 0.5
        k = bisect_right(heads, to) - 1
        if k >= 0 and heads[k] > least:
            to = heads[k]
        elif (line := text.rfind("\n", at, to)) > least:
            to = line + 1
        ends.append(to)
        at = to
    return ends


def heading_chunks(text: Column | str, limit: int, levels: int = 2) -> Column:
    """Chunks with their offsets, contiguous and without overlap; all but
    the last are stripped, their offsets are not."""
    heading = rf"^#{{1,{levels}}}\s"

    @arrow_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            ends = cut_points(t or "", limit, heading)
            spans = list(zip([0, *ends], ends, strict=False))
            return [
                {"content": t[a:b] if b == len(t) else t[a:b].strip(), "start_pos": a, "end_pos": b} for a, b in spans
            ]

        return texts.map(one)

    return run(F.col(text) if isinstance(text, str) else text)


@arrow_udf("array<struct<section: string, content: string>>")
def markdown_sections(texts: pd.Series) -> pd.Series:
    """Sections under their headings' path (``a > b``); what comes before any
    heading is ``prologue``, a level left out is ``unknown``; headings with
    nothing below them give no section."""

    def one(text: str | None) -> list[dict]:
        out, path, held = [], [], []

        def close() -> None:
            body = "\n".join(held).strip()
            if body:
                out.append({"section": " > ".join(path) if path else "prologue", "content": body})
            held.clear()

        for line in (text or "").split("\n"):
            m = re.match(r"^(#+) (.*)$", line)
            if not m:
                held.append(line)
                continue
            close()
            level = len(m[1])
            del path[level - 1 :]
            path += ["unknown"] * (level - 1 - len(path)) + [m[2].strip()]
        close()
        return out

    return texts.map(one)


def line_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, section, content)``: the sections of ``markdown_sections`` by
    Spark's own operators.

    Lines are rows; a running count of headings numbers the sections of a text, a
    section's lines join to its content, and a fold over a text's headings carries
    the path: a heading cuts it to the levels above and fills those left out.
    """
    line = df.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line"))
    mark = F.regexp_extract("line", r"^(#+) .*$", 1)
    own = Window.partitionBy(key).orderBy("n")
    rows = line.withColumn("level", F.length(mark)).withColumn("place", F.sum((F.col("level") > 0).cast("int")).over(own))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("n", "line")))), lambda x: x.line), "\n")
    title = F.trim(F.regexp_replace(F.col("line"), r"^#+ ", ""))
    head = F.max(F.when(F.col("level") > 0, F.struct("level", title.alias("title"))))
    sections = rows.groupBy(key, "place").agg(F.regexp_replace(body, r"(?U)\A\s+|\s+\z", "").alias("content"), head.alias("head"))
    heads = sections.where(F.col("head").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "head"))).alias("heads"))
    # Every heading's path, from that of the heading before.
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<struct<place: bigint, path: array<string>>>").alias("done"))

    def step(state, x):
        above = F.slice(state.path, F.lit(1), x.head.level - 1)
        path = F.concat(above, F.array_repeat(F.lit("unknown"), x.head.level - 1 - F.size(above)), F.array(x.head.title))
        return F.struct(path.alias("path"), F.concat(state.done, F.array(F.struct(x.place.alias("place"), path.alias("path")))).alias("done"))

    paths = heads.select(key, F.inline(F.aggregate("heads", start, step, lambda s: s.done)))
    met = sections.where("content <> ''").join(paths, [key, "place"], "left")
    return met.select(key, "place", F.coalesce(F.array_join("path", " > "), F.lit("prologue")).alias("section"), "content")


def fixed_chunks(df: DataFrame, key: str, text: str, step: int = 2000) -> DataFrame:
    """``(key, chunk_index, content)``: consecutive runs of ``step``
    characters; blank texts have none."""
    some = df.where(F.length(F.trim(text)) > 0)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    at = some.select(key, text, F.posexplode(starts).alias("chunk_index", "_s"))
    return at.select(key, F.col("chunk_index").cast("long"), F.substr(text, F.col("_s") + 1, F.lit(step)).alias("content"))


def rebuilt(chunks: DataFrame, key: str, index: str, content: str, sep: str = "\n\n") -> DataFrame:
    """Chunks of a key joined in the order of their index."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r.t), sep).alias("text"))


def chunk_rows(df: DataFrame, key: str, text: str, limit: int = 1500, levels: int = 3, base: str | None = None) -> DataFrame:
    """Chunks as rows with an id of key and start; ``base`` is the offset of
    a text that is itself a fragment."""
    at = df.select(key, F.col(base).alias("_b") if base else F.lit(0).cast("long").alias("_b"), F.posexplode(heading_chunks(text, limit, levels)).alias("chunk_index", "_c"))
    start, end = F.col("_c.start_pos") + F.col("_b"), F.col("_c.end_pos") + F.col("_b")
    ident = F.concat_ws("_", F.col(key).cast("string"), start.cast("string"), F.col("chunk_index").cast("string"))
    return at.select(ident.alias("id"), key, "chunk_index", F.col("_c.content").alias("content"), start.alias("start_pos"), end.alias("end_pos"))
