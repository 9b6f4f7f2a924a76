"""From a question to the context of its answer: the nearest chunks within a
scope, as lines that name their filing, or the raw text where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import dot, embedded, norm

#: What stands before raw text that takes the place of chunks, how much of it
#: there is, and what stands for neither (fixed values).
RAW, RAW_CHARS, NOTHING = "Raw filing excerpt:\n", 40_000, "Filing text context unavailable."
#: Decimals to which similarities are compared, so that equal ones tie.
PLACES = 9


def top_chunks(questions: DataFrame, chunks: DataFrame, k: int, *, scope: list[str], question: str = "question_id", key: str = "chunk_id", name: str = "hashed") -> DataFrame:
    """``(question, rank, similarity, columns of chunks)``: the k chunks nearest to
    each question among those with its values of ``scope`` (a filing, a company).

    Questions and chunks meet by scope alone, so a question is compared with its
    filing's chunks and no others.  Pairs are ids and a similarity: a chunk's own
    columns are fetched for the k best alone, by its key and a hash of its columns.
    The best are taken by a ranking that keeps k of each question in every task
    before rows are shuffled.  Ties go to the smaller
    key; a question or chunk that is null in its scope meets none; one without a
    similarity is not found.  For questions to a whole table see ``vector_index``.
    """
    asks = embedded(questions.select(question, *scope, F.col("question").alias("_text")), "_text", name, "_q")
    plain = [c for c, kind in chunks.dtypes if "map<" not in kind]  # maps have no hash
    known = chunks.withColumn("_h", F.xxhash64(*plain))
    rows = embedded(known.select(*dict.fromkeys([*scope, key]), "_h", "content"), "content", name, "_v")
    sides = rows.withColumn("_vn", norm(F.col("_v"))).drop("content").join(asks.withColumn("_qn", norm(F.col("_q"))).drop("_text"), scope)
    # What has no similarity ranks last and goes after ranking: a filter before it
    # would compute each similarity again.
    near = F.round(F.try_divide(dot(F.col("_v"), F.col("_q")), F.col("_vn") * F.col("_qn")), PLACES)
    pairs = sides.select(question, *dict.fromkeys([*scope, key]), "_h", F.nanvl(near, F.lit(None)).alias("similarity"))
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc_nulls_last("similarity"), key))
    best = pairs.withColumn("rank", place).where((F.col("rank") <= k) & F.col("similarity").isNotNull())
    found = best.join(known, [*dict.fromkeys([*scope, key]), "_h"]).dropDuplicates([question, "rank"])
    return found.select(question, "rank", "similarity", *chunks.columns)


def contexts(questions: DataFrame, hits: DataFrame, *, question: str = "question_id", form: str = "form_type", date: str = "date_filed", raw: str | None = None) -> DataFrame:
    """``(question, context, fragments)``: each question's hits by rank as
    ``[form date]: content``, a blank line between; without a hit the start of
    ``raw`` (a column of questions) marked as such, else a note."""
    line = F.concat(F.lit("["), F.coalesce(F.col(form).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(date).cast("string"), F.lit("")), F.lit("]: "), F.coalesce("content", F.lit("")))
    rows = hits.select(question, F.struct("rank", line.alias("line")).alias("r"))
    found = rows.groupBy(question).agg(F.array_sort(F.collect_list("r")).alias("rs"))  # k of each question at most
    text = found.select(question, F.array_join(F.transform("rs", lambda r: r.line), "\n\n").alias("_c"), F.size("rs").cast("long").alias("fragments"))
    none = F.lit(NOTHING)
    other = none if raw is None else F.when(F.col(raw).isNotNull(), F.concat(F.lit(RAW), F.substring(F.col(raw), 1, RAW_CHARS))).otherwise(none)
    joined = questions.join(text, question, "left")
    return joined.select(question, F.coalesce("_c", other).alias("context"), F.coalesce("fragments", F.lit(0).cast("long")).alias("fragments"))


def answers_context(questions: DataFrame, chunks: DataFrame, *, scope: list[str], k: int = 4, question: str = "question_id", key: str = "chunk_id", name: str = "hashed", raw: str | None = None) -> DataFrame:
    """Both in one: from ``(question, scope, question text)`` to contexts."""
    return contexts(questions, top_chunks(questions, chunks, k, scope=scope, question=question, key=key, name=name), question=question, raw=raw)


def expanded(hits: DataFrame, sources: DataFrame, on: str, text: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """Hits with ``window``: the source's text around each, ``width`` characters to
    either side."""
    first = F.greatest(F.col(start) - width, F.lit(0))
    met = hits.join(sources.select(on, F.col(text).alias("_s")), on, "left")
    return met.withColumn("window", F.substring("_s", (first + 1).cast("int"), (F.col(end) + width - first).cast("int"))).drop("_s")
