"""Term search over documents, and vector search over chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf

from ..functions import text as T
from .joins import per_term
from .terms import substring_counts


def stem(word: str) -> str:
    """A rule stemmer: plural, gerund and past endings, then a final e."""
    w = word.lower()
    for end, least, put in (("sses", 4, "ss"), ("ies", 4, "y"), ("ing", 6, ""), ("edly", 7, ""), ("ed", 5, ""), ("ly", 5, ""), ("s", 4, "")):
        if w.endswith(end) and len(w) >= least and not (end == "s" and w.endswith(("ss", "us", "is"))):
            w = w[: -len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
        w = w[:-1]
    return w[:-1] if len(w) > 4 and w.endswith("e") else w


@arrow_udf("array<string>")
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def term_counts(
    docs: DataFrame, key: str, text: str, terms: list[str], *, case_sensitive: bool = True, tokens: bool = False, stemmed: bool = False
) -> DataFrame:
    """``(key, term, count)`` for terms that occur: as substrings that do not
    overlap, as whole tokens, or by stem (then keyed by the term as given).

    One pass over each text, whatever the number of terms: substrings are found
    by one automaton, words are filtered once, and no text is copied for a term.
    """
    plain = case_sensitive and not stemmed
    body = F.col(text) if plain else F.lower(text)
    want = {t: (stem(t) if stemmed else t if plain else t.lower()) for t in terms if t}
    if not want:
        return docs.select(key, F.lit("").alias("term"), F.lit(0).cast("long").alias("count")).where(F.lit(False))
    if tokens or stemmed:
        words = stems(T.tokens(body)) if stemmed else T.tokens(body)
        hits = F.filter(words, lambda w: w.isin(sorted(set(want.values()))))
        found = per_term(docs.select(F.col(key), hits.alias("_h")), [key], list(want), lambda t: T.count_token("_h", F.lit(want[t])), "count")
        return found.where("count > 0")
    found = substring_counts(docs, [key], body, list(want.values()))
    if plain:
        return found
    given = docs.sparkSession.createDataFrame([(w, t) for t, w in want.items()], "term string, given string")
    return found.join(F.broadcast(given), "term").select(key, F.col("given").alias("term"), "count")


def primary_document(documents: DataFrame, filing: str, name: str, order: str) -> DataFrame:
    """Each filing's first document with a readable suffix."""
    readable = documents.where(F.lower(name).rlike(r"\.(htm|html|pdf|txt)$"))
    rest = [c for c in documents.columns if c != filing]
    return readable.groupBy(filing).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_d")).select(filing, "_d.*")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top_k(chunks: DataFrame, query: list[float], k: int, *, key: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows most similar to a query vector; filters come first and
    reach the scan; ties go to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = chunks if where is None else chunks.where(where)
    scored = rows.withColumn("similarity", cosine(F.col(vector), q))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def context_window(source: Column, start: Column, end: Column, width: int = 1024) -> Column:
    """The text around a chunk, ``width`` characters to either side."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(source, (first + 1).cast("int"), (end + width - first).cast("int"))


@arrow_udf("array<float>")
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: hashed words, unit length."""
    import zlib

    import numpy as np

    def one(t: str | None) -> list[float]:
        v = np.zeros(64, np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 16 & 1 else -1
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return texts.map(one)


#: Functions from a column of texts to a column of vectors, by name; a model is
#: plugged in with :func:`define_embedding`.
EMBEDDINGS: dict[str, Callable[[Column], Column]] = {"hashed": hashed_embedding}


def define_embedding(name: str, function: Callable[[Column], Column]) -> None:
    """Name a vectoriser, which then serves rows and queries alike."""
    EMBEDDINGS[name] = function


def embedded(df: DataFrame, text: str, name: str = "hashed", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, EMBEDDINGS[name](F.col(text)))


def retrieved(chunks: DataFrame, questions: DataFrame, k: int, *, key: str, question: str, text: str = "content", name: str = "hashed", where: Column | None = None) -> DataFrame:
    """The k chunks nearest to each question's text, both embedded by one named
    function: ``(query_id, key, rank, similarity)``.  Filters come first."""
    rows = embedded((chunks if where is None else chunks.where(where)).select(key, text), text, name)
    asks = embedded(questions.select(F.col(question).alias(key), text), text, name)
    return nearest(rows, asks, k, key=key, itself=True)


def filing_context(chunks: DataFrame, filings: DataFrame, filing: str, order: str, content: str, raw: str, k: int = 4, limit: int = 40_000) -> DataFrame:
    """``(filing, context)``: the k best chunks of each filing, by ``order``, or,
    of one without chunks, the start of its raw text."""
    best = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(filing).orderBy(order))).where(F.col("_n") <= k)
    rows = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(content).alias("t"))))
    found = best.groupBy(filing).agg(F.array_join(F.transform(rows, lambda r: r.t), "\n\n").alias("_c"))
    joined = filings.select(filing, raw).join(found, filing, "left")
    return joined.select(filing, F.coalesce("_c", F.substring(F.col(raw), 1, limit)).alias("context"))


#: Rows and queries that meet in one task at most, and row blocks at least.
ROW_BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 32_768, 4_096, 32


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "id", vector: str = "embedding", metric: str = "cosine", itself: bool = False) -> DataFrame:
    """The exact k nearest rows of each query, itself (by key) left out unless asked for:
    ``(query_id, key, rank, similarity or distance)``; ties go to the smaller
    key.

    Blocks of rows meet blocks of queries, so no task holds more than one
    block of either; each pair's k best meet by query.  Rows without a vector
    are neither found nor ask.
    """
    cos = metric == "cosine"
    out = "similarity" if cos else "distance"

    def side(df: DataFrame, asks: bool, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        known = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
        others = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        dealt = known.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int")).withColumn(other, others)
        return dealt.select("qb", "rb", F.lit(asks).alias("asks"), "id", "v")

    n_rows = max(LEAST_BLOCKS, -(-rows.count() // ROW_BLOCK))
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))
    met = side(rows, False, "rb", n_rows, "qb", n_queries).unionByName(side(queries, True, "qb", n_queries, "rb", n_rows))

    def run(block):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def take(asks: bool):
            part = block.filter(pc.equal(block["asks"], asks))
            lists = part["v"].combine_chunks()
            ids, size = part["id"].to_numpy(), len(part)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
            v = flat.reshape(size, -1) if size else np.zeros((0, 0))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            with np.errstate(invalid="ignore", divide="ignore"):
                v = v / np.sqrt((v * v).sum(1))[:, None] if cos else v
            fine = np.isfinite(v).all(1)
            return ids[fine], np.ascontiguousarray(v[fine])

        (ids, v), (asking, w) = take(False), take(True)
        got = ([], [], [])
        square = (v * v).sum(1)
        for i in range(0, len(asking) if len(ids) else 0, 256):
            # Near values by one product, those in question exactly.
            about = square - 2 * (w[i : i + 256] @ v.T)
            for q, x, near in zip(asking[i : i + 256], w[i : i + 256], about, strict=True):
                if not itself:
                    near[ids == q] = np.inf
                last = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
                at = np.flatnonzero((near <= last + 1e-9 * (1 + abs(last) if np.isfinite(last) else 0)) & (near < np.inf))
                cost = -(v[at] * x).sum(1) if cos else np.sqrt(((v[at] - x) ** 2).sum(1))
                best = np.argsort(cost, kind="stable")[:k]
                got[0].append(np.full(len(best), q))
                got[1].append(ids[at[best]])
                got[2].append(cost[best])
        cols = [np.concatenate(g) if g else np.zeros(0) for g in got]
        return pa.table({"query_id": pa.array(cols[0]).cast(block["id"].type), key: pa.array(cols[1]).cast(block["id"].type), "cost": pa.array(cols[2], pa.float64())})

    kind = met.schema["id"].dataType.simpleString()
    found = met.groupBy("qb", "rb").applyInArrow(run, f"query_id {kind}, {key} {kind}, cost double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("cost", key))).where(F.col("rank") <= k)
    return ranked.select("query_id", key, "rank", (-F.col("cost") if cos else F.col("cost")).alias(out))


def tfidf_cosine(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, cosine)`` of the TF-IDF vectors of two texts, fitted to each pair:
    words of two characters or more in lower case, document frequencies over the
    pair's two texts, smoothed.  Zero where either text has no word."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    sides = [pairs.select(F.col(key), F.explode(words(F.col(c))).alias("word"), F.lit(x).alias("x"), F.lit(1 - x).alias("y")) for c, x in ((a, 1), (b, 0))]
    tf = sides[0].unionByName(sides[1]).groupBy(key, "word").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    weighted = tf.select(key, (F.col("x") * idf).alias("x"), (F.col("y") * idf).alias("y"))
    total = lambda u, v: F.sum(F.col(u) * F.col(v))
    found = weighted.groupBy(key).agg(F.coalesce(F.try_divide(total("x", "y"), F.sqrt(total("x", "x") * total("y", "y"))), F.lit(0.0)).alias("cosine"))
    return pairs.select(key).join(found, key, "left").na.fill({"cosine": 0.0})


def prompt_context(chunks: DataFrame, form: str, date: str, content: str, order: str, by: list[str] | None = None, k: int = 1000) -> DataFrame:
    """The first ``k`` chunks, by ``order``, as one text, or as one per group of
    ``by``: ``[form date]: content``, blank lines."""
    line = F.concat(F.lit("["), F.col(form), F.lit(" "), F.col(date).cast("string"), F.lit("]: "), F.col(content))
    keys = by or []
    rows = chunks.select(*keys, F.col(order).alias("o"), line.alias("t"))
    if keys:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "t"))).where(F.col("_n") <= k)
    else:
        rows = rows.orderBy("o", "t").limit(k)
    ordered = F.array_sort(F.collect_list(F.struct("o", "t")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r.t), "\n\n").alias("context"))


#: What an extraction prompt is made of: the schema's template, numbered rules
#: and the document.
PROMPT = "Extract the record of this template:\n{template}\n\nRules:\n{rules}\n\nDocument:\n"


def extraction_prompt(template: str, rules: list[str], content: Column) -> Column:
    numbered = "\n".join(f"{i}. {r}" for i, r in enumerate(rules, 1))
    return F.concat(F.lit(PROMPT.format(template=template, rules=numbered)), content)


def cache_key(model: str, prompt: Column) -> Column:
    """Where the answer to a prompt is kept: equal prompts to one model share it."""
    return F.sha1(F.encode(F.concat(F.lit(model + "\n"), prompt), "UTF-8"))
