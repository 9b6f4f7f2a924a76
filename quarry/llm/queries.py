"""The registered ``opN_<name>`` queries: thin wrappers that apply an operator
to its whole table and derive the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, interactions, media, packing, pii, quality, records, simhash, substring, suffix, tokens, toxicity, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeated_words(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeated_bytes(_documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(_documents(spark, sf_dir), *bpe.default_paths())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), *tokens.default_paths(), with_ids=False).drop("ids")


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = records.record_round_trip(_documents(spark, sf_dir), *tokens.default_paths())
    return back.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.film_features(media.media_column(_documents(spark, sf_dir)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_documents(spark, sf_dir))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.first, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE]
    # Both arrays are by kind, then start; a stable sort by kind and start
    # merges them.
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(pii.KINDS))
    everything = F.expr(
        f"transform(array_sort(transform(concat(base, added), s -> struct(CASE s.kind {place} END AS k, s.first AS a, s.end AS b, s AS span))), x -> x.span)"
    )
    return found.withColumn("spans", everything).select(
        "doc_id",
        *counts,
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model).select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return done.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interaction_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op11_whitening`` that SQL can say, from the same operator."""
    return op11_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_quality`` that SQL can say, from the same operator."""
    return op4_quality(spark, sf_dir).select("doc_id", *quality.FEATURES, "base_failed")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of ``op2_pii``."""
    return op2_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of ``op9_media``."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


#: Words, symbols, lines and windows of eight words by their own counts.
QUALITY_SQL = """
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\x0b\\f\\r]')) AS ls
    FROM documents
), p AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), again AS (
    SELECT doc_id, g FROM p GROUP BY doc_id, g HAVING count(*) > 1
), c AS (
    SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT p.doc_id, unnest(range(i, i + 8)) AS k FROM p JOIN again USING (doc_id, g)) GROUP BY doc_id
), f AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM w LEFT JOIN c USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
"""

#: Matches of the base patterns that hold.
PII_SQL = """
WITH m AS (
    SELECT doc_id,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS e,
        regexp_extract_all(coalesce(text, ''), '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS i,
        list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c,
        list_transform(regexp_extract_all(coalesce(text, ''), '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p
    FROM documents
)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
    CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: coalesce(TRY_CAST(y AS HUGEINT), 999))) <= 255)) AS BIGINT) AS n_ip,
    CAST(len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k:
        CASE WHEN (length(x) - k) % 2 = 0 THEN CAST(x[k] AS INTEGER) WHEN CAST(x[k] AS INTEGER) > 4 THEN 2 * CAST(x[k] AS INTEGER) - 9 ELSE 2 * CAST(x[k] AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
    CAST(len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM m
"""

#: Texts as bytes with their padding.
MEDIA_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(m - n AS BIGINT)))) AS payload_sha256
FROM (SELECT *, CAST(greatest(1, (n + 575) // 576) * 576 AS BIGINT) AS m FROM n)
"""

#: Every document at every step of every order, by the sets of filters that it fails.
OP12_SQL = """
WITH t AS (
    SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text, coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
), w AS (
    SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), f AS (
    SELECT part, good, toxic, MAP {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': first_id < doc_id} AS fails FROM w
), l AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step FROM o, unnest(range(1, 6)) AS u(step)
), c AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), r AS (
    SELECT part, filter_order, step, good, toxic, n, filter_order[step] AS own, fails[filter_order[step]] AS failed,
        coalesce(list_bool_or(list_transform(string_split(filter_order[:step - 1], ''), lambda x: x <> '' AND fails[x])), FALSE) AS earlier,
        len(list_filter(map_values(fails), lambda x: x)) AS n_failed
    FROM c, s
), m AS (
    SELECT part, filter_order, step, own,
        CAST(sum(CASE WHEN NOT earlier AND NOT failed THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN NOT earlier AND failed THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN earlier AND failed THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN NOT earlier AND failed AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN NOT earlier AND failed AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM r GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM m
"""

#: Deviations of whole vectors from the sums over distinct ones.
DEVIATION_SQL = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), d AS (
    SELECT DISTINCT x FROM x
), n AS (
    SELECT count(*) AS n FROM d
), s AS (
    SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(x[i]) AS HUGEINT) AS s FROM d, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY i)
)
SELECT vec_id, CAST(component AS INTEGER) AS component, n.n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i:
    CAST(n.n * x[i] - s[i] AS HUGEINT) * CAST(n.n * x[i] - s[i] AS HUGEINT))) AS BIGINT) AS deviation
FROM x, n, s, unnest(range(1, least(4, len(x)) + 1)) AS u(component)
"""

#: Windows by their words, found in a document with a smaller id.
OP5_SQL = """
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), f AS (
    SELECT h, min(doc_id) AS first_id FROM p GROUP BY h
), g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN f USING (h) WHERE first_id < doc_id
), kept AS (
    SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.k) AS body
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w) x
    LEFT JOIN g ON x.doc_id = g.doc_id AND x.k = g.k WHERE g.k IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Windows of bytes as hexadecimal digits, two a byte.
OP10_SQL = """
WITH w AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), p AS (
    SELECT doc_id, i, md5(substr(hx, 2 * i - 1, 200)) AS h
    FROM (SELECT doc_id, hx, unnest(range(1, len(hx) // 2 - 98)) AS i FROM w WHERE len(hx) >= 200)
), f AS (
    SELECT h, min(doc_id * 1000000000 + i) AS first_at FROM p GROUP BY h
), g AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS k FROM p JOIN f USING (h) WHERE first_at < doc_id * 1000000000 + i
), s AS (
    SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < k - 1) AS n_spans
    FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM g) GROUP BY doc_id
), kept AS (
    SELECT x.doc_id, string_agg(x.b, '' ORDER BY x.k) AS body
    FROM (SELECT doc_id, unnest(range(1, len(hx) // 2 + 1)) AS k, unnest(regexp_extract_all(hx, '..')) AS b FROM w) x
    LEFT JOIN g ON x.doc_id = g.doc_id AND x.k = g.k WHERE g.k IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, len(w.hx) // 2 AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept.body, ''))) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_simhash": op3_simhash,
        "op4_quality": op4_quality,
        "op5_substring": op5_substring,
        "op6_packing": op6_packing,
        "op7_bpe": op7_bpe,
        "op8_records": op8_records,
        "op9_media": op9_media,
        "op10_suffix_array": op10_suffix_array,
        "op11_whitening": op11_whitening,
        "op12_interactions": op12_interactions,
        "op13_quality_classifier": op13_quality_classifier,
        "whitening_deviations": whitening_deviations,
        "quality_counts": quality_counts,
        "pii_counts": pii_counts,
        "media_payloads": media_payloads,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_substring": OP5_SQL, "op10_suffix_array": OP10_SQL, "quality_counts": QUALITY_SQL, "pii_counts": PII_SQL, "media_payloads": MEDIA_SQL,
        "op12_interactions": OP12_SQL, "whitening_deviations": DEVIATION_SQL,
    }
