"""Registered queries over what is built or kept between runs: a vector index,
an automaton of many terms, archives as a stream, parsers as table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lemmas
from ..operators import chunking, retrieval, search, terms, vector_index
from ..operators import scope as scopes
from ..parsers import table_functions
from ..sources import sinks
from ..sources.archive_format import ArchiveSource
from ..streaming import ingest
from . import forms
from .queries import EACH, query, table
from .session import shared_folder

# Vector index ---------------------------------------------------------------------


def _index(spark, sf_dir, metric: str = "cosine") -> vector_index.Index:
    rows = table(spark, sf_dir, "embeddings")
    return vector_index.build(rows, shared_folder(spark, "vectors"), key="vec_id", metric=metric, carry=("label",))


@query(EACH.format("", 10))
def vec_index_exact(spark, sf_dir):
    """The lists that may hold a neighbour, by the index' own bounds."""
    asks = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    found = vector_index.probe(_index(spark, sf_dir), asks, 10, exact=True)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(EACH.format(" AND e.label IN (1, 2)", 5))
def vec_index_filtered(spark, sf_dir):
    asks = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    found = vector_index.probe(_index(spark, sf_dir), asks, 5, exact=True, where=F.col("label").isin(1, 2))
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS queries, true AS recall_90, true AS fewer_rows FROM embeddings WHERE vec_id % 50 = 0")
def vec_index_recall(spark, sf_dir):
    """The index as it is used, held against its exact side: whether the ten
    nearest are found nine times in ten, from fewer rows than there are."""
    rows = table(spark, sf_dir, "embeddings")
    index, asks = _index(spark, sf_dir, "euclid"), rows.where("vec_id % 50 = 0")
    found, want = (vector_index.probe(index, asks, 10, exact=x).select("query_id", "vec_id") for x in (False, True))
    hits = want.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    share = hits.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("recall_90"))
    routed = vector_index.routes(index, asks, 10, key="vec_id", vector="embedding")
    read = vector_index.rows_asked(index, routed).agg(F.count("*").alias("queries"), (F.avg("rows") < float(index.rows.sum())).alias("fewer_rows"))
    return read.join(F.broadcast(share)).select("queries", "recall_90", "fewer_rows")


# Many terms -------------------------------------------------------------------------

#: Two hundred short terms, a hundred of them in capitals at first.
MANY = [a + b for a in "aeioudlnrst" for b in "aeionrstlh"][:100]
MANY += [t.capitalize() for t in MANY]
MANY_ROWS = "(VALUES " + ", ".join(f"('{t}')" for t in MANY) + ") t(term)"
COUNTED = "(length({0}) - length(replace({0}, {1}, ''))) // length(term)"


@query(f"SELECT * FROM (SELECT doc_id, term, {COUNTED.format('text', 'term')} AS count FROM documents, {MANY_ROWS}) WHERE count > 0")
def sea_many_terms(spark, sf_dir):
    """Two hundred terms in one pass of each text."""
    return terms.substring_counts(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), MANY)


@query(f"SELECT lang, term, CAST(sum(count) AS BIGINT) AS count, count(*) AS documents FROM (SELECT lang, term, {COUNTED.format('lower(text)', 'lower(term)')} AS count FROM documents, {MANY_ROWS}) WHERE count > 0 GROUP BY lang, term")
def sea_terms_by_group(spark, sf_dir):
    """Terms whatever their case, summed by language."""
    found = search.term_counts(table(spark, sf_dir, "documents"), "lang", "text", MANY, case_sensitive=False)
    return found.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.count("*").alias("documents"))


# Archives -----------------------------------------------------------------------------


@query("SELECT source || '/' || doc_id || '.txt' AS member, sha1(text) AS sha1, CAST(1 AS BIGINT) AS times FROM documents")
def src_archive_stream(spark, sf_dir):
    """Archives arrive between two runs of a stream; every one is read once."""
    root = shared_folder(spark, "feed")
    spark.dataSource.register(ArchiveSource)
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", name.alias("m"), F.encode("text", "UTF-8").alias("c"))
    for part in (0, 1, None):
        if part is not None:
            sinks.write_archives(docs.where(F.col("doc_id") % 2 == part), "source", "m", "c", f"{root}/in")
        stream = spark.readStream.format("archive").option("suffix", ".txt").load(f"{root}/in")
        sink = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/seen")
        sink.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{root}/out")
    return back.groupBy("member", F.sha1("content").alias("sha1")).agg(F.count("*").alias("times"))


@query("SELECT lang AS archive, count(*) AS members, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def snk_archive_format(spark, sf_dir):
    """The sink as Spark's writer has it, read back by the format: what the
    commit's manifest says."""
    folder = shared_folder(spark, "archives")
    spark.dataSource.register(ArchiveSource)
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("archive"), F.col("doc_id").cast("string").alias("member"), F.encode("text", "UTF-8").alias("content"))
    sinks.in_ranges(docs).sortWithinPartitions("archive", "member").write.format("archive").mode("append").save(folder)
    back = spark.read.format("archive").load(folder)
    of = F.regexp_extract("archive", r"([^/-]*)-[^/]*$", 1)
    return back.groupBy(of.alias("archive")).agg(F.count("*").alias("members"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


# Table functions ------------------------------------------------------------------------

_KIND = "CASE WHEN l_linestatus = 'O' THEN 'nonderiv' ELSE 'deriv' END || CASE WHEN l_returnflag = 'N' THEN '_holding' ELSE '_transaction' END"


@query(
    f"SELECT 'a' || o_orderkey AS acc, 'submission' AS kind, CAST(1 AS BIGINT) AS position, 'R&D ' || c_name AS title, CAST(NULL AS DOUBLE) AS shares FROM {forms.ORDERS} "
    f"UNION ALL SELECT 'a' || o_orderkey, 'reporting_owner', 1, 'Owner ' || o_orderkey, NULL FROM {forms.ORDERS} "
    f"UNION ALL SELECT acc, {_KIND}, n, 'Part ' || l_partkey, l_suppkey FROM {forms.LINES} "
    f"UNION ALL SELECT 'a' || o_orderkey, 'footnote', 1, 'Held by ' || c_name, NULL FROM {forms.ORDERS} UNION ALL SELECT 'a' || o_orderkey, 'footnote', 2, 'Two', NULL FROM {forms.ORDERS} "
    f"UNION ALL SELECT 'a' || o_orderkey, 'signature', 1, '/s/ S' || o_custkey, NULL FROM {forms.ORDERS} UNION ALL SELECT 'a' || o_orderkey, 'signature', 2, 'no date', NULL FROM {forms.ORDERS} "
    "UNION ALL SELECT 'a' || o_orderkey, 'error', 1, 'unreadable form', NULL FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer)"
)
def udf_lateral_rows(spark, sf_dir):
    """Eight kinds of rows of each form from one parse, in SQL."""
    table_functions.register_all(spark)
    return spark.sql(
        "SELECT acc, r.kind, r.position, coalesce(r.fields['security_title'], r.fields['rptowner_name'], r.fields['footnote_text'], r.fields['signature_name'], r.fields['issuer_name'], r.fields['reason']) AS title, "
        "try_cast(r.fields['shares_owned_following_transaction'] AS double) AS shares FROM {forms} LATERAL VIEW inline(ownership_list(content)) r AS kind, position, fields",
        forms=forms._forms(spark, sf_dir).withColumn("content", F.col("content").cast("string")),
    )


# Questions and their contexts -------------------------------------------------------------

#: Letters whose counts stand for a text where SQL has to embed it too.
LETTERS = "etaonirslhdcumpf"


def _letters(text):
    return F.array(*((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


search.define_embedding("letters", _letters)
_V = _letters_sql("text")
_TURNS = f"(SELECT conv_id, turn, role, text, {_V} AS v FROM conversations)"
_NEAR = "round(list_cosine_similarity(c.v, q.v), 9)"


@query(
    f"WITH c AS (SELECT * FROM {_TURNS} WHERE conv_id % 7 <> 0), q AS (SELECT * FROM {_TURNS} WHERE turn = 0), "
    f"r AS (SELECT q.conv_id, c.turn, c.role, c.text, row_number() OVER (PARTITION BY q.conv_id ORDER BY {_NEAR} DESC, c.turn) AS n FROM q JOIN c ON c.conv_id = q.conv_id WHERE {_NEAR} IS NOT NULL AND NOT isnan({_NEAR})), "
    "f AS (SELECT conv_id, string_agg('[' || role || ' ' || turn || ']: ' || text, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS fragments FROM r WHERE n <= 4 GROUP BY conv_id), "
    "w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw FROM conversations GROUP BY conv_id) "
    "SELECT q.conv_id AS question_id, CASE WHEN context IS NOT NULL THEN context WHEN q.conv_id % 14 = 0 THEN 'Raw filing excerpt:' || chr(10) || substr(raw, 1, 40000) ELSE 'Filing text context unavailable.' END AS context, coalesce(fragments, 0) AS fragments "
    "FROM q LEFT JOIN f USING (conv_id) LEFT JOIN w USING (conv_id)"
)
def rag_answers(spark, sf_dir):
    """Each conversation's first turn asks its turns: four chunks, or the raw text
    of one that has none, or a note."""
    conv = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text)
    raw = conv.groupBy("conv_id").agg(F.array_join(turns, " ").alias("raw"))
    raw = raw.withColumn("raw", F.when(F.col("conv_id") % 14 == 0, F.col("raw")))
    asks = conv.where("turn = 0").select(F.col("conv_id").alias("question_id"), "conv_id", F.col("text").alias("question")).join(raw, "conv_id", "left")
    chunks = conv.where("conv_id % 7 <> 0").select("conv_id", F.col("turn").alias("chunk_id"), F.col("role").alias("form_type"), F.col("turn").alias("date_filed"), F.col("text").alias("content"))
    return retrieval.answers_context(asks, chunks, scope=["conv_id"], k=4, name="letters", raw="raw")


@query(
    f"WITH c AS (SELECT doc_id, source, lang, text, {_V} AS v FROM documents), q AS (SELECT item_id, text, {_V} AS v FROM benchmark), s AS (SELECT DISTINCT lang FROM documents), "
    f"r AS (SELECT q.item_id, s.lang, c.doc_id, {_NEAR} AS similarity, row_number() OVER (PARTITION BY q.item_id, s.lang ORDER BY {_NEAR} DESC, c.doc_id) AS n FROM q, s, c WHERE c.lang = s.lang AND {_NEAR} IS NOT NULL AND NOT isnan({_NEAR})) "
    "SELECT item_id || ' ' || lang AS question_id, CAST(n AS INTEGER) AS rank, doc_id AS chunk_id, round(similarity, 6) AS similarity FROM r WHERE n <= 3"
)
def rag_topics(spark, sf_dir):
    """Each benchmark text as a topic asks the documents of each language: three."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("lang", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    langs = docs.select("lang").distinct().agg(F.collect_set("lang").alias("langs"))  # a few languages
    topics = table(spark, sf_dir, "benchmark").join(F.broadcast(langs)).select("item_id", F.explode("langs").alias("lang"), F.col("text").alias("question"))
    asks = topics.withColumn("question_id", F.concat(F.col("item_id").cast("string"), F.lit(" "), F.col("lang")))
    found = retrieval.top_chunks(asks, chunks, 3, scope=["lang"], name="letters")
    return found.select("question_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"WITH c AS (SELECT id, {_letters_sql('content')} AS v FROM (SELECT doc_id * 1000 + i AS id, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS content FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS i) WHERE length(trim(text)) > 0)), "
    f"q AS (SELECT item_id, {_V} AS v FROM benchmark), r AS (SELECT item_id AS query_id, id, list_cosine_similarity(c.v, q.v) AS s FROM q, c WHERE list_sum(c.v) > 0) "
    "SELECT query_id, id, CAST(n AS INTEGER) AS rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM r) WHERE n <= 5"
)
def rag_retrieved(spark, sf_dir):
    """Texts of the benchmark ask for the five nearest chunks of all documents."""
    chunks = chunking.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("id"), "content")
    asks = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content"))
    found = search.retrieved(chunks, asks, 5, key="id", question="item_id", name="letters")
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def sea_lemma_counts(spark, sf_dir):
    """Words of all texts by the lemmas of some terms."""
    return lemmas.lemma_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["insults", "insulting", "thing", "things", "was", "being", "stations"])


# Scopes --------------------------------------------------------------------------------------


@query("SELECT 'orders' AS name, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey % 2 = 0")
def dml_scope(spark, sf_dir):
    """Two tables change together; a scope that fails between them changes none."""
    root = shared_folder(spark, "scope")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    with scopes.scope(spark, root) as s:
        s.put("orders", orders)
        s.put("lineitem", lines)
    with scopes.scope(spark, root) as s:
        s.put("orders", s.table("orders").where("o_orderkey % 2 = 0"))
        s.put("lineitem", s.table("lineitem").where("l_orderkey % 2 = 0"))
    try:
        with scopes.scope(spark, root) as s:
            s.put("orders", s.table("orders").limit(0))
            raise LookupError("between two tables")
    except LookupError:
        pass
    sides = [("orders", "o_orderkey"), ("lineitem", "l_orderkey")]
    each = [scopes.read(spark, root, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum(k).alias("keys")) for n, k in sides]
    return each[0].unionByName(each[1])


# Sections and cuts of whole given texts --------------------------------------------------------

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Lines of documents that begin with these words stand for headings.
_MARKED = "regexp_replace(regexp_replace(text, '(^|\n)(The|Le|Die|La) ', '\\1# \\2 ', 'g'), '(^|\n)(And|Of|Und|De) ', '\\1### \\2 ', 'g')"


@query(
    f"WITH l AS (SELECT doc_id, unnest(string_split({_MARKED}, chr(10))) AS line, unnest(range(len(string_split({_MARKED}, chr(10))))) AS n FROM documents), "
    "h AS (SELECT *, length(regexp_extract(line, '^(#+) .*$', 1)) AS level, sum(CASE WHEN regexp_matches(line, '^#+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS place FROM l), "
    f"s AS (SELECT doc_id, CAST(place AS BIGINT) AS place, trim(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (level = 0), ''), {_SPACES}) AS content, max(level) AS level, trim(max(CASE WHEN level > 0 THEN regexp_replace(line, '^#+ ', '') END)) AS title FROM h GROUP BY doc_id, place), "
    "p AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS above FROM s) "
    "SELECT doc_id, place, CASE WHEN level = 0 THEN 'prologue' WHEN level = 1 THEN title ELSE coalesce(above, 'unknown') || ' > unknown > ' || title END AS section, content FROM p WHERE content <> ''"
)
def txt_line_sections(spark, sf_dir):
    """Sections of all documents under their headings' path, by Spark's operators."""
    docs = table(spark, sf_dir, "documents")
    first = F.regexp_replace("text", r"(^|\n)(The|Le|Die|La) ", "$1# $2 ")
    return chunking.line_sections(docs.select("doc_id", F.regexp_replace(first, r"(^|\n)(And|Of|Und|De) ", "$1### $2 ").alias("md")), "doc_id", "md")


@query("SELECT o_orderkey, CAST(1 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS run FROM orders WHERE o_orderkey % 27 <> 0")
def str_quarantine(spark, sf_dir):
    """Three runs over one table: what fails waits and is tried again in the next."""
    root, orders = shared_folder(spark, "quarantine"), table(spark, sf_dir, "orders").select("o_orderkey")
    good = []
    for run in (1, 2, 3):
        rows = orders if run == 1 else orders.limit(0)
        done = ingest.with_quarantine(rows, root, "ok", lambda d, run=run: d.withColumn("ok", F.col("o_orderkey") % (3**run) != 0).withColumn("run", F.lit(run)))
        good.append(done.select("o_orderkey", "run"))
    return good[0].unionByName(good[1]).unionByName(good[2])
