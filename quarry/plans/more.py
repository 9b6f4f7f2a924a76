"""Registered queries over functions, evaluation, merges, streams and retrieval
that the first module does not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import values as V
from ..operators import evaluation, extension, merge, nested, relation, search
from ..sources import sinks
from ..streaming import ingest
from . import schemas
from .queries import query, table
from .session import shared_folder

# Text functions -----------------------------------------------------------------


@query("SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', '') || ' é_x' AS plain, 'S ' || p_partkey AS signer, '10-k' AS slug, 'DOC TYPE ' || p_partkey AS title, 'a\\&b\\%\\$\\_\\#' || p_partkey AS latex FROM part")
def fn_text_cleaning(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.drop_punctuation(F.concat("p_name", F.lit(" "), "p_brand", F.lit(", é_x!"))).alias("plain"),
        T.signer(F.concat(F.lit("/S/  S "), k)).alias("signer"), T.type_slug(F.lit("10-K/A")).alias("slug"),
        T.title_of(F.concat(F.lit("doc-type_"), k)).alias("title"), T.escape_latex(F.concat(F.lit("a&b%$_#"), k)).alias("latex"),
    )


@query("SELECT p_partkey, 'k' || p_partkey AS key, 'v é' AS value, CASE WHEN p_partkey % 2 = 0 THEN '0000000001-24-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS accession FROM part")
def fn_sanitise(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    acc = F.concat(F.lit("0000000001-24-"), F.lpad(k, 6, "0"))
    values = F.array(F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, acc).otherwise(F.concat(acc, F.lit("7"))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.printable(F.concat(F.lit("k\u0001"), k, F.lit("é "))).alias("key"),
        T.no_nul(F.concat(F.lit(" v\0 "), F.lit("é\0"))).alias("value"), T.find_accession(values).alias("accession"),
    )


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'issuer_cik' WHEN 1 THEN 'reporting_owners_0_name' WHEN 2 THEN 'derivative_transactions_0_conversion_or_exercise_price' WHEN 3 THEN 'derivative_transactions_1_underlying_security_shares' ELSE 'plain_name' END AS field, CASE n_nationkey % 5 WHEN 0 THEN 'issuer_cik' WHEN 1 THEN 'reporting_owners_name' WHEN 2 THEN 'derivative_transactions_conversion_or_exercise_price' WHEN 3 THEN 'derivative_transactions_underlying_security_shares' ELSE 'plain_name' END AS plain FROM nation")
def fn_canonical_key(spark, sf_dir):
    raw = ["issuer_issuer_cik", "reporting_owners_0_rptowner_name", "derivative_transactions_0_price", "derivative_transactions_1_shares", "plain_name"]
    field = evaluation.canonical_key(F.element_at(F.array(*map(F.lit, raw)), F.col("n_nationkey") % 5 + 1))
    return table(spark, sf_dir, "nation").select("n_nationkey", field.alias("field")).withColumn("plain", evaluation.without_index("field"))


@query("SELECT c_custkey, c_custkey % 4 < 2 AS agree FROM customer")
def fn_names_agree(spark, sf_dir):
    k = F.col("c_custkey") % 4
    key = F.when(k == 2, "title").otherwise("owner_name")
    other = F.when(k == 0, F.concat("c_name", F.lit(" Inc"))).when(k == 1, F.substring("c_name", 1, 5)).when(k == 2, F.concat("c_name", F.lit(" Inc"))).otherwise("zz")
    return table(spark, sf_dir, "customer").select("c_custkey", T.names_agree(key, "c_name", other).alias("agree"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'archive/data/' || c_custkey ELSE 'other/' || c_custkey END AS path FROM customer")
def fn_clean_path(spark, sf_dir):
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.when(F.col("c_custkey") % 4 == 0, "/Archives/data/").otherwise("data/"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("other/"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean_path(path).alias("path"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_partkey * 10000 AS BIGINT) AS VARCHAR) AS plain, format('{:,}', CAST(l_partkey * 10000 AS BIGINT)) || '.50' AS two, format('{:,}', CAST(l_partkey * 10000 AS BIGINT)) || '.5' AS four FROM lineitem")
def fn_number_display(spark, sf_dir):
    big = (F.col("l_partkey") * 10000).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.plain_float(big).alias("plain"), N.display(big + 0.5).alias("two"), N.display(big + 0.5, 0, 4).alias("four"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) ELSE 2024 END AS year FROM orders")
def fn_year_default(spark, sf_dir):
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.year_or(year, F.to_date(F.lit("2024-06-01"))).alias("year"))


@query("SELECT o_orderkey, o_orderkey % 5 < 2 AS strict, o_orderkey % 5 < 4 AS lenient FROM orders")
def fn_booleans(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("1", "true", "TRUE", " yes ", "no"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.strict_bool(raw).alias("strict"), V.xml_bool(raw).alias("lenient"))


@query("SELECT c_custkey, '1,' || c_custkey AS refs, 'a|b c' AS listed, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'other' END AS first FROM customer")
def fn_refs_and_lists(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("see [^ F1 ] and [f"), k, F.lit("] (x)"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(V.inline_refs(text), ",").alias("refs"), F.array_join(V.comma_list(F.lit(" a , ,b c,")), "|").alias("listed"),
        V.first_present(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), F.lit(None).cast("string"), F.lit("other")).alias("first"),
    )


@query("SELECT c_custkey, CAST(1000 + c_custkey AS BIGINT) AS a, 'x, y' AS b FROM customer")
def fn_json_block(spark, sf_dir):
    k = F.col("c_custkey")
    number = F.format_number(k + 1000, 0)
    plain = F.concat(F.lit('<thought>{"a": 0}</thought> so {"a": '), number, F.lit(', "b": "x, y"} end'))
    fenced = F.concat(F.lit('{"a": 0} ```json\n# note\n{"a": '), number, F.lit(', "b": "x, y"}\n``` {"a": 9}'))
    block = V.json_block(F.when(k % 2 == 0, plain).otherwise(fenced))
    return table(spark, sf_dir, "customer").select("c_custkey", F.from_json(block, "a long, b string").alias("r")).select("c_custkey", "r.*")


@query("SELECT p_partkey, CAST(p_partkey * 1000 AS DOUBLE) AS shares, 'n/a' AS price, '1,000' AS title, p_size AS size FROM part")
def fn_sanitised_record(spark, sf_dir):
    shares = F.concat(F.lit(" "), F.format_number(F.col("p_partkey") * 1000, 0), F.lit(" "))
    record = F.to_json(F.struct(F.array(F.struct(shares.alias("shares"), F.lit(" n/a ").alias("price"), F.lit(" 1,000").alias("title"), F.col("p_size").alias("size"))).alias("rows")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.from_json(evaluation.sanitised(record), "rows array<struct<shares: double, price: string, title: string, size: int>>").alias("r"))
    return rows.select("p_partkey", F.inline("r.rows"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'ALPHA LAND' WHEN 1 THEN 'BETA, THE' END AS description FROM nation")
def fn_code_descriptions(spark, sf_dir):
    sheet = "<xsl:choose><xsl:when test=\"$c='A1'\">\n  ALPHA\n LAND </xsl:when><xsl:when test=\"$c = 'B2'\">BETA<xsl:text>, THE</xsl:text></xsl:when></xsl:choose>"
    code = F.element_at(F.array(F.lit("A1"), F.lit(" b2 "), F.lit("C3")), F.col("n_nationkey") % 3 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", V.description_of(code, V.code_table(sheet)).alias("description"))


# Relations --------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer")
def prj_annotate_rename(spark, sf_dir):
    rows = relation.annotated(table(spark, sf_dir, "customer"), twice=F.col("c_acctbal") * 2)
    return relation.renamed(rows, {"c_custkey": "id", "c_name": "name"}, ["id", "name", "twice", "not there"])


@query("SELECT 'first' AS which, min(o_orderkey) AS o_orderkey FROM orders UNION ALL SELECT 'last', max(o_orderkey) FROM orders")
def srt_first_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return relation.first(orders, "o_orderkey").select(F.lit("first").alias("which"), "o_orderkey").unionByName(relation.last(orders, "o_orderkey").select(F.lit("last").alias("which"), "o_orderkey"))


@query("SELECT page_id, url FROM pages ORDER BY url, page_id")
def srt_paths(spark, sf_dir):
    return relation.ordered(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey = 5) > 0 AS some, (SELECT count(*) FROM customer WHERE c_custkey < 0) > 0 AS none, (SELECT c_name FROM customer WHERE c_custkey = 5) AS name")
def flt_exists_get(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    found = (relation.exists(relation.filtered(rows, c_custkey=5)), relation.exists(relation.filtered(rows, c_custkey__lt=0)), relation.get_or_404(rows, c_custkey=5).c_name)
    return spark.createDataFrame([found], "some boolean, none boolean, name string")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, true AS bounded FROM orders")
def win_batches(spark, sf_dir):
    sizes = relation.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("k"))
    return sizes.agg(F.sum("n").alias("n"), F.sum("k").alias("keys"), (F.max("n") < 1500).alias("bounded"))


# Evaluation -------------------------------------------------------------------------


@query("SELECT o_custkey AS key, string_agg(DISTINCT CAST(o_orderkey % 7 AS VARCHAR), '|' ORDER BY CAST(o_orderkey % 7 AS VARCHAR)) AS refs FROM orders GROUP BY 1")
def agg_merged_refs(spark, sf_dir):
    refs = F.array((F.col("o_orderkey") % 7).cast("string"), (F.col("o_orderkey") % 7).cast("string"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(V.merged_refs(refs).alias("refs"))


@query("SELECT p_brand AS kind, field, count(*) AS count FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'name' WHEN p_partkey % 5 = 0 THEN 'size' WHEN p_partkey % 2 = 0 THEN 'type' END AS field FROM part) WHERE field IS NOT NULL GROUP BY ALL")
def agg_first_mismatch(spark, sf_dir):
    k = F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("kind"), F.col("p_name").alias("t_name"), F.when(k % 3 != 0, F.col("p_name")).alias("f_name"),
        F.col("p_size").alias("t_size"), F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("f_size"),
        F.col("p_type").alias("t_type"), F.when(k % 2 == 0, "?").otherwise(F.col("p_type")).alias("f_type"),
    )
    return evaluation.first_mismatch(pairs, "kind", ["name", "size", "type"])


def _nested(spark, sf_dir):
    """Customers as nested records, true and as a reader might give them."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    truth = F.struct(
        F.struct(k.alias("issuer_cik"), F.col("c_name").alias("issuer_name")).alias("issuer"),
        F.array(F.struct(F.lit("Texas").alias("state"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("price"), F.lit("1 Main St.").alias("street1"), F.lit("Floor 2").alias("street2"))).alias("reporting_owners"),
        F.array(F.lit("F2"), F.lit("F1")).alias("note_fn"), F.lit("").alias("gone"),
    )
    found = F.struct(
        F.struct(T.zfill(k).alias("issuer_cik"), F.when(k % 2 == 0, F.substring("c_name", 1, 8)).otherwise(F.lit("nobody")).alias("issuer_name")).alias("issuer"),
        F.array(F.struct(F.lit("tx").alias("state"), F.when(k % 3 == 0, F.lit("1,0")).otherwise(F.format_number("c_acctbal", 2)).alias("price"), F.lit("Floor 2").alias("street1"), F.lit("1 Main St.").alias("street2"))).alias("reporting_owners"),
        F.when(k % 5 == 0, F.lit("[^1]")).otherwise(F.lit("[^1] [^2]")).alias("note_fn"), F.when(k % 7 == 0, "more").otherwise("n/a").alias("extra"),
    )
    return [evaluation.comparable(evaluation.long_form(c.select(k.alias("key"), F.to_json(r).alias("record")), "key", "record")) for r in (truth, found)]


MISS = "count(*) FILTER ({0}) AS tp, count(*) FILTER (NOT ({0})) AS fp, count(*) FILTER (NOT ({0})) AS fn"


@query(
    "SELECT 'issuer_cik' AS field, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM customer UNION ALL "
    f"SELECT 'issuer_name', {MISS.format('c_custkey % 2 = 0')} FROM customer UNION ALL SELECT 'reporting_owners_state', count(*), 0, 0 FROM customer UNION ALL "
    f"SELECT 'reporting_owners_price', {MISS.format('c_custkey % 3 <> 0 OR c_acctbal = 10')} FROM customer UNION ALL SELECT 'note_fn', {MISS.format('c_custkey % 5 <> 0')} FROM customer UNION ALL "
    "SELECT 'extra', 0, count(*) FILTER (c_custkey % 7 = 0), 0 FROM customer UNION ALL SELECT 'reporting_owners_street_combined', count(*), 0, 0 FROM customer"
)
def eva_scored_fields(spark, sf_dir):
    return evaluation.scored_fields(*(evaluation.with_streets(r) for r in _nested(spark, sf_dir)))


@query(
    "SELECT c_custkey AS key, 'issuer_cik' AS field, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS value FROM customer UNION ALL SELECT c_custkey, 'issuer_name', replace(lower(c_name), '#', '') FROM customer UNION ALL "
    "SELECT c_custkey, 'reporting_owners_0_state', 'tx' FROM customer UNION ALL SELECT c_custkey, 'reporting_owners_0_street1', '1 main st' FROM customer UNION ALL SELECT c_custkey, 'reporting_owners_0_street2', 'floor 2' FROM customer UNION ALL "
    "SELECT c_custkey, 'reporting_owners_0_price', regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') FROM customer UNION ALL SELECT c_custkey, 'note_fn', '1|2' FROM customer"
)
def eva_comparable(spark, sf_dir):
    return _nested(spark, sf_dir)[0]


@query("SELECT lang AS field, '| ' || lang || ' | 0.500 | 0.250 | 0.333 | ' || n || ' |' AS line, replace(lang, '_', '\\_') || ' & 0.500 & 0.250 & 0.333 & ' || n || ' \\\\' AS tex FROM (SELECT lang || '_x' AS lang, count(*) AS n FROM documents GROUP BY lang)")
def eva_report_rows(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").groupBy(F.concat("lang", F.lit("_x")).alias("field")).agg(F.count("*").alias("support"))
    scores = scores.select("field", F.lit(0.5).alias("precision"), F.lit(0.25).alias("recall"), F.lit(1 / 3).alias("f1"), "support")
    return evaluation.report_rows(scores).join(evaluation.report_rows(scores, "latex").withColumnRenamed("line", "tex"), "field")


@query("SELECT 'issuer' AS section, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'all', count(*) FROM nation")
def eva_sections(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "issuer_x").otherwise("owner_x").alias("field"))
    return evaluation.sections_of(fields, {"issuer": "^issuer", "all": "_x$"}).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def eva_held_out(spark, sf_dir):
    return evaluation.held_out(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", 25)


# Merges and versions ------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def dml_not_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, c_name || '2' AS c_name FROM customer")
def dml_published_version(spark, sf_dir):
    """Two versions are published; a reader of the pointer sees the second."""
    root, rows = shared_folder(spark, "versions"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    merge.switch(spark, root, merge.publish(rows, root))
    merge.switch(spark, root, merge.publish(rows.withColumn("c_name", F.concat("c_name", F.lit("2"))), root))
    merge.publish(rows.limit(0), root)  # written, not switched to
    return merge.current(spark, root)


@query("SELECT 'region' AS table, CAST(0 AS INTEGER) AS place, count(*) AS rows FROM region UNION ALL SELECT 'nation', 1, count(*) FROM nation UNION ALL SELECT 'customer', 2, count(*) FROM customer UNION ALL SELECT 'supplier', 3, count(*) FROM supplier")
def dml_copy_tables(spark, sf_dir):
    depends = {"supplier": ["nation"], "customer": ["nation"], "nation": ["region"], "region": []}
    return merge.copy_tables(spark, lambda t: table(spark, sf_dir, t), shared_folder(spark, "copy"), depends)


@query("SELECT unnest(['company', 'filing']) AS name")
def dml_missing_tables(spark, sf_dir):
    schemas.empty(spark, "form_index").createOrReplaceTempView("form_index")
    missing = merge.missing_tables(spark, ["company", "form_index", "filing"])
    return spark.createDataFrame([(m,) for m in missing], "name string")


@query("SELECT o_custkey AS session, 'q' || (o_orderkey % 3) AS question, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey % 3 AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT DISTINCT o_custkey, o_orderkey % 3 FROM orders) GROUP BY ALL")
def dml_append_unless(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.concat(F.lit("q"), (F.col("o_orderkey") % 3).cast("string")).alias("question"), "o_orderkey")
    old = rows.where("o_orderkey % 2 = 0").select("session", "question").distinct()
    both = merge.append_unless(old, rows.select("session", "question").distinct(), ["session", "question"])
    return both.groupBy("session", "question").agg(F.count("*").alias("n"))


# Streams ---------------------------------------------------------------------------------


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id UNION ALL SELECT user_id, max(event_id) FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY user_id")
def str_ingest(spark, sf_dir):
    """Files arrive twice; the first has half of the events, the second all, and
    the run after the last finds nothing new."""
    root, events = shared_folder(spark, "stream"), table(spark, sf_dir, "events").select("user_id", "event_id")
    target = f"{root}/target"
    for n, rows in (("a", events.where("event_id % 2 = 0")), ("b", events), ("b", None)):
        if rows is not None:
            rows.coalesce(1).write.parquet(f"{root}/in/{n}")
        stream = ingest.file_stream(spark, f"{root}/in/*", events.schema)
        ingest.ingest_new(stream, target, "user_id", f"{root}/checkpoint", by="event_id").awaitTermination()
    return spark.read.parquet(target).select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS tries FROM orders")
def str_second_try(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 3 != 0).alias("ok"), F.lit(1).alias("tries"))
    good, errors = ingest.with_second_try(rows, "ok", lambda bad: bad.select("o_orderkey", (k % 2 == 0).alias("ok"), F.lit(2).alias("tries")))
    return good.unionByName(errors.drop("is_error"))


@query("SELECT regexp_extract(url, '[^/]*$') AS name, sha1(html) AS sha1 FROM (SELECT 'x/' || page_id AS url, html FROM pages)")
def str_fan_out(spark, sf_dir):
    def task(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            done = [hashlib.sha1(h.encode()).hexdigest() for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(done)], names=["name", "sha1"])

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), "html")
    return ingest.fan_out(pages, task, "name string, sha1 string")


# Search, retrieval, extension points ----------------------------------------------------


@query("SELECT conv_id AS filing, min(turn) FILTER (turn % 2 = 1) AS sequence, 'd.PDF' AS name FROM conversations GROUP BY conv_id HAVING min(turn) FILTER (turn % 2 = 1) IS NOT NULL")
def sea_primary_document(spark, sf_dir):
    name = F.when(F.col("turn") % 2 == 1, "d.PDF").otherwise("d.xml")
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("filing"), F.col("turn").alias("sequence"), name.alias("name"))
    return search.primary_document(docs, "filing", "name", "sequence")


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(CASE WHEN n <= 4 THEN text END, chr(10) || chr(10) ORDER BY turn) ELSE substr(string_agg(text, ' ' ORDER BY turn), 1, 300) END AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def rag_filing_context(spark, sf_dir):
    """The best chunks of a filing, or the start of its raw text without any."""
    conv = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text)
    filings = conv.groupBy("conv_id").agg(F.array_join(turns, " ").alias("raw"))
    return search.filing_context(conv.where("conv_id % 2 = 0"), filings, "conv_id", "turn", "text", "raw", 4, 300)


@query("SELECT conv_id, turn, sha1('m1' || chr(10) || 'Extract the record of this template:' || chr(10) || '{}' || chr(10) || chr(10) || 'Rules:' || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || 'Document:' || chr(10) || text) AS cache_key FROM conversations")
def rag_prompt_key(spark, sf_dir):
    prompt = search.extraction_prompt("{}", ["one", "two"], F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.cache_key("m1", prompt).alias("cache_key"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN length(text) || ' chars' END AS answer FROM conversations")
def udf_provider(spark, sf_dir):
    extension.register_provider("Counter", lambda prompts: [f"{len(p)} chars" for p in prompts])
    asked = F.when(F.col("turn") % 3 != 0, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extension.answers(asked, "counter").alias("answer"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 3) END AS head FROM documents")
def udf_document_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("k"), "doc_id", "text")

    def extract(text):
        return {"chars": len(text), "head": text[:3]}

    found = extension.document_data(docs, "doc_id", "text", extract, "chars long, head string")
    return found.select("doc_id", "chars", F.when(F.col("doc_id") % 2 == 0, F.col("head")).alias("head"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ID_CUSIP' ELSE 'TICKER' END AS id_type, 'x' || c_custkey AS id_value, CASE WHEN c_custkey % 5 = 0 THEN 'F' || c_custkey END AS figi FROM customer WHERE c_custkey % 3 <> 2")
def sym_resolved(spark, sf_dir):
    k, x = F.col("c_custkey"), F.concat(F.lit("x"), F.col("c_custkey").cast("string"))
    companies = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, x).otherwise(" ").alias("cusip"), F.when(k % 3 != 2, x).alias("ticker"))
    kind = F.when(k % 3 == 0, "ID_CUSIP").otherwise("TICKER")
    mapping = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(kind.alias("id_type"), x.alias("id_value"), F.concat(F.lit("F"), k.cast("string")).alias("figi"))
    return extension.resolved(companies, mapping, "c_custkey")


@query("SELECT key, markdown FROM (SELECT c_custkey AS key, '* **NAME:** ' || c_name || chr(10) || '## ADDRESS LINES' || chr(10) || '* **NATION KEY:** ' || c_nationkey AS markdown FROM customer WHERE c_nationkey > 0 UNION ALL SELECT c_custkey, '* **NAME:** ' || c_name FROM customer WHERE c_nationkey = 0)")
def fn_metadata_headings(spark, sf_dir):
    record = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation-key"), F.lit("").alias("empty")).alias("address_lines")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), nested.metadata_markdown(record).alias("markdown"))


@query("SELECT doc_id, n AS chunk_index, content FROM (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS content FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN [] ELSE ['# T' || doc_id || chr(10) || repeat('a', 40), '## S' || chr(10) || repeat('b', 40)] END AS p FROM documents))")
def txt_synthesis(spark, sf_dir):
    """A primary document to Markdown to fragments; nothing where it fails."""
    from ..operators import chunking
    from ..parsers import registry

    k = F.col("doc_id")
    page = F.concat(F.lit("<h1>T"), k.cast("string"), F.lit("</h1>"), F.repeat(F.lit("a"), F.lit(40)), F.lit("<h2>S</h2>"), F.repeat(F.lit("b"), F.lit(40)))
    kind = F.when(k % 10 == 0, "application/pdf").otherwise("text/html")
    md = F.regexp_replace(registry.document_markdown(page, kind, F.lit("")), "\n+", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", md.alias("md")).where("md <> ''")
    return chunking.chunk_rows(rows, "doc_id", "md", 60, 2).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("SELECT 'a' || c_custkey || '.sgml' AS path, c_custkey FROM customer WHERE c_custkey % 2 = 0")
def snk_names_of_done(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(sinks.document_name(F.concat(F.lit("a"), F.col("c_custkey").cast("string")), F.lit(""), F.lit(0), "").alias("n"), "c_custkey")
    return names.where("c_custkey % 2 = 0").select(F.concat(F.regexp_replace("n", r"\.00$", ""), F.lit(".sgml")).alias("path"), "c_custkey")


@query(
    "SELECT doc_id, s.section, s.content FROM documents, LATERAL (VALUES ('prologue', 'intro ' || doc_id), ('R ' || lang, 'body'), ('R ' || lang || ' > unknown > Deep', 'more' || chr(10) || 'lines'), ('D', 'z')) s(section, content)"
)
def txt_breadcrumbs(spark, sf_dir):
    """Sections under the path of their headings; levels left out, headings with
    nothing below them."""
    from ..operators import chunking

    md = F.concat(F.lit("intro "), F.col("doc_id").cast("string"), F.lit("\n# R "), F.col("lang"), F.lit("\nbody\n### Deep\n\nmore\nlines\n## B\n\n# D\nz"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(chunking.markdown_sections(md)))


CUTS = "(SELECT doc_id, 60 + doc_id % 20 AS l FROM documents)"


@query(
    f"SELECT doc_id || '_' || s || '_' || i AS id, doc_id, CAST(i AS INTEGER) AS chunk_index, content, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos FROM {CUTS}, "
    "LATERAL (VALUES (0, repeat('a', l), 0, l + 1), (1, repeat('b', 60), l + 1, l + 62), (2, '# T' || chr(10) || repeat('c', 96), l + 62, l + 162), (3, repeat('c', 54), l + 162, l + 216)) v(i, content, s, e)"
)
def txt_cut_points(spark, sf_dir):
    """Cuts at a line break, at a heading, and hard ones, of texts of known shape."""
    from ..operators import chunking

    size = (F.col("doc_id") % 20 + 60).cast("int")
    text = F.concat(F.repeat(F.lit("a"), size), F.lit("\n"), F.repeat(F.lit("b"), F.lit(60)), F.lit("\n# T\n"), F.repeat(F.lit("c"), F.lit(150)))
    return chunking.chunk_rows(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "doc_id", "t", 100, 2)
