"""Registered queries over sources and sinks: each writes files or builds file
contents from the shared tables, reads them back through the engine's readers,
and has SQL for what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import merge
from ..sources import archives, facts, index_files, listing, sinks, tables
from .queries import query, table
from .session import shared_folder


def _written(lines: DataFrame, name: str, one_each: bool = False) -> str:
    """A folder of text files of a column ``value``; one row a file if asked."""
    path = shared_folder(lines.sparkSession, name)
    writer = lines.select("value").write
    (writer.option("maxRecordsPerFile", 1) if one_each else writer).text(path)
    return path


#: An accession number made of an order's key and date.
ACC = "concat(lpad(CAST(o_orderkey AS STRING), 10, '0'), '-', date_format(o_orderdate, 'yy'), '-', lpad(CAST(o_custkey AS STRING), 6, '0'))"
ACC_SQL = "lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0')"
DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


def _index_lines(orders: DataFrame) -> DataFrame:
    line = f"concat_ws('|', o_custkey, concat('Company ', o_custkey), concat('10-', o_orderstatus), date_format(o_orderdate, 'yyyy-MM-dd'), concat('archive/data/', o_custkey, '/', {ACC}, '.txt'))"
    head = orders.sparkSession.createDataFrame([("Description: Master Index",), ("CIK|Company Name|Form Type|Date Filed|Filename",), ("-" * 80,)], "value string")
    return head.unionByName(orders.select(F.expr(line).alias("value")))


@query(
    f"SELECT o_custkey AS cik, 'Company ' || o_custkey AS company, '10-' || o_orderstatus AS form, {DAY_SQL} AS filed, {ACC_SQL} AS accession_number, "
    f"'https://h/archive/data/' || o_custkey || '/' || replace({ACC_SQL}, '-', '') || '/' || {ACC_SQL} || '.txt' AS document_url, "
    f"'https://h/archive/data/' || o_custkey || '/' || replace({ACC_SQL}, '-', '') || '/' || {ACC_SQL} || '-index.html' AS homepage_url FROM orders"
)
def src_master_index(spark, sf_dir):
    rows = index_files.master_index(spark, _written(_index_lines(table(spark, sf_dir, "orders")), "master"), "https://h")
    return rows.select("cik", "company", "form", F.col("filing_date").cast("string").alias("filed"), "accession_number", "document_url", "homepage_url")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND quarter(o_orderdate) IN (1, 3) GROUP BY 1, 2")
def src_quarters(spark, sf_dir):
    root = shared_folder(spark, "quarters")
    for year in (1996, 1997):
        for quarter in (1, 3):  # the others are not there
            some = table(spark, sf_dir, "orders").where((F.year("o_orderdate") == year) & (F.quarter("o_orderdate") == quarter))
            _index_lines(some).write.text(f"{root}/{year}/QTR{quarter}")
    return index_files.quarters(spark, root, [1995, 1996, 1997]).groupBy("year", "quarter").agg(F.count("*").alias("n"), F.sum("cik").alias("keys"))


@query(f"SELECT '10-' || o_orderstatus AS form, 'Company ' || o_custkey AS company, o_custkey AS cik, {DAY_SQL} AS filed, 'archive/data/' || o_orderkey || '.txt' AS file FROM orders")
def src_daily_index(spark, sf_dir):
    cells = [("rpad", "concat('10-', o_orderstatus)", 12), ("rpad", "concat('Company ', o_custkey)", 40), ("rpad", "o_custkey", 12), ("rpad", "date_format(o_orderdate, 'yyyyMMdd')", 12)]
    line = "concat(" + ", ".join(f"{f}(CAST({c} AS STRING), {n}, ' ')" for f, c, n in cells) + ", concat('archive/data/', o_orderkey, '.txt'))"
    head = "Form Type".ljust(12) + "Company Name".ljust(40) + "CIK".ljust(12) + "Date Filed".ljust(12) + "File Name"
    lines = spark.createDataFrame([(head,), ("-" * 100,)], "value string").unionByName(table(spark, sf_dir, "orders").select(F.expr(line).alias("value")))
    got = index_files.daily_index(spark, _written(lines, "daily"))
    return got.select(
        F.col("`Form Type`").alias("form"), F.col("`Company Name`").alias("company"), F.col("CIK").alias("cik"),
        F.col("`Date Filed`").cast("string").alias("filed"), F.col("`File Name`").alias("file"),
    )


@query("SELECT o_orderpriority AS name, count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AS bad FROM orders GROUP BY 1")
def src_index_quality(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"), F.when(k % 3 != 0, F.col("o_custkey")).alias("cik"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("filing_date"), F.when(k % 7 != 0, "a.txt").otherwise("").alias("filename"),
    )
    return index_files.index_quality(rows, "name")


@query("SELECT DISTINCT unnest(string_split(replace(p_type, ' ', ', ') || ', X', ', ')) AS form, 'size ' || p_size AS description FROM part")
def src_form_list(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(", X")).alias("forms"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("description"))
    rows = parts.unionByName(spark.createDataFrame([(None, "none")], "forms string, description string"))
    return index_files.form_list(rows, "forms", "description").distinct()


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'T' || c_custkey AS ticker, c_name AS name FROM customer")
def src_company_tickers(spark, sf_dir):
    entry = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"))
    # A file for each segment, as the map of one file is one document.
    one = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry))).alias("m"))
    return facts.tickers(spark, _written(one.select(F.to_json("m").alias("value")), "tickers", one_each=True))


def _facts_folder(spark, sf_dir) -> str:
    point = F.struct(
        F.col("c_acctbal").alias("val"), F.concat(F.lit("a-"), F.col("c_custkey").cast("string")).alias("accn"),
        F.lit("2024-03-31").alias("end"), F.lit("2024-05-01").alias("filed"),
        F.when(F.col("c_custkey") % 2 == 0, 2024).alias("fy"), F.lit("Q1").alias("fp"), F.lit("10-Q").alias("form"),
    )
    points = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list(point)).alias("p"))
    label = F.concat(F.lit("Label "), F.col("c_mktsegment"))
    concept = F.struct(label.alias("label"), F.lit("text").alias("description"), F.create_map(F.lit("USD"), F.col("p")).alias("units"))
    one = points.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_mktsegment"), concept))).alias("m"))
    body = F.struct(F.col("c_nationkey").alias("cik"), F.lit("name").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("m")).alias("facts"))
    return _written(one.select(F.to_json(body).alias("value")), "facts", one_each=True)


@query("SELECT c_mktsegment || '_a-' || c_custkey || '_USD_2024-03-31_' AS id, lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, c_mktsegment AS fact, 'us-gaap' AS namespace, c_acctbal AS val, CASE WHEN c_custkey % 2 = 0 THEN 2024 ELSE 0 END AS fy, 'Q1' AS fp, '' AS frame FROM customer")
def src_company_facts(spark, sf_dir):
    rows, _ = facts.company_facts(spark, _facts_folder(spark, sf_dir))
    return rows.select("id", "cik", "fact", "namespace", "val", "fy", "fp", "frame")


@query("SELECT DISTINCT c_mktsegment AS fact, 'Label ' || c_mktsegment AS label, 'text' AS description FROM customer")
def src_fact_concepts(spark, sf_dir):
    _, concepts = facts.company_facts(spark, _facts_folder(spark, sf_dir))
    return concepts


@query("SELECT CAST(n_nationkey AS BIGINT) AS cik, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def src_submissions(spark, sf_dir):
    body = F.to_json(F.struct(F.col("n_nationkey").alias("cik"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("filings")))
    folder = _written(table(spark, sf_dir, "nation").select(F.replace(body, F.lit(","), F.lit(",\n")).alias("value")), "submissions", one_each=True)
    return facts.submissions(spark, folder).select("cik", "name", F.col("filings.region").alias("region"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, true AS keyed FROM nation")
def src_records_by_file(spark, sf_dir):
    folder = _written(table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")), "records", one_each=True)
    rows = facts.records_by_file(spark, folder).withColumn("keyed", F.col("key").startswith("part-"))
    return rows.select(F.get_json_object("record", "$.n_nationkey").cast("long").alias("k"), F.get_json_object("record", "$.n_name").alias("name"), "keyed")


@query("SELECT DISTINCT trim(k) AS key FROM (SELECT unnest(string_split(CASE WHEN c_custkey % 5 = 0 THEN ' , ' ELSE c_name || ' , ' || c_mktsegment END, ',')) AS k FROM customer) WHERE trim(k) <> ''")
def src_key_list(spark, sf_dir):
    line = F.when(F.col("c_custkey") % 5 == 0, " , ").otherwise(F.concat_ws(" , ", "c_name", "c_mktsegment"))
    return listing.key_list(spark, _written(table(spark, sf_dir, "customer").select(line.alias("value")), "keys"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, 'a' || o_orderkey AS accession, CASE WHEN o_orderkey % 2 = 0 THEN 'htm' ELSE 'sgml' END AS suffix FROM orders")
def src_path_parts(spark, sf_dir):
    name = F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".htm.zstd").otherwise(".sgml.zst"))
    path = F.concat_ws("/", F.lit("/store"), F.year("o_orderdate").cast("string"), F.concat(F.lit("QTR"), F.quarter("o_orderdate").cast("string")), name)
    return table(spark, sf_dir, "orders").select("o_orderkey", listing.path_parts(path).alias("p")).select("o_orderkey", "p.*")


@query("SELECT DISTINCT c_mktsegment AS prefix FROM customer ORDER BY 1 LIMIT 3")
def src_prefixes(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat_ws("/", "c_mktsegment", "c_name").alias("path"))
    return listing.prefixes(keys, "path", 3)


@query("SELECT '/d/' || o_custkey AS folder, string_agg('/d/' || o_custkey || '/' || o_orderkey || x.e || '=' || x.l, ',' ORDER BY '/d/' || o_custkey || '/' || o_orderkey || x.e) AS files FROM orders, LATERAL (SELECT CASE o_orderkey % 3 WHEN 0 THEN '.sgml.zst' WHEN 1 THEN '.out.md.zst' ELSE '.pdf' END AS e, CASE o_orderkey % 3 WHEN 0 THEN 'envelope' WHEN 1 THEN 'markdown' ELSE 'other' END AS l) x GROUP BY o_custkey")
def src_labelled_files(spark, sf_dir):
    k = F.col("o_orderkey")
    end = F.when(k % 3 == 0, ".sgml.zst").when(k % 3 == 1, ".out.md.zst").otherwise(".pdf")
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("/d/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string"), end).alias("path"))
    found = listing.with_labels(paths, "path", {".sgml.zst": "envelope", ".out.md.zst": "markdown"})
    return found.select("folder", F.array_join(F.transform("files", lambda f: F.concat_ws("=", f.path, f.label)), ",").alias("files"))


LISTING_HTML = "'<a href=\"../\">Parent Directory</a><a class=\"x\" href=\"f' || n_nationkey || '.tar\">f</a> <A HREF=\"/abs/10-K/' || n_regionkey || '\">g</A>'"


@query("SELECT DISTINCT base, target FROM (SELECT '/r/' || n_regionkey AS base, '/r/' || n_regionkey || '/f' || n_nationkey || '.tar' AS target FROM nation UNION ALL SELECT '/r/' || n_regionkey, '/abs/10-K/' || n_regionkey FROM nation)")
def src_directory_entries(spark, sf_dir):
    return listing.directory_entries(table(spark, sf_dir, "nation").select(F.expr("concat('/r/', n_regionkey)").alias("base"), F.expr(LISTING_HTML).alias("html")), "base", "html")


@query("SELECT path, bool_or(here) AS here FROM (SELECT '/abs/10-K/' || n_regionkey AS path, false AS here FROM nation UNION ALL SELECT '/abs/10-K/' || (n_nationkey % 9), true FROM nation) GROUP BY path")
def src_discovered(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pages = nation.select(F.lit("/r").alias("base"), F.expr(LISTING_HTML).alias("html"))
    local = nation.select(F.expr("concat('/abs/10-K/', n_nationkey % 9)").alias("p")).unionByName(spark.createDataFrame([("/abs/10-Q/1",)], "p string"))
    return listing.discovered(pages, "base", "html", local, "p", "10-K")


DAYS = "(SELECT DISTINCT o_orderdate, year(o_orderdate) AS y, quarter(o_orderdate) AS q, day(o_orderdate) AS d FROM orders)"


@query(f"SELECT strftime(o_orderdate, '%Y%m%d') AS day, '/feed/' || y || '/QTR' || q || '/RAW/' || strftime(o_orderdate, '%Y%m%d') || '.nc.tar' || CASE WHEN d % 3 = 0 THEN '.gz' ELSE '.zst' END AS path FROM {DAYS} WHERE y >= 1996")
def src_best_archives(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("t")).distinct()
    kinds = F.when(F.dayofmonth("t") % 3 == 0, F.array(F.lit(".gz"), F.lit(""))).otherwise(F.array(F.lit(".gz"), F.lit(".zst"), F.lit(".bad")))
    path = F.concat(F.lit("/feed/"), F.year("t").cast("string"), F.lit("/QTR"), F.quarter("t").cast("string"), F.lit("/RAW/"), F.date_format("t", "yyyyMMdd"), F.lit(".nc.tar"), F.col("k"))
    return archives.best_archives(days.withColumn("k", F.explode(kinds)).select(path.alias("path")), since=1996)


@query("SELECT doc_id, sha1(text) AS sha1, substr(hex(encode(substr(text, 1, 30))), 1, 20) AS head FROM documents")
def src_packed_blobs(spark, sf_dir):
    """Packed as zstd and as gzip, unpacked again; a byte range of either."""
    raw = F.encode("text", "UTF-8")
    packed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, codecs.pack_zstd(raw)).otherwise(codecs.pack_gzip(raw)).alias("b"))
    plain = packed.select("doc_id", codecs.unpack("b").alias("b"))
    return plain.select("doc_id", F.sha1("b").alias("sha1"), F.hex(archives.segment("b", 0, 10)).alias("head"))


@query("SELECT doc_id, sha1(text) AS sha1, true AS zstd FROM documents")
def snk_recompressed(spark, sf_dir):
    packed = table(spark, sf_dir, "documents").select("doc_id", codecs.pack_gzip(F.encode("text", "UTF-8")).alias("b"))
    done = packed.select("doc_id", codecs.recompressed("b").alias("b"))
    return done.select("doc_id", F.sha1(codecs.unpack("b")).alias("sha1"), F.hex(F.substring("b", 1, 4)).eqNullSafe("28B52FFD").alias("zstd"))


@query("SELECT source AS archive, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS member, sha1(text) AS sha1 FROM documents")
def snk_archive_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("m"), F.encode("text", "UTF-8").alias("c"))
    written = sinks.write_archives(docs, "source", "m", "c", shared_folder(spark, "archives"))
    back = archives.archive_members(written, suffix=".txt")
    return back.select(F.substring_index("member", "/", 1).alias("archive"), "member", F.sha1("content").alias("sha1"))


@query("SELECT lang AS archive, count(*) AS members FROM documents GROUP BY lang")
def snk_archive_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("m"), F.encode("text", "UTF-8").alias("c"))
    written = sinks.write_archives(docs, "lang", "m", "c", shared_folder(spark, "archives"))
    return written.groupBy("archive").agg(F.sum("members").alias("members"))


@query("SELECT conv_id || '.sgml.zst' AS member, sha1(string_agg(text, '|' ORDER BY turn)) AS sha1 FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id || '.out.md.zst', sha1('# ' || conv_id) FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id || '.out.' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 2, '0') || '.md.zst', sha1(text) FROM conversations")
def snk_side_cars(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text)
    filings = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("filing")).agg(turns.alias("fragments"))
    filings = filings.withColumn("raw", F.array_join("fragments", "|")).withColumn("md", F.when(F.col("filing").cast("long") % 2 == 0, F.concat(F.lit("# "), F.col("filing"))))
    return sinks.side_cars(filings, "filing", "raw", "md", "fragments").select("member", F.sha1(codecs.unpack("content")).alias("sha1"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'acc' || l_orderkey || '.' || CASE WHEN l_returnflag = 'A' THEN '10-k' ELSE 'ex99' END || CASE WHEN l_linenumber + l_partkey % 200 < 100 THEN lpad(CAST(l_linenumber + l_partkey % 200 AS VARCHAR), 2, '0') ELSE CAST(l_linenumber + l_partkey % 200 AS VARCHAR) END || '.zst' AS name FROM lineitem")
def snk_document_names(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "10-K/A").otherwise("EX 99.1")
    kind = F.when(F.col("l_returnflag") == "A", kind).otherwise("EX99.1")
    name = sinks.document_name(F.concat(F.lit("acc"), F.col("l_orderkey").cast("string")), kind, F.col("l_linenumber") + F.col("l_partkey") % 200)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"))


@query("SELECT conv_id AS filing, '[' || string_agg('{\"sequence\":' || turn || ',\"type\":\"' || role || '\",\"file_name\":\"f' || turn || '\",\"sha1\":\"' || sha1(text) || '\"}', ',' ORDER BY turn) || ']' AS documents_index FROM conversations GROUP BY conv_id")
def snk_document_index(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("filing"), F.col("turn").alias("sequence"), F.col("role").alias("type"),
        F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_name"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"),
    )
    return sinks.document_index(docs, "filing")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT n_regionkey, n_nationkey + 100, n_name FROM nation")
def snk_append(spark, sf_dir):
    path, rows = shared_folder(spark, "vectors"), table(spark, sf_dir, "nation")
    sinks.write_table(rows, path, "n_regionkey")
    sinks.write_table(rows.withColumn("n_nationkey", F.col("n_nationkey") + 100), path, "n_regionkey")
    return spark.read.parquet(path).select("n_regionkey", "n_nationkey", "n_name")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, url, substr(url, 1, 12) || ', \"x\"' AS quoted FROM pages")
def snk_csv(spark, sf_dir):
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.substring("url", 1, 12), F.lit(', "x"')).alias("quoted"))
    sinks.write_csv(rows, path)
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query("SELECT doc_id, text, n_chars FROM documents")
def snk_json(spark, sf_dir):
    path = shared_folder(spark, "json")
    sinks.write_json(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), path)
    return spark.read.schema("doc_id long, text string, n_chars long").json(path)


@query("SELECT sha1(text) AS sha1, text AS content FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def snk_content_put(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    store = docs.where("doc_id % 3 = 0").select(F.sha1("content").alias("sha1"), "content")
    return merge.content_put(store, docs.where("doc_id % 3 <> 0")).select("sha1", F.decode("content", "UTF-8").alias("content"))


@query("SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT 'root' AS kind, c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'orders', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) GROUP BY kind")
def snk_bundle(spark, sf_dir):
    registry = {"root": "customer", "key": "c_custkey", "related": {"orders": "o_custkey"}}
    known = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    rows = sinks.registered_bundle(registry, known, known["customer"].where("c_nationkey = 3"))
    key = F.coalesce(F.get_json_object("row", "$.o_orderkey"), F.get_json_object("row", "$.c_custkey")).cast("long")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))


@query("SELECT p_partkey, '\\section{' || replace(replace(p_brand, '#', '\\#'), '_', '\\_') || '} 5\\% of \\$' || p_size AS report FROM part")
def snk_latex_report(spark, sf_dir):
    fields = {"brand": F.col("p_brand"), "price": F.concat(F.lit("5% of $"), F.col("p_size").cast("string"))}
    return table(spark, sf_dir, "part").select("p_partkey", sinks.filled_template("\\section{{{brand}}} {{price}}", fields).alias("report"))


@query("SELECT n_nationkey, n_name FROM nation")
def src_column_scan(spark, sf_dir):
    return tables.column(spark, f"{sf_dir}/nation.parquet", "n_nationkey", "n_name")


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def src_sql_frame(spark, sf_dir):
    text = "SELECT n_name, count(*) AS n FROM {nation} JOIN {customer} ON n_nationkey = c_nationkey GROUP BY n_name"
    return tables.sql_frame(spark, text, nation=table(spark, sf_dir, "nation"), customer=table(spark, sf_dir, "customer"))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-000001' AS accession, CASE o_orderkey % 4 WHEN 0 THEN 'a.sgml' WHEN 3 THEN 'c.txt' ELSE 'b.xml' END AS file FROM orders WHERE o_orderkey % 5 <> 0")
def src_ownership_xml(spark, sf_dir):
    """Files of each accession: which holds the form, of those that are there."""
    k = F.col("o_orderkey")
    acc = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-000001"))
    form = F.lit("x <ownershipDocument>1</ownershipDocument>")
    files = F.array(
        F.struct(F.lit(".sgml").alias("n"), F.when((k % 4 == 0) & (k % 5 != 0), form).otherwise("none").alias("c")),
        F.struct(F.lit(".xml").alias("n"), F.when((k % 4 != 3) & (k % 5 != 0), form).otherwise("none").alias("c")),
        F.struct(F.lit(".txt").alias("n"), F.when(k % 5 != 0, form).otherwise("none").alias("c")),
        F.struct(F.lit(".out.md").alias("n"), form.alias("c")),
    )
    rows = table(spark, sf_dir, "orders").select(acc.alias("acc"), F.explode(files).alias("f")).select(F.concat("acc", "f.n").alias("path"), F.col("f.c").alias("content"))
    found = archives.ownership_xml(rows, "path", "content")
    name = F.regexp_extract("path", r"(\.[a-z]+)$", 1)
    return found.select("accession", F.concat(F.when(name == ".sgml", "a").when(name == ".xml", "b").otherwise("c"), name).alias("file"))


