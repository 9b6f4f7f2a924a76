"""The engine's registered queries over the shared test tables.

Each entry pairs a DataFrame plan with SQL of the same meaning; the SQL is
what a second engine runs on the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import values as V
from ..operators import chunking, dedup, evaluation, joins, merge, nested, relation, search, terms

Query = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under its function's name, with its SQL."""

    def put(fn: Query) -> Query:
        PLANS[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS = ["the", "tion", "and", "der", "est", "été"]
TERM_ROWS = "(VALUES ('the'), ('tion'), ('and'), ('der'), ('est'), ('été')) t(term)"
RAW_COUNT = "(length(text) - length(replace(text, term, ''))) // length(term)"


# Filters ------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%' AND o_totalprice > 1000 AND o_totalprice <= 300000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IS NOT NULL AND lower(o_orderpriority) = '1-urgent'")
def flt_lookup_dsl(spark, sf_dir):
    return relation.filtered(
        table(spark, sf_dir, "orders"), o_orderstatus__in=["F", "O"], o_orderpriority__startswith="1", o_totalprice__gt=1000,
        o_totalprice__lte=300000, o_orderdate__gte="1996-01-01", o_custkey__isnull=False, o_orderpriority__iexact="1-urgent",
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_type LIKE '%Y' AND p_size >= 3 AND p_size < 40 AND p_brand = 'Brand#2' OR false")
def flt_lookup_text(spark, sf_dir):
    return relation.filtered(
        table(spark, sf_dir, "part"), p_name__contains="ring", p_type__endswith="Y", p_size__gte=3, p_size__lt=40, p_brand="Brand#2"
    ).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING') AND NOT (c_acctbal < 0) AND NOT (c_nationkey IN (1, 2, 3))")
def flt_exclude_dsl(spark, sf_dir):
    kept = relation.excluded(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_acctbal__lt=0, c_nationkey__in=[1, 2, 3])
    return kept.select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def flt_icontains(spark, sf_dir):
    return relation.filtered(table(spark, sf_dir, "part"), p_name__icontains="RING").select("p_partkey", "p_name")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders WHERE year(o_orderdate) = 1997 AND quarter(o_orderdate) = 2")
def flt_year_quarter(spark, sf_dir):
    kept = relation.filtered(table(spark, sf_dir, "orders"), o_orderdate__year=1997, o_orderdate__quarter=2)
    return kept.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def flt_date_range(spark, sf_dir):
    return relation.filtered(table(spark, sf_dir, "orders"), o_orderdate__range=("1996-01-01", "1997-12-31")).select("o_orderkey")


@query("SELECT o_orderkey, upper(trim(o_orderpriority)) AS priority FROM orders WHERE upper(trim(o_orderpriority)) IN ('1-URGENT', '5-LOW')")
def flt_norm_membership(spark, sf_dir):
    p = F.upper(T.strip("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("priority")).where(F.col("priority").isin("1-URGENT", "5-LOW"))


NULLED = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN ' N/A ' ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, s FROM (SELECT o_orderkey, {NULLED} AS s FROM orders) WHERE s IS NULL OR lower(trim(s)) IN ('', 'none', 'null', 'n/a', 'na')")
def flt_nullish(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(NULLED).alias("s"))
    return rows.where(V.is_nullish("s"))


@query("SELECT page_id FROM pages WHERE html IS NULL OR length(html) = 0 OR length(html) = 2139 OR contains(html, 'track(')")
def flt_poison_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(relation.is_poison("html", ["track("])).select("page_id")


@query("SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS v FROM part) WHERE regexp_full_match(replace(v, ',', ''), '[-+]?[0-9]+([.][0-9]+)?')")
def flt_numeric_like(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).where(N.is_numeric_like("v"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 50")
def flt_support_threshold(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).where("n > 50")


# Projections and scalar functions ------------------------------------------


@query("SELECT o_orderkey, 'data/' || strftime(o_orderdate, '%Y') || '/QTR' || quarter(o_orderdate) || '/' || strftime(o_orderdate, '%m') || '/' || strftime(o_orderdate, '%d') || '/' || o_orderkey || '.sgml.zst' AS path FROM orders")
def prj_path_from_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.dated_path("o_orderdate", F.col("o_orderkey").cast("string")).alias("path"))


@query("SELECT o_orderkey, CASE WHEN m = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'kept' ELSE 'data/' || y || '/QTR' || q || '/' || lpad(CAST(m AS VARCHAR), 2, '0') || '/' || lpad(CAST(d AS VARCHAR), 2, '0') || '/' || o_orderkey || '.md.zst' END AS path FROM (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 7 = 0 THEN 0 ELSE month(o_orderdate) END AS m, day(o_orderdate) AS d FROM orders)")
def prj_resolved_path(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.dayofmonth("o_orderdate").alias("d"),
        F.when((k % 4 != 0) & (k % 7 == 0), 0).otherwise(F.month("o_orderdate")).alias("m"), F.when(k % 4 == 0, "kept").otherwise("").alias("stored"),
    )
    return rows.select("o_orderkey", D.resolved_path("stored", "y", "q", "m", "d", k.cast("string")).alias("path"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'FY ' || year(o_orderdate) ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS label, 'QTR' || quarter(o_orderdate) AS qtr FROM orders")
def prj_period_label(spark, sf_dir):
    form = F.when(F.col("o_orderpriority").like("1%"), "10-K").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.period_label(form, "o_orderdate").alias("label"), D.quarter_name(F.month("o_orderdate")).alias("qtr")
    )


@query("SELECT page_id, replace(list_extract(string_split(url, '/'), -1), '.txt', '') AS accession, replace(list_extract(string_split(url, '/'), -1), '-', '') AS plain, 'https://host/root/' || regexp_replace(url, '^/+', '') AS full_url FROM pages")
def prj_accession_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.accession_of("url").alias("accession"), T.no_dashes(F.element_at(F.split("url", "/"), -1)).alias("plain"),
        T.join_url(F.lit("https://host/root/"), "url").alias("full_url"),
    )


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS cik, c_name || ' (' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END || ')' AS shown FROM customer")
def prj_zfill_id(spark, sf_dir):
    ticker = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.zfill("c_custkey", 3).alias("cik"), T.display_name("c_name", ticker, "c_custkey").alias("shown")
    )


@query("SELECT l_orderkey || '_' || l_linenumber AS id, coalesce(CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END, -1.0) AS tax FROM lineitem")
def prj_surrogate_and_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return rows.na.fill({"tax": -1.0})


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') AS canonical, CAST(p_retailprice AS DOUBLE) AS number FROM part")
def fn_norm_number(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", price.alias("price"), N.canonical_number(price).alias("canonical"), N.to_float(F.concat(F.lit(" "), price, F.lit(" "))).alias("number")
    )


@query("SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS BIGINT), -1) AS n FROM lineitem")
def fn_to_int(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise(F.format_string(" %d", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(N.to_int(raw), F.lit(-1).cast("long")).alias("n"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ny' WHEN 1 THEN 'tx' WHEN 2 THEN 'zz' ELSE 'dc' END AS code FROM nation")
def fn_state_map(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "New York").when(k == 1, " TEXAS").when(k == 2, "ZZ").otherwise("District of Columbia")
    return table(spark, sf_dir, "nation").select("n_nationkey", V.state_code(name).alias("code"))


@query("SELECT doc_id, lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS plain, length(text) AS chars FROM documents")
def fn_text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(T.collapse("text")).alias("plain"), F.length("text").cast("long").alias("chars"))


@query("SELECT sha1(text) AS sha1, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def fn_sha1_cas_dedup(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("sha1"), "doc_id")
    return keyed.groupBy("sha1").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_explode(spark, sf_dir):
    maps = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("name", "k"))
    return maps.where("name = 'k'").select("event_id", "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-05' WHEN o_orderkey % 3 = 1 THEN NULL ELSE '2023-12-31' END AS strict, CASE WHEN o_orderkey % 3 = 2 THEN '2023-12-31' WHEN o_orderkey % 3 = 0 THEN '2024-01-05' END AS lenient FROM orders")
def fn_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, " 2024-01-05 ").when(k == 1, "2024-1-5").otherwise("20231231")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.strict_date(raw).cast("string").alias("strict"), D.lenient_date(raw).cast("string").alias("lenient"))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS flag, CASE WHEN o_orderkey % 2 = 0 THEN '1,3' ELSE '2' END AS refs, CASE WHEN o_orderkey % 2 = 0 THEN 'a, c' ELSE 'c' END AS parts FROM orders")
def fn_flags_and_refs(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = F.when(k % 4 == 0, " TRUE").when(k % 4 == 1, "y").otherwise("0")
    refs = F.when(k % 2 == 0, '["F1", "F3", "F1"]').otherwise("F2, ")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", V.xml_bool(flag).alias("flag"), F.array_join(V.footnote_refs(refs), ",").alias("refs"),
        V.joined(F.when(k % 2 == 0, "a"), F.lit(""), F.lit("c")).alias("parts"),
    )


# Joins ----------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 45 ORDER BY o_orderdate, c_name")
def join_search_export(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return relation.ordered(rows, "o_orderdate", "c_name").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate")
def join_two_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey AND l_shipdate = o_orderdate")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_select_related(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_prefetch_nest(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = joins.nested(table(spark, sf_dir, "orders").select("o_orderkey"), kids, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    line = F.transform("children", lambda r: F.concat_ws(":", r.l_linenumber, r.l_partkey, r.l_suppkey))
    return rows.select("o_orderkey", F.array_join(line, ",").alias("lines"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def join_semi_watchlist(spark, sf_dir):
    watch = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    rows = joins.in_rows(table(spark, sf_dir, "orders"), watch, "o_custkey", "c_custkey")
    return relation.ordered(rows, "-o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_unloaded(spark, sf_dir):
    return joins.not_in_rows(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000 OR l_quantity >= 50")
def join_span_or(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), table(spark, sf_dir, "lineitem")
    rows = joins.related(orders, lines, F.expr("o_orderkey = l_orderkey"), F.expr("o_totalprice > 300000"), F.expr("l_quantity >= 50"))
    return rows.select("o_orderkey", "o_orderstatus")


@query("SELECT a.conv_id, a.n - 1 AS pos, a.text AS a, b.text AS b FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') a JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.n = b.n")
def join_positional_zip(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r.text).alias("items")
    sides = [conv.where(F.col("role") == r).groupBy("conv_id").agg(rows) for r in ("user", "assistant")]
    zipped = joins.zipped(*sides, "conv_id", "items")
    return zipped.select("conv_id", F.col("pos").cast("long"), "a", "b")


@query(f"SELECT doc_id, term, {RAW_COUNT} AS count FROM documents, {TERM_ROWS}")
def join_doc_terms_cross(spark, sf_dir):
    return terms.substring_counts(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), TERMS, every=True)


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(CAST(a.toxic AS VARCHAR), '__NULL__') AS truth, coalesce(b.lang, '__NULL__') AS found FROM labels a FULL JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def join_full_match(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("value"))
    found = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("value"))
    return joins.matched_values(truth, found, ["doc_id"])


@query("SELECT c_custkey, max_order FROM (SELECT c_custkey, o_orderkey AS max_order, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n = 1")
def join_latest_of_each(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    best = orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey")).alias("max_order"))
    return table(spark, sf_dir, "customer").join(best, F.expr("c_custkey = o_custkey")).select("c_custkey", "max_order")


# Aggregations ---------------------------------------------------------------


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC")
def agg_count_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def agg_latest(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate")
    )


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def agg_distinct_values(spark, sf_dir):
    return relation.values(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").distinct()


@query("SELECT count(*) AS total, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (toxic = 1) AS toxic FROM labels")
def agg_bad_good_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(
        F.count("*").alias("total"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def agg_last_write_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def agg_set_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query("SELECT field, total, filled, round(filled * 100.0 / total, 4) AS percent FROM (SELECT count(*) AS total, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS a, count(o_custkey) AS b FROM orders), LATERAL (VALUES ('a', a), ('b', b)) t(field, filled)")
def aud_field_population(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 1 END").alias("a"), F.col("o_custkey").alias("b"))
    return evaluation.field_population(rows)


@query("SELECT doc_id, CASE WHEN w = '' THEN 'n/a' WHEN contains(lower(text), lower(w)) THEN 'pass' ELSE 'fail' END AS found FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'THE' ELSE source END AS w FROM documents)")
def aud_value_in_text(spark, sf_dir):
    k = F.col("doc_id") % 3
    w = F.when(k == 0, "").when(k == 1, "THE").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.value_in_text(w, "text").alias("found"))


# Order-aware de-duplication --------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def win_keep_last(spark, sf_dir):
    return dedup.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def win_keep_first(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS sequence_key FROM lineitem")
def win_sequence_key(spark, sf_dir):
    return dedup.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "sequence_key")


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS n FROM documents) WHERE n = 1")
def win_prefer_source(spark, sf_dir):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return dedup.preferred(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], rank, "doc_id")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def win_compare_previous(spark, sf_dir):
    return dedup.compared(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous")


# Sorts, limits, samples -------------------------------------------------------


@query("SELECT s_suppkey, coalesce(n, -1) AS n, s_acctbal FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS n, s_acctbal FROM supplier) u ORDER BY u.n DESC NULLS FIRST, s_acctbal ASC NULLS LAST LIMIT 25")
def srt_multi_dir_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("n"), "s_acctbal")
    return relation.ordered(rows, "-n", "s_acctbal").limit(25).withColumn("n", F.coalesce("n", F.lit(-1)))


@query("SELECT * FROM customer ORDER BY md5(c_custkey || '|3836'), c_custkey LIMIT 100")
def srt_hash_sample(spark, sf_dir):
    return relation.hash_sample(table(spark, sf_dir, "customer"), "c_custkey", 100)


# Sets --------------------------------------------------------------------------


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) UNION (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer)")
def set_symdiff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def set_concat(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


def _nations(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a, table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))


@query("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
def set_union_distinct(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500")
def set_intersect(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    a, b = _nations(spark, sf_dir)
    return b.subtract(a)


# Write semantics -----------------------------------------------------------------


def _halves(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = rows.where("c_custkey % 3 <> 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return rows.where("c_custkey % 2 = 0"), changed


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name || '*' ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def dml_upsert_update_cols(spark, sf_dir):
    return merge.upsert(*_halves(spark, sf_dir), "c_custkey", ["c_name"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '*' END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def dml_insert_ignore(spark, sf_dir):
    return merge.insert_ignore(*_halves(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, 0) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def dml_get_or_create(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    return merge.get_or_create(target, source, "c_custkey", {"c_name": "new", "c_acctbal": 0.0})


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, l_partkey, 0.0 FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber = 1 UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def dml_replace_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    new = lines.where("l_orderkey % 2 = 0 AND l_linenumber = 1").select("l_orderkey", "l_partkey", F.lit(0.0).alias("l_quantity"))
    return merge.replace_children(lines.select("l_orderkey", "l_partkey", "l_quantity"), new, "l_orderkey")


@query("SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0")
def dml_changed_rows(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    return merge.changed(target, source, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_update_where(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    keys = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0")
    return merge.update_where(rows, keys, "o_orderkey", o_orderstatus="X")


# Text ------------------------------------------------------------------------------


@query("SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS content FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS i) WHERE length(trim(text)) > 0")
def txt_fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


_CUT = "CASE WHEN {0} + 1500 >= length(text) THEN length(text) WHEN contains(substr(text, {0} + 1, 1500), chr(10)) AND 1500 - strpos(reverse(substr(text, {0} + 1, 1500)), chr(10)) > 750 THEN {0} + 1501 - strpos(reverse(substr(text, {0} + 1, 1500)), chr(10)) ELSE {0} + 1500 END"


#: No line of a document begins with a heading's signs, so cuts are at line breaks or hard.
@query(
    f"WITH RECURSIVE c AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST({_CUT.format('0')} AS BIGINT) AS e FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, text, i + 1, e, CAST({_CUT.format('e')} AS BIGINT) FROM c WHERE e < length(text)) "
    "SELECT doc_id || '_' || s || '_' || i AS id, doc_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN e = length(text) THEN substr(text, s + 1, e - s) ELSE trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS content, s AS start_pos, e AS end_pos FROM c"
)
def txt_heading_chunks(spark, sf_dir):
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 1500, 3)


@query()
def txt_sections(spark, sf_dir):
    from ..parsers.html import html_markdown

    pages = table(spark, sf_dir, "pages").select("page_id", html_markdown("html").alias("md"))
    return pages.select("page_id", F.inline(chunking.markdown_sections("md")))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def txt_reconstruct(spark, sf_dir):
    return chunking.rebuilt(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id, substr(text, CAST(greatest(300 - 200, 0) + 1 AS BIGINT), 600) AS window FROM documents")
def txt_context_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.context_window(F.col("text"), F.lit(300), F.lit(500), 200).alias("window"))


@query(
    "SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<head>.*?</head>', '', 's'), '<[^>]*>'), lambda x: "
    "trim(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''), ' ') AS text FROM pages"
)
def txt_html_text(spark, sf_dir):
    from ..parsers.html import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def txt_html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def src_html_links(spark, sf_dir):
    from ..sources.listing import links

    return table(spark, sf_dir, "pages").select("page_id", F.explode(links("html")).alias("href"))


# Search ------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count, quality FROM (SELECT doc_id, term, {RAW_COUNT} AS count FROM documents, {TERM_ROWS}) JOIN labels USING (doc_id) WHERE count > 0")
def sea_term_counts(spark, sf_dir):
    counts = search.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return counts.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "term", "count", "quality")


@query(f"SELECT doc_id, term, len(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x = term)) AS count FROM documents, {TERM_ROWS} WHERE len(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x = term)) > 0")
def sea_token_counts(spark, sf_dir):
    return search.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS, case_sensitive=False, tokens=True)


#: The rules of ``search.stem`` on a word in lower case: one ending, a doubled letter, a final e.
_ENDING = "CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ies' AND length(w) >= 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%edly' AND length(w) >= 7 THEN left(w, length(w) - 4) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%ly' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 4 AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"
_SINGLE = "CASE WHEN length(e) > 3 AND right(e, 1) = left(right(e, 2), 1) AND NOT regexp_matches(e, '[lsz]$') THEN left(e, length(e) - 1) ELSE e END"


@query(
    f"WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\r\n]+')) AS w FROM documents), s AS (SELECT doc_id, {_SINGLE} AS d FROM (SELECT doc_id, {_ENDING} AS e FROM t)), "
    "f AS (SELECT doc_id, CASE WHEN length(d) > 4 AND d LIKE '%e' THEN left(d, length(d) - 1) ELSE d END AS stem FROM s) "
    "SELECT doc_id, term, count(*) AS count FROM f JOIN (VALUES ('insulting', 'insult'), ('losers', 'loser'), ('tions', 'tion')) v(term, stem) USING (stem) GROUP BY doc_id, term"
)
def sea_stem_counts(spark, sf_dir):
    return search.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["insulting", "losers", "tions"], stemmed=True)


PROBE = [((i * 37) % 19 - 9) / 10 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}) DESC, vec_id LIMIT 10")
def vec_topk(spark, sf_dir):
    found = search.top_k(table(spark, sf_dir, "embeddings"), PROBE, 10, key="vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}), 6) AS similarity FROM embeddings WHERE label IN (1, 2) ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {PROBE_SQL}) DESC, vec_id LIMIT 5")
def vec_topk_filtered(spark, sf_dir):
    found = search.top_k(table(spark, sf_dir, "embeddings"), PROBE, 5, key="vec_id", where=F.col("label").isin(1, 2))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


EACH = "SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0{})) WHERE n <= {}"


@query(EACH.format("", 10))
def vec_topk_each(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = search.nearest(rows, rows.where("vec_id % 50 = 0"), 10, key="vec_id")
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(EACH.format(" AND e.label IN (1, 2)", 5))
def vec_topk_filtered_each(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = search.nearest(rows.where(F.col("label").isin(1, 2)), rows.where("vec_id % 50 = 0"), 5, key="vec_id")
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_pairwise_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").agg(F.round(F.avg(search.cosine(F.col("embedding"), F.col("other"))), 6).alias("mean_cosine"))


# Evaluation ----------------------------------------------------------------------------


def _verdicts(spark, sf_dir):
    """Labels against a rule on the texts, by language."""
    rule = F.when(F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("moron")), "1").otherwise("0")
    found = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", "lang", rule.alias("value"))
    truth = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("toxic").cast("string").alias("value"))
    return joins.matched_values(truth, found, ["doc_id", "lang"])


BOTH = "(SELECT lang, coalesce(CAST(t.toxic AS VARCHAR), '__NULL__') AS truth, coalesce(f.value, '__NULL__') AS found FROM documents LEFT JOIN labels t USING (doc_id) LEFT JOIN (SELECT doc_id, CASE WHEN contains(text, 'idiot') OR contains(text, 'moron') THEN '1' ELSE '0' END AS value FROM documents WHERE doc_id % 7 <> 0) f USING (doc_id) WHERE t.toxic IS NOT NULL OR f.value IS NOT NULL)"
HITS = "count(*) FILTER (truth = found) AS tp, count(*) FILTER (found <> '__NULL__' AND truth <> found) AS fp, count(*) FILTER (truth <> '__NULL__' AND truth <> found) AS fn"
SCORES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support"


@query(f"SELECT lang, {HITS} FROM {BOTH} GROUP BY lang")
def eva_tp_fp_fn(spark, sf_dir):
    return evaluation.match_counts(_verdicts(spark, sf_dir), "lang")


@query(f"SELECT lang, tp, fp, fn, {SCORES} FROM (SELECT lang, {HITS} FROM {BOTH} GROUP BY lang)")
def eva_scores(spark, sf_dir):
    return evaluation.with_scores(evaluation.match_counts(_verdicts(spark, sf_dir), "lang"))


@query(f"SELECT grp, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS grp, {SCORES} FROM (SELECT lang, {HITS} FROM {BOTH} GROUP BY lang)) WHERE support > 0 GROUP BY grp")
def eva_weighted_rollup(spark, sf_dir):
    scores = evaluation.with_scores(evaluation.match_counts(_verdicts(spark, sf_dir), "lang"))
    return evaluation.weighted_rollup(scores.withColumn("grp", F.when(F.col("lang") == "en", "en").otherwise("other")), "grp")


@query(f"SELECT lang, tp, fp, fn, {SCORES} FROM (SELECT coalesce(lang, 'overall') AS lang, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT lang, {HITS} FROM {BOTH} GROUP BY lang) GROUP BY ROLLUP (lang))")
def eva_micro_rollup(spark, sf_dir):
    return evaluation.micro_rollup(evaluation.match_counts(_verdicts(spark, sf_dir), "lang"), "lang")


@query(f"SELECT round(avg(f1), 6) AS macro_f1, count(*) AS fields FROM (SELECT {SCORES} FROM (SELECT lang, {HITS} FROM {BOTH} GROUP BY lang)) WHERE support > 0")
def eva_macro(spark, sf_dir):
    return evaluation.macro_mean(evaluation.with_scores(evaluation.match_counts(_verdicts(spark, sf_dir), "lang")))


def _turn_pairs(spark, sf_dir):
    """Each turn beside the next of its conversation."""
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return conv.select("conv_id", "turn", "text").join(nxt, ["conv_id", "turn"])


PAIRS = "(SELECT a.conv_id, a.turn, a.text, b.text AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
ROUGE_WORDS = "SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower({}), '[a-z0-9]+')) AS w FROM " + PAIRS + ") GROUP BY ALL"


@query(f"WITH a AS ({ROUGE_WORDS.format('text')}), b AS ({ROUGE_WORDS.format('other')}), s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL), na AS (SELECT conv_id, turn, sum(n) AS n FROM a GROUP BY ALL), nb AS (SELECT conv_id, turn, sum(n) AS n FROM b GROUP BY ALL) SELECT p.conv_id, p.turn, round(coalesce(2.0 * coalesce(shared, 0) / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0), 0), 0), 6) AS rouge FROM {PAIRS} p LEFT JOIN s USING (conv_id, turn) LEFT JOIN na USING (conv_id, turn) LEFT JOIN nb USING (conv_id, turn)")
def eva_rouge1(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.rouge("text", "other", stemmed=False).getField("rouge1"), 6).alias("rouge"))


@query()
def eva_rouge_stemmed(spark, sf_dir):
    scored = _turn_pairs(spark, sf_dir).select("conv_id", "turn", evaluation.rouge("text", "other").alias("r"))
    return scored.select("conv_id", "turn", F.round("r.rouge1", 6).alias("rouge1"), F.round("r.rougeL", 6).alias("rougeL"))


@query("SELECT key, field, truth, found FROM (SELECT conv_id AS key, 'turns_' || n || '_' || f AS field, CASE f WHEN 'turn' THEN CAST(turn AS VARCHAR) WHEN 'role' THEN role ELSE lower(trim(text)) END AS truth, CASE WHEN turn % 5 = 4 THEN '__NULL__' WHEN f = 'turn' THEN CAST(turn AS VARCHAR) WHEN f = 'role' THEN CASE WHEN turn % 3 = 0 THEN 'x' ELSE role END ELSE lower(trim(text)) END AS found FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations), (VALUES ('turn'), ('role'), ('text')) t(f))")
def eva_flatten_match(spark, sf_dir):
    """Nested records of both sides flattened and matched, field by field."""
    conv = table(spark, sf_dir, "conversations")
    one = F.struct("turn", "role", "text")
    other = F.when(F.col("turn") % 5 == 4, "{}").otherwise(F.to_json(F.struct("turn", F.when(F.col("turn") % 3 == 0, "x").otherwise(F.col("role")).alias("role"), "text")))

    def side(item):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("j")))), lambda r: r.j)
        return conv.groupBy(F.col("conv_id").alias("key")).agg(F.concat(F.lit('{"turns": ['), F.array_join(parts, ","), F.lit("]}")).alias("record"))

    truth, found = (evaluation.long_form(side(x), "key", "record") for x in (F.to_json(one), other))
    return joins.matched_values(truth, found, ["key", "field"])


# Nested records and batch reports ----------------------------------------------------------


@query("SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_shipdate, l_quantity, l_partkey), '') AS parts, coalesce(string_agg(CASE WHEN n <= 2 THEN CAST(l_partkey AS VARCHAR) END, ',' ORDER BY l_shipdate, l_quantity, l_partkey), '') AS first_two FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_partkey) AS n FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def srt_canonical_lists(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    rows = joins.nested(table(spark, sf_dir, "orders").select("o_orderkey"), kids, "o_orderkey", "l_orderkey", ["l_partkey"])
    listed = rows.select("o_orderkey", nested.sorted_list("children", "l_shipdate", "l_quantity", "l_partkey").alias("c"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.l_partkey.cast("string")), ",")
    return listed.select("o_orderkey", ids(F.col("c")).alias("parts"), ids(nested.first_items("c", 2)).alias("first_two"))


@query("SELECT 'lines' AS list, count(*) FILTER (n > 0) AS records, CAST(sum(n) AS BIGINT) AS items FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def agg_list_support(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = joins.nested(table(spark, sf_dir, "orders").select("o_orderkey"), kids, "o_orderkey", "l_orderkey", ["l_partkey"], "lines")
    return nested.list_support(rows, "o_orderkey", ["lines"])


@query("SELECT event_type, count(*) FILTER (value >= 10) AS succeeded, count(*) FILTER (NOT value >= 10) AS failed FROM events GROUP BY event_type")
def agg_tallies(spark, sf_dir):
    return nested.tallies(table(spark, sf_dir, "events"), F.col("value") >= 10, "event_type")


@query("SELECT folder, string_agg(page_id || ':' || kb, ',' ORDER BY page_id) AS files FROM (SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS folder, length(html) // 1024 AS kb FROM pages) GROUP BY folder")
def agg_group_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "/[^/]*$", "").alias("folder"), F.floor(F.length("html") / 1024).alias("kb"))
    files = F.array_sort(F.collect_list(F.struct("page_id", "kb")))
    return pages.groupBy("folder").agg(F.array_join(F.transform(files, lambda f: F.concat_ws(":", f.page_id, f.kb)), ",").alias("files"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 ELSE 1 END, turn) - 1 AS chunk_index FROM conversations")
def win_chunk_index(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("rank", F.when(F.col("role") == "system", 0).otherwise(1))
    return dedup.numbered(rows, ["conv_id"], ["rank", "turn"], "chunk_index", 0).select("conv_id", "turn", "chunk_index")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Item 1A' WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'Item 7' ELSE 'Item 2' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'Item 3' ELSE 'Item 1' END END AS item FROM orders")
def prj_section_key(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "risk").when(k == 1, "mda").otherwise("legal")
    form = F.when(F.col("o_orderstatus") == "F", "10-K/A").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select("o_orderkey", nested.section_key(kind, form).alias("item"))


@query("SELECT CASE WHEN c_custkey % 2 = 1 THEN 'new' ELSE 'updated' END AS outcome, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def dml_sync_counts(spark, sf_dir):
    target, source = _halves(spark, sf_dir)
    return merge.sync_counts(target, source, "c_custkey")


@query("SELECT page_id, true AS is_error, false AS is_processed, 'poison' AS reason FROM pages WHERE contains(html, 'track(1')")
def dml_error_rows(spark, sf_dir):
    bad = table(spark, sf_dir, "pages").where(F.contains("html", F.lit("track(1")))
    return nested.error_rows(bad, "page_id", "poison")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a-' || n_regionkey ELSE '' END AS notes FROM nation")
def join_note_lookup(spark, sf_dir):
    table_of = F.create_map(F.lit("1"), F.concat(F.lit("a-"), F.col("n_regionkey").cast("string")))
    ids = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("1"), F.lit("9"))).otherwise(F.array(F.lit("9")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(joins.looked_up(ids, table_of), "; ").alias("notes"))


@query("SELECT conv_id, string_agg('[' || role || ' ' || turn || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def rag_context_each(spark, sf_dir):
    return search.prompt_context(table(spark, sf_dir, "conversations"), "role", "turn", "text", "turn", by=["conv_id"])


@query("SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') AS price, lower(p_type) AS kind FROM part")
def eva_parity_values(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(18,4)").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", evaluation.parity_value(F.lit("price"), price).alias("price"), evaluation.parity_value(F.lit("title"), "p_type").alias("kind")
    )


TF = "SELECT conv_id, turn, w, sum(x) AS x, sum(y) AS y FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS w, 1 AS x, 0 AS y FROM " + PAIRS + " UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(other), '[\\p{L}\\p{N}_]{2,}')), 0, 1 FROM " + PAIRS + ") GROUP BY ALL"


@query(f"WITH tf AS ({TF}), v AS (SELECT conv_id, turn, x * (CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END) AS x, y * (CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END) AS y FROM tf), c AS (SELECT conv_id, turn, sum(x * y) / sqrt(nullif(sum(x * x) * sum(y * y), 0)) AS c FROM v GROUP BY ALL) SELECT conv_id, turn, round(coalesce(c, 0), 6) AS cosine FROM {PAIRS} LEFT JOIN c USING (conv_id, turn)")
def vec_tfidf_cosine(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return search.tfidf_cosine(pairs, "key", "text", "other").select("key.*", F.round("cosine", 6).alias("cosine"))


@query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 10")
def vec_ann_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = search.nearest(rows, rows.where("vec_id % 50 = 0"), 10, key="vec_id", metric="euclid")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT event_id, '## EVENT DATA' || CASE WHEN user_id <> 0 THEN chr(10) || '* **USER ID:** ' || user_id ELSE '' END || chr(10) || '* **EVENT TYPE:** ' || event_type || CASE WHEN value <> 0 THEN chr(10) || '* **VALUE:** ' || value ELSE '' END AS markdown FROM events")
def fn_metadata_markdown(spark, sf_dir):
    record = F.to_json(F.struct(F.struct("user_id", "event_type").alias("event-data"), "value"))
    return table(spark, sf_dir, "events").select("event_id", nested.metadata_markdown(record).alias("markdown"))


# Extensions: windows over the event table ---------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return hours.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
