"""Relation layer, merges, evaluation, search, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import codecs
from quarry.functions import numbers as N
from quarry.functions import text as T
from quarry.functions import values as V
from quarry.operators import evaluation, merge, relation, search
from quarry.plans import schemas
from quarry.sources import sinks
from quarry.streaming import ingest


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    r = one(
        spark, T.zfill(F.lit("-42"), 5), T.zfill(F.lit("12345678901")), T.strip(F.lit("\t\n a ")), T.count_substring(F.lit("aaaa"), F.lit("aa")),
        N.canonical_number(F.lit("1,234.500")), N.canonical_number(F.lit("10.0")), N.canonical_number(F.lit("abc")), N.to_float(F.lit("x")),
        V.state_code(F.lit("Texas")), T.signer(F.lit("/s/ J Doe")), T.drop_punctuation(F.lit("é, b!")), T.type_slug(F.lit("10-K/A")),
        V.json_block(F.lit('x ```json\n{"a": 1,234}\n``` y')), V.first_present(F.lit(""), F.lit("b")), T.escape_latex(F.lit("a&b_c")),
    )
    assert tuple(r) == ("-0042", "12345678901", "a", 2, "1234.5", "10", "abc", None, "tx", "J Doe", "é b", "10-k", '{"a": 1234}', "b", "a\\&b\\_c")


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "B", 5), (3, "ab", 7)], "id int, name string, n int")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(relation.filtered(df, name__icontains="A")) == [1, 3]
    assert ids(relation.excluded(df, n__gt=6)) == [2]
    assert ids(relation.ordered(df, "-n")) == [1, 3, 2] and ids(relation.ordered(df, "n")) == [2, 3, 1]
    assert relation.get_or_404(df, id=2).name == "B" and relation.exists(df)
    with pytest.raises(LookupError):
        relation.get_or_404(df, id=9)
    with pytest.raises(ValueError):
        relation.filtered(df, name__nope=1)
    with pytest.raises(ValueError):
        relation.values_list(df, "id", "n", flat=True)
    sample = relation.hash_sample(df, "id", 2)
    assert sample.count() == 2 and sample.collect() == relation.hash_sample(df, "id", 2).collect()


def test_merges(spark, tmp_path):
    store = spark.createDataFrame([], "sha1 string, content binary")
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    first = merge.content_put(store, blobs)
    assert first.count() == 2 and merge.content_put(first, blobs).count() == 0
    assert spark.read.parquet(merge.publish(first, str(tmp_path))).count() == 2
    notes = spark.createDataFrame([("q", "a")], "question string, answer string")
    new = spark.createDataFrame([("q", "b"), ("r", "c")], "question string, answer string")
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "_k int, _s_v string, _old int")
    fresh = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "z", 7), (3, "w", 8)], "_k int, _s_v string, _old int")
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(merge.upsert(old, fresh, "_k", ["_s_v"], "_old")) == [(1, "a", 1), (2, "x", 1), (3, "w", 8)]
    assert got(merge.upsert(old, fresh, "_k", ["_s_v"])) == [(1, "a", 1), (2, "y", 1), (3, "z", 7)]
    assert got(merge.insert_ignore(old, fresh, "_k", "_old")) == [(1, "a", 1), (2, "b", 1), (3, "w", 8)]
    root = str(tmp_path / "versions")
    assert merge.current(spark, root) is None
    for rows in (old, fresh):
        merge.switch(spark, root, merge.publish(rows, root))
        assert got(merge.current(spark, root)) == got(rows)
    assert merge.append_unless(notes, new, ["question"]).count() == 2
    assert merge.missing_tables(spark, ["nowhere"]) == ["nowhere"]
    assert all(set(k) <= set(schemas.schema(t).names) for t, k in schemas.KEYS.items())


def test_evaluation(spark):
    def rows(record):
        return evaluation.comparable(evaluation.long_form(spark.createDataFrame([("k", json.dumps(record))], "key string, record string"), "key", "record"))

    truth = rows({"issuer": {"issuer_cik": "7", "issuer_name": "Example Inc."}, "owners": [{"state": "Texas", "price": "1,000.0", "gone": ""}], "a_fn": ["2", "1"]})
    found = rows({"issuer": {"issuer_cik": "0000000007", "issuer_name": "Example"}, "owners": [{"state": "TX", "price": 999}], "a_fn": "[^1][^2]", "more": "x"})
    got = {r.field: (r.tp, r.fp, r.fn) for r in evaluation.scored_fields(truth, found).collect()}
    assert got == {"issuer_cik": (1, 0, 0), "issuer_name": (1, 0, 0), "owners_state": (1, 0, 0), "owners_price": (0, 1, 1), "a_fn": (1, 0, 0), "more": (0, 1, 0)}
    scores = evaluation.with_scores(evaluation.scored_fields(truth, found))
    assert evaluation.report_rows(scores.where("field = 'issuer_cik'")).first().line == "| issuer_cik | 1.000 | 1.000 | 1.000 | 1 |"
    assert evaluation.sections_of(scores, {"issuer": "^issuer", "all": "."}).groupBy("section").count().count() == 2
    scores = one(spark, evaluation.rouge(F.lit("The cats were running"), F.lit("a cat runs")))[0]
    assert (round(scores.rouge1, 4), round(scores.rougeL, 4)) == (0.5714, 0.5714)
    r = one(spark, evaluation.rouge(F.lit("a b c d"), F.lit("a x c d"), False).getField("rougeL"), evaluation.canonical_key(F.lit("issuer_issuer_cik")), evaluation.without_index(F.lit("owners_12_name")))
    assert tuple(r) == (0.75, "issuer_cik", "owners_name")


def test_search(spark):
    docs = spark.createDataFrame([(1, "Rates rose. rates"), (2, "none")], "id int, text string")
    count = lambda **k: {(r.id, r.term): r["count"] for r in search.term_counts(docs, "id", "text", ["rates", "rates", "rise", ""], **k).collect()}
    assert count() == {(1, "rates"): 1} and count(case_sensitive=False) == {(1, "rates"): 2}
    assert count(tokens=True) == {(1, "rates"): 1}
    assert search.stem("insulting") == search.stem("insults") == "insult"
    vectors = docs.withColumn("embedding", search.hashed_embedding("text"))
    query = vectors.where("id = 1").first().embedding
    assert [r.id for r in search.top_k(vectors, query, 1).collect()] == [1]
    ctx = search.prompt_context(docs.withColumns({"form": F.lit("10-K"), "d": F.lit("2024")}), "form", "d", "text", "id").first().context
    assert ctx == "[10-K 2024]: Rates rose. rates\n\n[10-K 2024]: none"


def test_codecs_and_sinks(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "b binary")
    assert bytes(df.select(codecs.unpack(codecs.pack_zstd("b")).alias("x")).first().x) == b"hello"
    assert codecs.uudecode_text("begin 644 f\n%:&5L;&\\ \n`\nend\n") == b"hello"
    assert one(spark, sinks.document_name(F.lit("acc"), F.lit("EX-99.1"), F.lit(3)))[0] == "acc.ex-903.zst"[:4] + "ex-903.zst"
    assert one(spark, sinks.filled_template("{{a}}!", {"a": F.lit("50%")}))[0] == "50\\%!"


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    rows.write.parquet(str(tmp_path / "in/a"))
    more = spark.createDataFrame([(2, "again"), (3, "c"), (3, "d"), (None, "n"), (None, "m")], rows.schema)
    for n, held in (("a", 2), ("b", 4), ("b", 4)):
        if n == "b" and held and not (tmp_path / "in/b").exists():
            more.write.parquet(str(tmp_path / "in/b"))
        stream = ingest.file_stream(spark, str(tmp_path / "in/*"), rows.schema)
        ingest.ingest_new(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp"), by="v").awaitTermination()  # starts anew
        assert spark.read.parquet(str(tmp_path / "out")).count() == held
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "b"), (3, "d"), (None, "n")}
    good, bad = ingest.quarantined(rows.withColumn("ok", F.col("id") == 1), "ok")
    assert good.count() == 1 and bad.first().is_error


def test_retrieval_by_text(spark):
    rows = [(i, f"word{i % 7} word{i % 5} tail") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, content string")
    asks = spark.createDataFrame([(0, "word3 word2 tail"), (1, "word6")], "q long, content string")
    search.define_embedding("again", search.hashed_embedding)
    got = {}
    for r in search.retrieved(chunks, asks, 3, key="id", question="q", name="again").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    embed = lambda d: {r[0]: r.embedding for r in search.embedded(d, "content").collect()}
    vectors, questions = embed(chunks), embed(asks)
    for q, v in questions.items():
        best = sorted(vectors, key=lambda i: (-round(sum(a * b for a, b in zip(v, vectors[i], strict=True)), 6), i))[:3]
        assert [i for _, i in sorted(got[q])] == best


def test_porter_stems():
    from quarry.functions.porter import porter_stem

    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit vietnamization vietnam formality formal hopefulness hope triplicate triplic electrical electr goodness good revival reviv adjustment adjust adoption adopt controlling control rate rate probate probat cease ceas".split()
    assert {w: porter_stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_hooks(spark):
    from quarry.operators import extension

    with pytest.raises(KeyError):
        extension.answers(F.lit("x"), "nobody")
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "id int, t string")
    got = extension.document_data(df, "id", "t", lambda t: {"n": int(t)}, "n int").collect()
    assert sorted((r.id, r.n) for r in got) == [(1, 7), (2, None), (3, None)]
    with pytest.raises(ValueError):
        merge.copy_tables(spark, lambda t: df, "/nowhere", {"a": ["b"], "b": ["a"]})


def test_evaluation_reads_records_once(spark):
    """one file's records are dealt to tasks before they are read, and owners' streets need no second reading."""
    record = {"reporting_owners": [{"street1": " 1 Main St.", "street2": "Floor 2"}, {"street1": "", "street2": "B"}], "a_fn": ["F2", "F1"], "n": "-0.0"}
    df = spark.createDataFrame([("k", json.dumps(record)), (None, '{"n": "1,50"}')], "key string, record string").coalesce(1)
    rows = evaluation.with_streets(evaluation.comparable(evaluation.long_form(df, "key", "record")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("RepartitionByExpression") == 2
    o = "reporting_owners_"
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("k", f"{o}0_street1", "1 main st"), ("k", f"{o}0_street2", "floor 2"), ("k", f"{o}0_street_combined", "1 main st|floor 2"), ("k", f"{o}1_street2", "b"),
        ("k", f"{o}1_street_combined", "b"), ("k", "a_fn", "1|2"), ("k", "n", "0"), (None, "n", "150"),
    ], key=str)


def test_comparable_is_compiled(spark):
    """no method of the step's code is over 8,000 bytes, from where on the JVM interprets it; field names come out as by plain expressions."""
    names = ["issuer_issuer_cik", "a_b_a_b", "abc_c", "abc_c1", "a__a", "_", "x_1_x", "owner_rptowner_name", "derivative_transactions_0_price_price", "derivative_transactions_1_shares", "n_fn"]
    df = spark.createDataFrame([(n, n, "New  York." if n == "_" else " 1,50 ") for n in names] + [("s", "owner_state", " Texas "), ("t", "owner_state", "zz!")], "key string, field string, value string").coalesce(1)
    rows = evaluation.comparable(df)
    asked = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "true"}
    were, sizes = {k: spark.conf.get(k) for k in asked}, []
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        stages = evaluation.comparable(df)._jdf.queryExecution().debug().codegenToSeq().iterator()
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) < 8000
    found = {r.key: (r.field, r.value) for r in rows.collect()}
    plain = {r.field: r.k for r in df.select("field", F.regexp_replace(evaluation._spelled_out(evaluation._first_repeats(F.col("field"))), r"([a-z_]+?)_\1(?=_|$)", "$1").alias("k")).collect()}
    assert {n: found[n][0] for n in names} == {n: plain[n] for n in names}
    assert plain["issuer_issuer_cik"] == "issuer_cik" and plain["abc_c"] == "abc" and plain["abc_c1"] == "abc_c1"
    assert found["_"][1] == "new york" and found["abc_c"][1] == "150" and found["s"][1] == "tx" and found["t"][1] == "zz"
