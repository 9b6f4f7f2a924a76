"""Questions and contexts, lemmas, scopes over tables, partitioned JDBC reads."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import lemmas
from quarry.operators import retrieval, scope, search
from quarry.sources import tables


def test_contexts(spark):
    search.define_embedding("three", lambda t: F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abc")))
    chunks = spark.createDataFrame(
        [(1, "f1", "aab", "10-K", "2024"), (2, "f1", "abb", "10-K", None), (3, "f1", "ccc", "8-K", "2023"), (4, "f2", "abc", "4", "2022"), (5, None, "a", "4", "2022"), (6, "f1", "zzz", "4", "1"), (7, "f1", None, "4", "1"), (8, "f1", "aaabbb", "4", "2")],
        "chunk_id long, acc string, content string, form_type string, date_filed string",
    )
    asks = spark.createDataFrame([(10, "f1", "ab", None), (11, "f2", "c", "raw2"), (12, "f3", "a", "r" * 50000), (13, "f4", "a", None), (14, None, "a", "x"), (15, "f1", "q", "raw1")], "question_id long, acc string, question string, raw string")
    hits = retrieval.top_chunks(asks, chunks, 3, scope=["acc"], name="three")
    assert [(r.rank, r.chunk_id) for r in hits.where("question_id = 10").orderBy("rank").collect()] == [(1, 8), (2, 1), (3, 2)]
    got = {r.question_id: (r.context, r.fragments) for r in retrieval.answers_context(asks, chunks, scope=["acc"], k=2, name="three", raw="raw").collect()}
    assert got == {
        10: ("[4 2]: aaabbb\n\n[10-K 2024]: aab", 2), 11: ("[4 2022]: abc", 1), 12: (retrieval.RAW + "r" * 40000, 0), 13: (retrieval.NOTHING, 0), 14: (retrieval.RAW + "x", 0), 15: (retrieval.RAW + "raw1", 0),
    }
    whole = spark.createDataFrame([("f1", "0123456789")], "acc string, body string")
    spans = spark.createDataFrame([("f1", 4, 6), ("f1", 0, 1), ("f9", 0, 1)], "acc string, a int, b int")
    assert sorted((r.window or "") for r in retrieval.expanded(spans, whole, "acc", "body", "a", "b", 2).collect()) == ["", "012", "234567"]


def test_lemmas(spark):
    words = "run runs running ran sit sitting city cities box boxes church churches wolf wolves make making made makes stop stopped stopping thing news is bus class glass bigger big late latest wing ing was feet foot walked walk need needed tie tied".split()
    got = {r.word: r.lemma for r in lemmas.lemma_table(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {
        "runs": "run", "running": "run", "ran": "run", "sitting": "sit", "cities": "city", "boxes": "box", "churches": "church", "wolves": "wolf", "making": "make", "made": "make",
        "makes": "make", "stopped": "stop", "stopping": "stop", "thing": "thing", "news": "news", "is": "be", "bus": "bus", "class": "class", "bigger": "big", "latest": "late",
        "wing": "wing", "was": "be", "feet": "foot", "walked": "walk", "needed": "need", "tied": "tie",
    }
    assert {w: got[w] for w in want} == want and set(got) == set(words)
    docs = spark.createDataFrame([(1, "Runs run running, (RAN) sat."), (2, "the sitting; it sits"), (3, None), (4, ""), (5, "none of it")], "id int, text string")
    counts = {(r.id, r.lemma): r["count"] for r in lemmas.lemma_counts(docs, "id", "text", ["runs", "Running", "sit", "", "absent"]).collect()}
    assert counts == {(1, "run"): 4, (2, "sit"): 2}


def test_scopes(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    df = spark.range(3)
    assert scope.latest(spark, root) == (0, {})
    with scope.scope(spark, root) as s:
        assert s.table("a") is None
        s.put("a", df)
        s.put("b", df)
    with pytest.raises(ZeroDivisionError), scope.scope(spark, root) as s:
        s.put("a", df.limit(1))
        raise ZeroDivisionError
    assert scope.read(spark, root, "a").count() == 3 and scope.latest(spark, root)[0] == 1
    one, two, three = (scope.Scope(spark, root) for _ in range(3))
    one.put("a", df.limit(1))
    two.put("b", two.table("b").limit(2))
    three.put("b", df.unionByName(three.table("a")))
    assert (one.commit(), two.commit()) == (2, 3)  # other tables: both hold
    with pytest.raises(scope.ConflictError):
        three.commit()
    assert [scope.read(spark, root, t).count() for t in "ab"] == [1, 2]
    with scope.scope(spark, root) as s:
        s.table("a")
    assert scope.latest(spark, root)[0] == 3


def test_jdbc_partitions(spark, tmp_path):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"), F.col("id").cast("string").alias("S"))
    rows.write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    got = tables.jdbc_frame(spark, url, "SELECT K, V, S FROM T WHERE K >= 100", key="K", partitions=5, driver=driver)
    assert got.rdd.getNumPartitions() == 5
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sum(sizes) == 900 and max(sizes) < 300
    some = got.where("V > 1500").select("S")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(V,1500)" in plan and "ReadSchema: struct<S:string>" in plan
    assert some.count() == 249
    assert tables.jdbc_frame(spark, url, "SELECT K FROM T", driver=driver).rdd.getNumPartitions() == 1
    assert tables.jdbc_frame(spark, url, "SELECT K FROM T WHERE K < 0", key="K", driver=driver).count() == 0


def test_sections_against_line_by_line(spark):
    from quarry.operators import chunking

    texts = ["a\n# T\n\n b \n### Deep\nx\n## Mid\n# \n#no\n# Z  \nend ", "", None, "## only", "plain\n\n", "### a\nq\n# b\nr\n###### c\ns\n## d\nt", "# T\nbody\n# T\nbody"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in chunking.line_sections(df, "id", "t").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.section, r.content))
    want = {r.id: [(s.section, s.content) for s in r.s] for r in df.select("id", chunking.markdown_sections("t").alias("s")).collect()}
    assert {i: got.get(i, []) for i in range(len(texts))} == want


def test_rows_without_a_key_and_maps(spark):
    from quarry.operators import evaluation, merge

    rows = spark.createDataFrame([(None, {"a": 1}, 1), (None, {"b": 2}, 2), (1, {"a": 1}, 3), (1, {"a": 2}, 3)], "k int, m map<string,int>, v int")
    assert sorted((r.k is None, r.v) for r in merge.one_each(rows, "k").collect()) == [(False, 3), (True, 1), (True, 2)]
    assert merge.one_each(rows, "k", "v").where("k = 1").first().m == {"a": 2}
    assert search.stem("running") == search.stem("run") == "run" and search.stem("sitting") == search.stem("sits")
    words = "a b a c b d a a b".split()
    assert evaluation.common_length(words, "b a a d c a b".split()) == 5 and evaluation.common_length([], words) == 0
    assert evaluation.common_length(["x"] * 3000, ["x"] * 2000) == 2000


def test_quarantine(spark, tmp_path):
    from quarry.streaming import ingest

    root = f"file://{tmp_path}/q"
    attempt = lambda good: lambda d: d.withColumn("ok", F.col("id").isin(good))
    rows = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert {r.id for r in ingest.with_quarantine(rows, root, "ok", attempt([0, 1]), 2).collect()} == {0, 1}
    more = spark.createDataFrame([(9,)], "id int")
    assert {r.id for r in ingest.with_quarantine(more, root, "ok", attempt([2, 9]), 2).collect()} == {2, 9}
    # Two tries were all: 3 and 4 stay in the table, but are not tried again.
    assert ingest.with_quarantine(more.limit(0), root, "ok", attempt([3, 4]), 2).collect() == []
    with pytest.raises(Exception, match="lost"):
        ingest.with_quarantine(more, root, "ok", lambda d: d.withColumn("ok", F.raise_error(F.lit("lost")).cast("boolean")), 2)
    from quarry.operators.merge import current

    assert sorted((r.id, r.tries) for r in current(spark, root).collect()) == [(3, 2), (4, 2)]


def test_ranking_carries_no_texts(spark):
    """pairs that are ranked hold ids; rows that share a key, and equal rows, are told apart."""
    search.define_embedding("two", lambda t: F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "ab")))
    chunks = spark.createDataFrame([(1, "f", "aab"), (1, "f", "abb"), (2, "f", "b"), (3, "f", "a"), (3, "f", "a"), (4, "f", None), (5, "f", "zz")], "chunk_id long, acc string, content string")
    asks = spark.createDataFrame([(9, "f", "a")], "question_id long, acc string, question string")
    hits = retrieval.top_chunks(asks, chunks, 9, scope=["acc"], name="two")
    assert [(r.rank, r.chunk_id, r.content) for r in hits.orderBy("rank").collect()] == [(1, 3, "a"), (2, 3, "a"), (3, 1, "aab"), (4, 1, "abb"), (5, 2, "b")]
    below = hits._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1].splitlines()
    assert "content#" not in next(x for x in below if "Project [" in x)
