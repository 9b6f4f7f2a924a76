"""The vector index against brute force, terms against replace, archives that are
written, aborted, streamed and read once, table functions."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, terms, vector_index
from quarry.parsers import table_functions
from quarry.sources import archive_format, sinks


def nearest(rows, k, metric, itself=False, among=None):
    out = {}
    for q, x in rows:
        cost = []
        for i, y in rows:
            if (itself or i != q) and (among is None or among(i)):
                x_, y_ = np.array(x, float), np.array(y, float)
                d = -(x_ @ y_) / (np.sqrt(x_ @ x_) * np.sqrt(y_ @ y_)) if metric == "cosine" else float(np.sqrt(((x_ - y_) ** 2).sum()))
                cost.append((d, i))
        out[q] = sorted(cost)[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_index_against_all_pairs(spark, tmp_path, metric):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)] + [(200 + i, [1.0, 2.0, 0.0, 0.5, 0.0, -1.0]) for i in range(80)]  # copies
    odd = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, (i or 0) % 3, "x") for i, v in rows + odd], "id long, embedding array<double>, kind int, low string").repartition(4)
    index = vector_index.build(df, f"file://{tmp_path}/index", metric=metric, carry=("kind",), lists=9)
    assert index.rows.sum() == len(rows) and 1 <= index.probes <= len(index.rows) <= 9
    again = vector_index.opened(spark, index.folder)
    assert np.array_equal(again.centroids, index.centroids) and again.probes == index.probes

    def got(**how):
        out = {}
        for r in vector_index.probe(again, df, 4, **how).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.id, r["similarity" if metric == "cosine" else "distance"]))
        return {q: [(round(v, 9), i) for _, i, v in sorted(x)] for q, x in out.items() if q is not None}

    def want(**how):
        sign = -1 if metric == "cosine" else 1
        return {q: [(round(sign * d, 9), i) for d, i in x] for q, x in nearest(rows, 4, metric, **how).items()}

    assert {q: [i for _, i in x] for q, x in got(exact=True).items()} == {q: [i for _, i in x] for q, x in want().items()}
    assert [x[0][0] for x in got(exact=True, itself=True).values()] == pytest.approx([1.0 if metric == "cosine" else 0.0] * len(rows))
    some = got(exact=True, where=F.col("kind") == 1)
    assert {q: [i for _, i in x] for q, x in some.items()} == {q: [i for _, i in x] for q, x in want(among=lambda i: i % 3 == 1).items()}
    close = got(probes=len(index.rows))
    assert close == got(exact=True)
    few = got()
    hits = sum(len(set(few[q]) & set(x)) for q, x in close.items())
    assert hits >= 0.9 * sum(map(len, close.values()))


def test_index_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, None)], "id long, embedding array<float>"), str(tmp_path / "i"))
    one = vector_index.build(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>"), f"file://{tmp_path}/one")
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r.query_id, r.id, r.similarity) for r in vector_index.probe(one, asks, 3, exact=True).collect()] == [(5, 1, 0.0)]


def test_terms(spark):
    some = ["aa", "a", "aba", "b", "é", "zz", "", "aa"]
    texts = ["aaaa", "ababa", "", None, "é a é", "bb" * 50, "Aa"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "id int, text string, count string")
    got = {(r.id, r.term): r["count"] for r in terms.substring_counts(docs, ["id"], F.col("text"), some).collect()}
    want = {(i, t): n for i, x in enumerate(texts) for t in some if t and (n := (x or "").count(t))}
    assert got == want
    every = terms.substring_counts(docs, ["id"], F.col("text"), some, every=True).collect()
    assert len(every) == len(texts) * 6 and {(r.id, r.term): r["count"] for r in every if r["count"]} == want
    assert terms.substring_counts(docs, ["id"], F.col("text"), []).collect() == []
    low = {(r.id, r.term): r["count"] for r in search.term_counts(docs, "id", "text", ["AA", "aa"], case_sensitive=False).collect() if r.id == 6}
    assert low == {(6, "AA"): 1, (6, "aa"): 1}


def _tar(path, *names):
    with tarfile.open(path, "w") as tar:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = len(n)
            tar.addfile(info, io.BytesIO(n.encode()))


def test_archives_stream(spark, tmp_path):
    """New archives between runs, from a folder of foreign files, each read once."""
    spark.dataSource.register(archive_format.ArchiveSource)
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    _tar(feed / "1.tar", "a", "b")
    (feed / "notes.txt").write_text("no archive")
    for turn in range(3):
        if turn == 1:
            _tar(feed / "0.tar", "c")  # a smaller name, but later
            _tar(feed / "2.tar")
        stream = spark.readStream.format("archive").load(str(feed))
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        sink.trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.member for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c"]]
    assert spark.read.format("archive").load(str(feed / "*.tar")).count() == 3
    assert spark.read.format("archive").load(str(tmp_path / "none*")).count() == 0


def test_aborted_archives(spark, tmp_path):
    """A job that fails leaves nothing in the manifest nor for readers."""
    folder = f"file://{tmp_path}/out"
    good = spark.createDataFrame([("x", "b", b"2"), ("x", "a", b"1"), ("y/1", "c", None)], "archive string, member string, content binary")
    done = sinks.write_archives(good, "archive", "member", "content", folder)
    assert sorted((r.archive, r.members) for r in done.collect()) == [("x", 2), ("y/1", 1)]
    bad = good.repartition(3, "archive").withColumn("content", F.expr("CASE WHEN archive = 'x' THEN raise_error('lost') ELSE content END").cast("binary"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("archive").mode("append").save(folder)
    with pytest.raises(Exception, match="appended"):
        good.write.format("archive").mode("overwrite").save(folder)
    assert archive_format.manifest(spark, folder).count() == 2
    back = spark.read.format("archive").load(folder)
    assert sorted((r.member, bytes(r.content)) for r in back.collect()) == [("a", b"1"), ("b", b"2"), ("c", b"")]
    assert archive_format.manifest(spark, f"file://{tmp_path}/never").count() == 0
    # What has not been committed is not read, even if it lies there.
    _tar(tmp_path / "out/stray.tar", "z")
    assert spark.read.format("archive").load(folder).count() == 3


def test_table_functions(spark):
    table_functions.register_all(spark)
    form = "<ownershipDocument><documentType>4</documentType><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId></reportingOwner><ownerSignature><signatureName>S</signatureName></ownerSignature></ownershipDocument>"
    spark.createDataFrame([(1, form, "4/A"), (2, "nothing", "4"), (3, form, "10-K"), (4, None, "3")], "id int, content string, form string").createOrReplaceTempView("files")
    got = spark.sql("SELECT id, r.kind, r.position, r.fields['rptowner_cik'] AS cik FROM files, LATERAL document_rows(content, form) r ORDER BY id, kind").collect()
    assert [tuple(r) for r in got] == [(1, "reporting_owner", 1, "7"), (1, "signature", 1, None), (1, "submission", 1, None), (2, "error", 1, None), (4, "error", 1, None)]
    assert spark.sql("SELECT * FROM files, LATERAL holdings_rows(content) r WHERE id = 2").first().kind == "error"


def test_a_large_archive_is_several_tars(spark, tmp_path):
    """One archive used to pass through one task, however large."""
    rows = spark.range(4000).select(F.lit("x").alias("archive"), F.lpad(F.col("id").cast("string"), 5, "0").alias("member"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    folder = f"file://{tmp_path}/out"
    done = sinks.write_archives(rows, "archive", "member", "content", folder, parts=4).collect()
    assert {r.archive for r in done} == {"x"} and sum(r.members for r in done) == 4000
    assert len(done) > 2 and max(r.members for r in done) < 2000
    back = {r.member: bytes(r.content) for r in spark.read.format("archive").load(folder).collect()}
    assert back == {f"{i:05d}": str(i).encode() for i in range(4000)}


def test_terms_by_group_reads_documents_once(spark):
    """Counts used to be joined to the documents again for their language."""
    from quarry.plans import registry

    rows = registry.queries()["sea_terms_by_group"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan
