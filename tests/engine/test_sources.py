"""Index files, JSON facts, archives and blobs from small made-up files."""

import gzip
import io
import json
import tarfile
import zipfile

import zstandard

from quarry.sources import archives, facts, index_files, listing

MASTER = """Description: index
CIK|Company Name|Form Type|Date Filed|Filename
--------------------------------------------------
320193|Example Inc.|10-K|2024-02-01|data/320193/0000320193-24-000001.txt
789|Société|4|2024-02-03|data/789/0000000789-24-000002.txt
bad line
"""


def test_master_index(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("master.idx", MASTER.encode("latin1"))
    (tmp_path / "b.idx.gz").write_bytes(gzip.compress(MASTER.encode("latin1")))
    rows = index_files.master_index(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.idx.gz")], "https://host").collect()
    assert len(rows) == 4 and {r.company for r in rows} == {"Example Inc.", "Société"}
    r = next(r for r in rows if r.cik == 320193)
    assert r.accession_number == "0000320193-24-000001" and str(r.filing_date) == "2024-02-01"
    assert r.homepage_url == "https://host/data/320193/000032019324000001/0000320193-24-000001-index.html"
    q = index_files.index_quality(index_files.master_index(spark, str(tmp_path / "a.zip")), "path").first()
    assert (q.total, q.bad) == (2, 0)


def test_missing_quarters_are_skipped(spark, tmp_path):
    (tmp_path / "2024/QTR2").mkdir(parents=True)
    (tmp_path / "2024/QTR2/m.idx").write_text(MASTER, encoding="latin1")
    rows = index_files.quarters(spark, str(tmp_path), [2023, 2024])
    assert {(r.year, r.quarter) for r in rows.collect()} == {(2024, 2)} and rows.count() == 2
    assert index_files.quarters(spark, str(tmp_path), [2020]).count() == 0


def test_daily_index(spark, tmp_path):
    head = f"{'Form Type':<12}{'Company Name':<20}{'CIK':<12}{'Date Filed':<12}File Name"
    line = f"{'10-K/A':<12}{'Example Inc.':<20}{'320193':<12}{'20240201':<12}data/1/x.txt"
    (tmp_path / "form.idx").write_text(f"Daily Index\n\n{head}\n{'-' * 80}\n{line}\n")
    r = index_files.daily_index(spark, str(tmp_path / "form.idx")).first()
    assert (r["Form Type"], r["Company Name"], r["CIK"], str(r["Date Filed"]), r["File Name"]) == ("10-K/A", "Example Inc.", 320193, "2024-02-01", "data/1/x.txt")


def test_facts_and_tickers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "EX", "title": "Example"}}))
    assert tuple(facts.tickers(spark, str(tmp_path / "t.json")).first()) == ("0000320193", "EX", "Example")
    point = {"val": 5, "accn": "a-1", "end": "2023-12-31", "filed": "2024-02-01", "fy": 2023, "fp": "FY", "form": "10-K"}
    body = {"cik": 7, "entityName": "E", "facts": {"us": {"Cash": {"label": "Cash", "description": "d", "units": {"USD": [point, {**point, "val": None}], "EUR": [point]}}}}}
    (tmp_path / "CIK7.json").write_text(json.dumps(body))
    rows, meta = facts.company_facts(spark, str(tmp_path / "CIK7.json"))
    got = rows.collect()
    assert sorted((r.unit, r.val) for r in got) == [("EUR", 5.0), ("USD", 0.0), ("USD", 5.0)] and got[0].cik == "0000000007" and got[0].frame == ""
    assert [tuple(r) for r in meta.collect()] == [("Cash", "Cash", "d")]


def test_archives_and_blobs(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, data in (("x.nc", b"one"), ("y.txt", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    raw = buffer.getvalue()
    feed = tmp_path / "2024/QTR1/RAW"
    feed.mkdir(parents=True)
    for name, data in (("20240101.tar.gz", gzip.compress(raw)), ("20240101.tar.zst", zstandard.compress(raw)), ("20240102.tar", raw)):
        (feed / name).write_bytes(data)
    spark.dataSource.register(archives.ArchiveSource)
    got = spark.read.format("archive").option("suffix", ".nc").load(str(feed / "*.tar*")).collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("x.nc", b"one")] * 3
    best = archives.daily_archives(spark, str(tmp_path))
    days = {r.day: r.path for r in best.collect()}
    assert days["20240101"].endswith(".zst") and set(days) == {"20240101", "20240102"}
    assert sorted((r.member, bytes(r.content)) for r in archives.archive_members(best).collect()) == [("x.nc", b"one")] * 2 + [("y.txt", b"two")] * 2
    assert archives.archive_members(archives.listed(spark, str(tmp_path)), suffix=".nc").count() == 3
    assert archives.daily_archives(spark, str(tmp_path), ["20240102"]).count() == 1 and archives.daily_archives(spark, str(tmp_path), since=2025).count() == 0
    (tmp_path / "blob").mkdir()
    (tmp_path / "blob/a.zst").write_bytes(zstandard.compress(b"0123456789"))
    row = archives.blobs(spark, str(tmp_path / "blob")).select(archives.segment("content", 2, 5).alias("s")).first()
    assert bytes(row.s) == b"234"


def test_listings(spark):
    html = '<a href="../">Parent Directory</a> <a href="QTR1/">QTR1</a> <a href="/abs/x.zip">x</a>'
    df = spark.createDataFrame([("https://h/d/", html)], "base string, html string")
    assert {r.target for r in listing.directory_entries(df, "base", "html").collect()} == {"https://h/d/QTR1/", "/abs/x.zip"}
    p = spark.createDataFrame([("a/2023/QTR2/0000000001-23-000001.htm.zstd",)], "path string").select(listing.path_parts("path").alias("p")).first().p
    assert (p.year, p.quarter, p.accession, p.suffix) == (2023, 2, "0000000001-23-000001", "htm")
