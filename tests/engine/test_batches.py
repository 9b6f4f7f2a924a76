"""Batches of large rows are worked off some rows at a time."""

import gzip

import pyarrow as pa

from quarry.functions import udf
from quarry.sources import index_files


def test_a_batch_is_never_whole_in_python_objects():
    seen = []

    def fn(texts):
        seen.append(sum(len(t or "") for t in texts))
        return texts.map(lambda t: None if t is None else t.upper())

    texts = ["ab" * 50_000, None, ""] * 200
    got = udf.in_slices(fn, pa.string())(pa.array(texts))
    assert got.to_pylist() == [None if t is None else t.upper() for t in texts]
    assert len(seen) > 1 and max(seen) <= 2 * udf.BYTES
    assert udf.in_slices(fn, pa.string())(pa.array([], pa.string())).to_pylist() == []


def test_an_index_file_gives_its_rows_in_pieces():
    line = "{}|Company é {}| 10-K |1996-02-03|edgar/data/{}/0000000001-96-000001.txt"
    text = "Description\r\nCIK|Company Name|Form Type|Date Filed|Filename\r\n" + "\r\n".join(line.format(i, i, i) for i in range(60_000))
    plain = text.encode("latin1")
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([plain, gzip.compress(plain), b""], pa.binary())], names=["path", "content"])
    out = list(index_files._master_rows(iter([files])))
    assert max(b.nbytes for b in out) < 3 * index_files.PIECE and len(out) > 4
    for path in "ab":
        rows = [r for b in out for r in b.to_pylist() if r["path"] == path]
        assert [r["cik"] for r in rows] == list(range(60_000))
        assert rows[7]["company"] == "Company é 7" and rows[7]["form"] == "10-K" and str(rows[7]["filing_date"]) == "1996-02-03"
