"""Unit-wise encoding, record files and packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, records, tokens

PATHS = tokens.default_paths()
ENCODER = tokens.UnitEncoder.load(*PATHS)
#: The library as it comes, with nothing set.
LIBRARY = Tokenizer.from_file(PATHS[0])
HARD = ["a", "b", " ", " ", "é", "1", "'s", "\n", "\t", ".", ",", "中", "　", "\xa0", "🙂", "ll", "\x1c", "<|endoftext|>", "Ġ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(HARD), max_size=30))
def test_units_equal_the_library(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == want


def test_added_tokens_have_their_own_ids():
    for text in ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>\n", "<|endoftext|><|endoftext|> x", "<|endoftext| >"]:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == want
    assert 50256 in LIBRARY.encode("a <|endoftext|> b", add_special_tokens=False).ids


ROWS = [(4, "a <|endoftext|> b"), (5, "hello there, world"), (1, None), (9, ""), (3, "x" * 5000), (3, "again"), (None, "no id"), (2, "é 中 " * 300)]


def _frame(spark):
    rng = random.Random(4)
    more = [(i, " ".join(rng.choices("alpha beta gamma delta, eps. zeta".split(), k=rng.randint(0, 900)))) for i in range(20, 60)]
    rows = ROWS + more
    return rows, spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(3)


def _ids(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def test_records(spark):
    rows, df = _frame(spark)
    got = sorted(records.record_round_trip(df, *PATHS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is not None)) + [None]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted((str(i), _ids(t, 0)) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert records.record_round_trip(df.limit(0), *PATHS).count() == 0


def test_shuffled_reads(spark, tmp_path):
    rows, df = _frame(spark)
    folder = f"file://{tmp_path}/records"
    manifest = records.write_records(df, folder, *PATHS)
    orders = []
    for seed in (1, 1, 2):
        got = records.read_shuffled(spark, folder, manifest, seed).collect()
        want = sorted((str(i), _ids(t, 0)) for i, t in rows)
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
        assert [r.place for r in got] == sorted(r.place for r in got)
        orders.append([r.doc_id for r in got])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0], key=lambda i: (i is None, i))
    assert records.read_shuffled(spark, folder, []).count() == 0


def test_damage_is_seen():
    data = records.frame(b"payload")
    assert records.unframe(data, 0) == (b"payload", len(data))
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], 0)


def test_packing(spark, monkeypatch):
    rows, df = _frame(spark)
    got = packing.pack(df, *PATHS, length=256).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        # Whole windows and powers of two: nothing is padded.
        assert at == r.padded <= 256 and r.padded & (r.padded - 1) == 0
    want = {(str(i), len(_ids(t, 1))): _ids(t, 1) for i, t in rows}
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()] == want[key]
    assert packing.pack(df.limit(0), *PATHS).count() == 0


def test_neighbours_share_terms():
    docs = [np.array(d, np.uint32) for d in ([5, 6, 7, 1], [8, 9, 1], [5, 6, 2, 1], [7, 3, 1], [1])]
    index = packing.Bm25Shard(docs, 1)
    assert index.neighbours(0, np.ones(5, bool)).tolist() == [0, 2, 3]
    assert index.neighbours(1, np.ones(5, bool)).tolist() == []


def test_records_of_many_files(spark, monkeypatch):
    """Files follow the texts' bytes; rows equal in id and text lie in several, and
    the order across files holds."""
    monkeypatch.setattr(records, "FILE", 1500)
    monkeypatch.setattr(records, "ENTRIES", 7)
    rows = [(i, f"row {i} " * (i % 9)) for i in range(300)] + [(150, "same text of one id")] * 400 + [(None, f"none {i % 3}") for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, deal int").repartition(5)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/many"
    manifest = records.write_records(df, folder, *PATHS)
    assert len(manifest) > 8 and sum(r.records for r in manifest) == len(rows)
    back = sorted(records.read_records(spark, folder, manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in back]
    assert ids == sorted((i for i, _ in rows if i is not None)) + [None] * 60
    ends = np.cumsum([len(r.ids) // 4 for r in back])
    assert [r.start for r in back] == [0, *ends[:-1].tolist()]
    want = sorted(len(_ids(t, 0)) for i, t in rows if i == 150)
    assert sorted(len(r.ids) // 4 for r in back if r.doc_id == 150) == want
    assert len(records.write_records(df.limit(0), folder + "0", *PATHS)) == 0
