"""The registered queries: columns of their contracts, SQL where there is any,
and plain versions that share no code with the operators."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import queries

from .test_pii import plain as plain_spans
from .test_quality import brute as brute_counts
from .test_simhash import brute_fingerprint, brute_groups

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_suffix_array": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_interactions": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


SQL = queries.oracle_sql()


def _duck():
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) - set(COLUMNS)))
def test_parts_of_contracts(spark, name):
    df = queries.queries()[name](spark, DATA)
    want = _duck().execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def _got(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in docs], queries.queries()[name](spark, DATA).collect()


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_toxicity_folds(spark):
    docs, got = _got(spark, "op1_toxicity")
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_pii_against_patterns(spark):
    docs, got = _got(spark, "op2_pii")
    texts, kinds = dict(docs), ["email", "ip", "card", "phone"]
    for r in got:
        spans = sorted(plain_spans(texts[r.doc_id]), key=lambda s: (kinds.index(s[0]), s[1]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in kinds]
        joined = ["{}:{}:{}".format(*s) for s in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_simhash_against_all_pairs(spark):
    docs, got = _got(spark, "op3_simhash")
    fps = [brute_fingerprint(t) for _, t in docs]
    first = {}
    for (i, _), top in zip(docs, brute_groups(fps), strict=True):
        first.setdefault(top, i)
    want = {(i, f"{f:016x}", first[t]) for (i, _), f, t in zip(docs, fps, brute_groups(fps), strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_quality_against_counts(spark):
    docs, got = _got(spark, "op4_quality")
    texts = dict(docs)
    for r in got:
        n, chars, symbols, lines, again = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n) and not (r.base_failed and r.kept)
    # The verdict is the posterior's, which rises with every vote to keep.
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got)


def test_packing_against_the_library(spark):
    docs, got = _got(spark, "op6_packing")
    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in sorted(got, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces[i]] == [0, *np.cumsum([r.length for r in pieces[i]])[:-1]] and sum(r.length for r in pieces[i]) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == _crc(ids[r.start : r.start + r.length]) for r in pieces[i])
    rows = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(o1 == (o0 + n if s1 == s0 else 0) for (s0, o0, n), (s1, o1, _) in zip(rows, rows[1:], strict=False))
    assert all(o + n <= 2048 for _, o, n in rows)


def test_bpe_against_the_library(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, got = _got(spark, "op7_bpe")
    found = {r.doc_id: r for r in got}
    for i, text in docs:
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_records_against_the_library(spark):
    docs, got = _got(spark, "op8_records")
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    found = {r.doc_id: r for r in got}
    for i, text in docs:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), _crc(ids))
        start += len(ids)


def test_media_against_bytes(spark):
    docs, got = _got(spark, "op9_media")
    texts = dict(docs)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = queries.queries()[name](spark, DATA)
    kinds = dict(df.dtypes)
    wanted = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: kinds.get(c) for c in wanted} == wanted
    rows = df.collect()
    if "doc_id" in wanted:
        _one_row_each(spark, name, rows)
    if sql := SQL.get(name):
        con = _duck()
        names = [c.split()[0] for c in COLUMNS[name].split(", ")]
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want)


def _one_row_each(spark, name, rows):
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == docs
    if name != "op6_packing":
        assert len(rows) == len(docs)
