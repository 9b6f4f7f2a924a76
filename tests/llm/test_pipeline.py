"""The pipeline's stages, one by one and as a whole, against plain versions of
their contracts that share no code with the operators."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import tokens

from .test_pii import plain as plain_spans
from .test_quality import brute as brute_counts
from .test_simhash import brute_fingerprint, brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the house of a man and some other words that make up plain text for this test in which each line is new".split()


def _rows():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(WORDS, k=n)) + "."
    base = [text(120) for _ in range(30)]
    passage = "".join(rng.choices("abcdefghij klmno", k=260))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]  # copies
    rows += [(200, base[6] + " é" + passage + "é " + text(40)), (201, text(90) + passage + " " + text(30))]
    rows += [(300, text(60) + " write to a.b@c.example.com or +1 (456) 555-2186"), (301, "too short"), (302, None)]
    rows += [(303, "spam ham " * 80), (7, base[7])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def test_stages(spark, tmp_path):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_spans", "personal_data", "packed"]

    kept = stages["quality_rules"](spark, docs, "").collect()
    counts = {(i, t): brute_counts(t) for i, t, *_ in rows}
    fails = {k for k, (n, _, _, _, again) in counts.items() if n < 20 or 100 * again > 30 * n}
    got = sorted((r.doc_id, r.text) for r in kept)
    # What the base rule rejects goes; what no rule can speak against stays.
    assert not set(got) & fails and {(301, "too short"), (302, None), (303, "spam ham " * 80)} <= fails
    plain = {k for k in set(counts) - fails if counts[k][2] == counts[k][3] == counts[k][4] == 0}
    assert plain <= set(got) and len(plain) > 30
    assert [r for r in kept if r.lang != "en" or r.source != "s" or r.n_chars != len(r.text)] == []

    apart = stages["near_duplicates"](spark, spark.createDataFrame(kept, SCHEMA).repartition(4), "").collect()
    top, first = brute_groups([brute_fingerprint(r.text) for r in kept]), {}
    for r, t in zip(kept, top, strict=True):
        first[t] = min(first.get(t, 1 << 62), r.doc_id)
    assert sorted(r.doc_id for r in apart) == sorted(first.values())
    assert not {100, 101, 102, 103, 104} & set(first.values()) and set(map(tuple, apart)) <= set(map(tuple, kept))
    apart = spark.createDataFrame(apart, SCHEMA).repartition(3)

    clean = stages["repeated_spans"](spark, apart, "").collect()
    before = {r.doc_id: r.text for r in apart.collect()}
    first = {}
    for i in sorted(before):
        raw = before[i].encode()
        for a in range(len(raw) - 99):
            first.setdefault(raw[a : a + 100], (i, a))
    assert any(len(r.text) < len(before[r.doc_id]) for r in clean)
    for r in clean:
        raw, gone = before[r.doc_id].encode(), set()
        for a in range(len(raw) - 99):
            if first[raw[a : a + 100]] < (r.doc_id, a):
                gone.update(range(a, a + 100))
        assert r.text == bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")
        assert r.n_chars == len(r.text)

    safe = stages["personal_data"](spark, spark.createDataFrame(clean, SCHEMA), "")
    texts = {r.doc_id: r for r in safe.collect()}
    for r in clean:
        # All that stands between the base spans stays, unless it was added.
        now, at, pattern = texts[r.doc_id].text, 0, ""
        for _, x, y in sorted(plain_spans(r.text), key=lambda s: s[1]):
            if x >= at:
                pattern += re.escape(r.text[at:x]) + "<[A-Z]+>"
            at = max(at, y)
        assert re.fullmatch(pattern + re.escape(r.text[at:]), now) and not plain_spans(now) and texts[r.doc_id].n_chars == len(now)
    assert texts[300].text.endswith("write to <EMAIL> or <PHONE>") and safe.schema == docs.schema

    library = Tokenizer.from_file(tokens.default_paths()[0])

    def check_pieces(packed):
        pieces = {}
        for r in packed:
            pieces.setdefault(r.doc_id, []).append(r)
        assert set(pieces) == set(texts)
        for i, own in pieces.items():
            ids = np.array([*library.encode(texts[i].text, add_special_tokens=False).ids, 1], "<u4")
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
            assert all(r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        rows = sorted((r.sequence_id, r.offset, r.length) for r in packed)
        for (s0, o0, n0), (s1, o1, _) in zip(rows, rows[1:], strict=False):
            assert o1 == (o0 + n0 if s1 == s0 else 0)
        assert all(o + n <= 2048 for _, o, n in rows)

    check_pieces(stages["packed"](spark, safe, "").collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_more_columns_and_repeated_rows(spark):
    text = " ".join(WORDS * 3)
    schema = SCHEMA + ", _key string, key int, row int, block int, kind string"
    rows = [(1, text, "en", "s", 5, "b", 1, 2, 3, "x"), (1, text, "en", "s", 5, "a", 1, 2, 3, "x"), (None, "other " + text, None, None, None, None, None, None, None, None)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == spark.createDataFrame(rows, schema).columns, name
        got = docs.collect()
        assert [r for r in got if r.doc_id == 1] == [r for r in got if r._key == "a"] and len(got) <= 2
        assert stage(spark, docs, "").count() == len(got)


def test_empty_and_odd_tables(spark):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "x", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.count()
