"""Both span removers against brute force."""

import random

import numpy as np
import pytest

from quarry.llm import rolling, substring, suffix
from quarry.llm.automaton import SuffixAutomaton
from quarry.llm.rindex import RunIndex, first_places, suffix_order


def brute_words(rows, length):
    first, out = {}, []
    split = [(t or "").encode().split() for _, t in rows]
    order = [(i if i is not None else 1 << 70) for i, _ in rows]
    for i, w in zip(order, split, strict=True):
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            first[k] = min(first.get(k, 1 << 80), i)
    for i, w in zip(order, split, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def brute_bytes(rows, length):
    first, out = {}, []
    raws = [(t or "").encode() for _, t in rows]
    order = [(i if i is not None else 1 << 70) for i, _ in rows]
    for i, r in zip(order, raws, strict=True):
        for a in range(len(r) - length + 1):
            k = r[a : a + length]
            first[k] = min(first.get(k, (1 << 80, 0)), (i, a))
    for i, r in zip(order, raws, strict=True):
        gone = [False] * len(r)
        for a in range(len(r) - length + 1):
            if first[r[a : a + length]] < (i, a):
                gone[a : a + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, bytes(x for x, g in zip(r, gone, strict=True) if not g)))
    return out


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "cde", "é", "fgh", "I", "jk,"]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 90), (5, "x" * 70)]
    for i in range(6, 60):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        if rng.random() < 0.6:
            at = rng.randint(0, len(t))
            t = t[:at] + " " + passage + " " + t[at:]
        rows.append((i, t))
        if rng.random() < 0.3:
            rows.append((i + 100, t[: rng.randint(0, len(t))] + "Q" + t[rng.randint(0, len(t)) :]))
    rows += [(7, rows[7][1]), (7, "other " + passage), (None, passage), (None, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 2000), (2, 3)])
def test_words(spark, seed, most, monkeypatch):
    monkeypatch.setattr(substring, "MOST", most)
    rows = fixture(seed)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, version int")
    got = substring.remove_repeated_words(df.repartition(3), words=9, gram=3, buckets=5).collect()
    want = [(str(i), *w) for (i, _), w in zip(rows, brute_words(rows, 9), strict=True)]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert substring.remove_repeated_words(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "most"), [(3, 8000), (4, 3)])
def test_bytes(spark, seed, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", most)
    rows = fixture(seed)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, version int")
    got = suffix.remove_repeated_bytes(df.repartition(3), length=20, gram=6, buckets=5).collect()
    want = [(str(i), *w) for (i, _), w in zip(rows, brute_bytes(rows, 20), strict=True)]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert suffix.remove_repeated_bytes(df.limit(0)).count() == 0


def test_run_index_and_automaton():
    rng = random.Random(5)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 10))]
        index, length = RunIndex(parts), rng.randint(2, 6)
        rank = np.array(rng.sample(range(index.n), index.n))
        got, least, shard = first_places(index, length, rank), {}, SuffixAutomaton()
        for s, p in zip(index.starts.tolist(), parts, strict=True):
            for i in range(len(p) - length + 1):
                w = p[i : i + length]
                least[w] = min(least.get(w, index.n), rank[s + i])
        for j, (s, p) in enumerate(zip(index.starts.tolist(), parts, strict=True)):
            for i in range(len(p) - length + 1):
                assert got[s + i] == least[p[i : i + length]]
            size, first = shard.matches(list(p), length)
            for i, (m, f) in enumerate(zip(size, first, strict=True)):
                assert m == max(n for n in range(min(i + 1, length) + 1) if not n or any(p[i + 1 - n : i + 1] in q for q in parts[:j]))
                assert not m or f == min(k for k in range(j) if p[i + 1 - m : i + 1] in parts[k])
            shard.add(list(p), j)


def test_suffix_order():
    rng = random.Random(7)
    for n in (0, 1, 2, 50, 300):
        text = rng.choices(range(3), k=n)
        assert suffix_order(np.array(text, np.int32)).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_words_that_hash_alike(spark):
    # Sums modulo a power of two cannot tell these two words apart.
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    front = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{front} {word}"), (2, f"{front} {other}"), (3, f"{front} {word}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeated_words(df).collect()} == {1: 0, 2: 0, 3: 50}
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeated_bytes(df).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, brute_bytes(rows, 100), strict=True)]


def test_largest_id_is_no_missing_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    top = (1 << 63) - 1
    df = spark.createDataFrame([(None, text), (top, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeated_words(df).collect())
    assert got == [(str(top), 0), ("None", 60), ("None", 60)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix.remove_repeated_bytes(df).collect())
    assert got == [(str(top), 0), ("None", len(text)), ("None", len(text))]


def test_windows_lie_in_one_run_each():
    rng = random.Random(6)
    docs = [bytes(rng.choices(b"ab c", k=rng.randint(0, 60))) for _ in range(8)]
    raw, off = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0] + [len(d) for d in docs])
    for piece in (1 << 21, 30):
        found = rolling.runs(rolling.byte_elements(raw), off, 10, 4, piece)
        where, anchors = [], {}
        for x in found:
            for r, a, c, h in zip(x.row, x.start, x.count, x.anchor, strict=True):
                where += [(int(r), int(a) + i) for i in range(c)]
                for i in range(c):
                    anchors.setdefault(docs[r][a + i : a + i + 10], set()).add(int(h))
        assert sorted(where) == [(d, i) for d in range(8) for i in range(len(docs[d]) - 9)]
        assert all(len(v) == 1 for v in anchors.values())
