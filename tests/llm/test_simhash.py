"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash

from quarry.llm import simhash


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i] ^ rows[j]).bit_count() <= 2:
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    return top


def test_documents(spark):
    rng = random.Random(1)
    base = " ".join(rng.choices("ab cd ef gh ij kl Mn ÉO".split(), k=300))
    texts = [None, "", " \n", "one", "one two", "One TWO", base, base + " tail", "x " + base, "é É"]
    texts += [" ".join(rng.choices("pq rs tu vw".split(), k=rng.randint(1, 40))) for _ in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "one", "again"), (None, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    top = brute_groups(fps)
    ids = {}
    for (i, _, _), t in zip(rows, top, strict=True):
        ids[t] = min(ids.get(t, 1 << 62), i if i is not None else 1 << 62)
    want = sorted((str(i), f"{f:016x}", ids[t]) for (i, _, _), f, t in zip(rows, fps, top, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_shards_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = simhash.connected_components(simhash.fingerprint_links(df)).collect()
    top = brute_groups([v & (1 << 64) - 1 for v in values])
    want = {}
    for v, t in zip(values, top, strict=True):
        want.setdefault(t, set()).add(v)
    got = {}
    for r in roots:
        got.setdefault(r.root, {r.root}).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 10, 300).astype(np.uint64)
    found = []
    at = np.arange(300)
    simhash.BkTree(v, at).search(v, at, 2, found)
    pairs = {(int(i), node) for near, node in found for i in near}
    assert pairs == {(i, j) for i in range(300) for j in range(300) if (int(v[i]) ^ int(v[j])).bit_count() <= 2}


def test_hubs_are_met_by_broadcast(spark, monkeypatch):
    from quarry.llm import components

    monkeypatch.setattr(components, "LEAST_HUB", 3)
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 40)] + [(100, 40 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert all(top[n] == r for n, r in got.items()) and {n for n, t in top.items() if n != t} <= set(got)


def test_one_of_each_keeps_columns_and_the_same_row(spark):
    rows = [(1, "a b c", "z", 3), (1, "a b c", "y", 4), (2, "other words here now", "x", 5), (None, None, "w", 6), (None, "", "v", 7), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, `row.key` int")
    for parts in (1, 4):
        got = simhash.one_of_each(df.repartition(parts))
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[2], rows[4]], df.schema).collect()))
