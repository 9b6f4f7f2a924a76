"""Retrieval before packing: whole queries, and shards by words."""

import numpy as np

from quarry.llm import packing, tokens


def test_all_terms_ask():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(2, 400, rng.integers(1, 120)), 1).astype(np.uint32) for _ in range(150)]
    index = packing.Bm25Shard(docs, 1)
    sets = [{int(t) for t in d if t != 1} for d in docs]
    df = {t: sum(t in s for s in sets) for t in range(2, 400)}
    mean = sum(map(len, docs)) / len(docs)
    for seed in range(0, 150, 10):
        want = np.zeros(150)
        for d, ids in enumerate(docs):
            for t in sets[seed] & sets[d]:
                tf = int((ids == t).sum())
                idf = np.log1p((150 - df[t] + 0.5) / (df[t] + 0.5))
                want[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids) / mean))
        got = index.scores(seed)
        others = np.arange(150) != seed
        np.testing.assert_allclose(got[others], want[others], rtol=1e-4)


def test_neighbours_meet_across_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 4000)
    monkeypatch.setattr(packing, "TEXT", 10_000)
    rng = np.random.default_rng(5)
    words = [[f"{a}{b}" for a in x for b in "lmnoprst"] for x in ("uvw", "xyz")]
    rows = [(i, " ".join(rng.choice(words[i % 2], 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    topics = {}
    for r in packing.pack(df, *tokens.default_paths(), length=256).collect():
        topics.setdefault(r.sequence_id, []).append(r.doc_id % 2)
    pure = sum(len(set(t)) == 1 for t in topics.values())
    assert len(topics) > 20 and pure >= 0.9 * len(topics)


def test_tails_are_powers_of_two():
    rng = np.random.default_rng(4)
    for _ in range(200):
        docs = [np.append(rng.integers(2, 90, rng.integers(0, 90)), 1).astype(np.uint32) for _ in range(rng.integers(1, 12))]
        pieces = packing.without_padding(packing.pack_shard(docs, 1, 64), 64)
        fill, spans = {}, {}
        for doc, start, size, sequence, offset in pieces:
            assert size > 0 and offset == fill.get(sequence, 0)
            fill[sequence] = offset + size
            spans.setdefault(doc, []).append((start, size))
        assert sorted(fill) == list(range(len(fill)))
        assert all(n == 64 or n & (n - 1) == 0 for n in fill.values()) and sum(fill.values()) == sum(map(len, docs))
        for i, d in enumerate(docs):
            ends = [0, *np.cumsum([n for _, n in sorted(spans[i])]).tolist()]
            assert [s for s, _ in sorted(spans[i])] == ends[:-1] and ends[-1] == len(d)


def test_groups_are_parted_by_topic(monkeypatch):
    """Sixteen topics, four shards' worth of each: their documents share shards
    with their own, all are there once, and no shard outgrows its bound."""
    monkeypatch.setattr(packing, "SHARD", 6000)
    rng = np.random.default_rng(6)
    topic = rng.integers(0, 16, 3000)
    docs = [np.append(rng.integers(50 * t + 2, 50 * t + 52, 120), 1).astype(np.uint32) for t in topic]
    shards = packing.parted(docs)
    assert sorted(i for s in shards for i in s) == list(range(3000))
    assert max(sum(len(docs[i]) for i in s) for s in shards) <= 1.5 * 6000 + 121
    same = sum(np.bincount(topic[s]).max() for s in shards)
    assert len(shards) >= 40 and same >= 0.9 * 3000


def test_router_grows_with_its_sample():
    rng = np.random.default_rng(7)
    topic = rng.integers(0, 300, 20_000)
    has = np.zeros((20_000, packing.PLACES), bool)
    has[np.arange(20_000)[:, None], (topic[:, None] * 13 + rng.integers(0, 40, (20_000, 30))) % packing.PLACES] = True
    bits, sizes = np.packbits(has, axis=1), np.full(20_000, 1000.0)
    tree = packing.Router(bits, sizes, sizes.sum() / 200)
    assert tree.leaves >= 150 and tree.shards >= 150
    shard = np.concatenate([tree.route(has[i : i + 500], np.arange(i, i + 500)) for i in range(0, 20_000, 500)])
    assert np.bincount(shard).max() <= 6 * 100
    together = [np.bincount(shard[topic == t]).max() / (topic == t).sum() for t in range(300)]
    assert np.mean(together) > 0.6


def test_rows_without_an_id_are_dealt_out(spark):
    rows = [(None, f"text {i % 7} of none {i}") for i in range(60)] + [(1, None), (1, ""), (2, "x " * 40_000)]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, p int, grp int").repartition(3)
    got = packing.pack(df, *tokens.default_paths()).collect()
    assert len([r for r in got if r.doc_id is None and r.start == 0]) == 60 and len([r for r in got if r.doc_id == 1]) == 2
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert r.padded == 2048 or r.padded & (r.padded - 1) == 0
    assert all(r.padded == fill[r.sequence_id] for r in got)
