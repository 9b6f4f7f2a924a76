"""Nearest neighbours of every query id against brute force."""

import numpy as np
import pytest

from quarry.operators import search
from quarry.plans import registry


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, size):
    path = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want |= {(ids[q], i) for i in ids[np.lexsort((ids, d))[:10]]}
    got = [(r.query_id, r.vec_id) for r in registry.queries()["vec_ann_index"](spark, path).collect()]
    assert len(got) == len(set(got)) == len(want)
    assert len(set(got) & want) / len(want) >= 0.9


def test_ties_blocks_and_missing(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = [(i, [1.0, 0.0] if i < 300 else [0.0, 1.0]) for i in range(310)] + [(400, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = search.nearest(df, df.where("id IN (0, 5, 305, 400, 299)"), 3, metric="euclid").collect()
    found = {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert found == {0: [1, 2, 3], 5: [0, 1, 2], 299: [0, 1, 2], 305: [300, 301, 302]}
    few = search.nearest(df.where("id < 2"), df.where("id = 0"), 3).collect()
    assert [(r.id, r.similarity) for r in few] == [(1, 1.0)]
