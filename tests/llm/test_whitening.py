"""Whitening against numpy, and rows of every odd kind."""

import numpy as np
import pytest

from quarry.llm import queries, whitening

from .test_queries import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def plain(rows, count=4):
    """vec_id, deviation and whitened columns (either sign), by numpy alone."""
    good = [(i, [float(c) for c in e]) for i, e, *_ in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    width = max(len(e) for _, e in good)
    x = np.array([[int(np.floor(256 * c)) for c in e] + [0] * (width - len(e)) for _, e in good], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:count], v[:, ::-1][:, :count]
    y = x * n - sums
    return [i for i, _ in good], (y * y).sum(axis=1), ((y / n).astype(float) @ v) / np.sqrt(e), e / np.trace(cov), n


def held(df, rows, count=4, ambiguous=()):
    got = df.collect()
    ids, deviation, white, explained, n = plain(rows, count)
    k = white.shape[1]
    assert len(got) == k * len(ids)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for at, i in enumerate(ids):
        for c in range(k if i not in ambiguous else 0):
            r = by[i, c + 1][0]
            assert r.n == n and int(r.deviation) == deviation[at]
            assert abs(abs(r.whitened) - abs(white[at, c])) < 1e-8
            assert abs(r.explained - explained[c]) < 1e-9 and r.identity_error < 1e-9
            if abs(white[at, c]) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(r.whitened * white[at, c]))
    assert all(len(s) == 1 for s in signs.values())


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    held(queries.op11_whitening(spark, DATA), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5)], 1, 9, "x") for i in range(40)]
    rows += [(100 + i, rows[3][1], None, None, None) for i in range(30)]  # copies of one vector
    rows += [(200, None, 0, 0, ""), (201, [None, 1.0, 1.0, 1.0, 1.0], 0, 0, ""), (202, [float("nan")] * 5, 0, 0, ""), (203, [float("inf")] * 5, 0, 0, "")]
    rows += [(None, rows[7][1], 0, 0, ""), (204, [-0.0] * 5, 0, 0, ""), (205, [0.0] * 5, 0, 0, ""), (206, [0.001], 0, 0, ""), (207, [], 0, 0, ""), (7, rows[8][1], 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    done = whitening.whitened(df)
    assert done.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids = [r[0] for r in rows]
    held(done, rows, ambiguous=(None, 7))
    got = done.where("component = 1").select("vec_id").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i in ids if i not in (200, 201, 202, 203))
    twice = {(r.component, r.whitened) for r in done.where("vec_id >= 100 AND vec_id < 130 OR vec_id = 3").collect()}
    assert len(twice) == 4


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * (i + 1)), float(i % 3)], 0, 0, "") for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component int, x string")
    _, deviation, _, explained, _ = plain(rows, 2)
    got = {r.vec_id: r for r in whitening.whitened(df).where("component = 1").collect()}
    assert all(int(got[i].deviation) == deviation[i] for i in got)
    assert abs(got[0].explained - explained[0]) < 1e-4
    cut = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in whitening.whitened(cut).collect()) == [0, 1, 2]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [])]])
def test_nothing_to_fit(spark, rows):
    done = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert done.collect() == [] and done.dtypes[0] == ("vec_id", "bigint")


def test_without_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(0, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained == 0 and r.n == 1 and r.identity_error == 0 for r in one)
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), float(2 * i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert {round(r.explained, 9) for r in line} == {0.0, 1.0} and line[0].identity_error < 1e-9
