"""Statistics by a plain count, trees by walking them one at a time, held-out accuracy."""

import os
import re
from collections import Counter

import numpy as np

from quarry.llm import classifier, histogram_trees, queries
from quarry.llm.quality import STOP_WORDS

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


def plain(text):
    raw, words = text.encode(), re.findall(r"[^ \t\n\x0b\f\r]+", text)
    n, some = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
    pairs = list(zip(words, words[1:], strict=False))
    signs, letter = set("#$%&*|<>{}[]\\^~_="), lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    share = [c / len(raw) for c in Counter(raw).values()]
    fold = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    points = [c for c in text if 32 < ord(c) < 127 and not c.isalnum() and c not in signs]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / some, np.log1p(max(map(len, words), default=0)),
        sum(c.isascii() and c.isupper() for c in text) / n, sum(c in "0123456789" for c in text) / n, sum(c in signs for c in text) / n,
        len(points) / n, sum(c in "!?" for c in text) / some, sum(ord(c) > 127 for c in text) / n, sum(c in " \t\n\x0b\f\r" for c in text) / n,
        len(set(words)) / some, max(Counter(words).values(), default=0) / some, sum(a == b for a, b in pairs) / some, len(set(pairs)) / max(1, len(pairs)),
        sum(fold(w) in STOP_WORDS for w in words) / some, (len(lines) - len(set(lines))) / max(1, len(lines)), sum(x[-1] in ".!?:;" for x in lines) / max(1, len(lines)),
        sum(not any(map(letter, w)) for w in words) / some, sum(w[-1] in signs for w in words) / some, sum(w[0].isascii() and w[0].isupper() for w in words) / some,
        -sum(s * np.log2(s) for s in share),
    ]


TEXTS = [
    None, "", " \n\t ", "x", "The the THE\nand  é$ 12 ?!\n\nThe the THE\n", "a b a b a b\x0bc", "Ünï 日本語 words.\nline\nline\n", "no end", "\n\nlead\n",
    "#a $b %c &d *e |f", "trailing \n", "one two three. " * 300, "y" * 5000,
]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, stats int").coalesce(1)
    found = {r.doc_id: r.stats for r in classifier.statistics(docs).collect()}
    for i, t in enumerate(TEXTS):
        np.testing.assert_allclose(found[i], plain(t or ""), rtol=1e-5, atol=1e-5, err_msg=repr(t)[:60])


def test_long_texts_in_pieces(monkeypatch):
    """Pieces give what a text gives in one, wherever cuts fall."""
    text = ("The the a b a b\nline of words. and $x y&\n\n" * 30 + "long " * 40 + "x" * 50 + "\nend").encode()
    raw = np.frombuffer(text, np.uint8)
    whole = classifier.tally(raw, np.array([0, len(raw)])).statistics()
    lines = classifier.STATISTICS.index("log_lines"), classifier.STATISTICS.index("repeated_lines"), classifier.STATISTICS.index("ended_lines")
    for piece in (300, 70, 41):
        got = classifier.tally_of_one(raw, piece).statistics()
        same = [i for i in range(len(classifier.STATISTICS)) if piece > 250 or i not in lines]
        np.testing.assert_allclose(got[0, same], whole[0, same], rtol=1e-6)
    monkeypatch.setattr(classifier, "SLICE", 300)
    np.testing.assert_allclose(classifier.statistics_of(raw, np.array([0, len(raw)])), whole, rtol=1e-6)
    one = np.frombuffer(b"y" * 5000, np.uint8)
    np.testing.assert_allclose(classifier.statistics_of(one, np.array([0, 5000])), classifier.tally(one, np.array([0, 5000])).statistics(), rtol=1e-6)


def test_walk_of_all_trees_at_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    x[:, 3] = rng.integers(0, 3, 3000)
    y = ((x[:, 0] > 0) ^ (x[:, 3] == 1)).astype(int)
    aside = np.arange(3000) % 5 == 0
    trees = histogram_trees.fit(x, y, np.ones(3000), aside)
    one = []
    for row in x[:200]:
        total = trees.start
        for root in trees.roots.tolist():
            at = root
            while trees.left[at] != at:
                at = int(trees.right[at] if row[trees.feature[at]] > trees.limit[at] else trees.left[at])
            total += trees.value[at]
        one.append(total)
    np.testing.assert_allclose(trees.raw(x[:200]), one)
    assert ((trees.predict(x) > 0.5) == y).mean() > 0.98
    assert len(trees.raw(x[:0])) == 0


def test_held_out(spark):
    rows = {r.doc_id: r for r in queries.op13_quality_classifier(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (1, "good words here", 6), (None, None, 7), (2, "#", 8)], "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    none = classifier.quality_scores(docs, spark.createDataFrame([], labels)).collect()
    assert [r.score for r in none] == [0.5] * 4
    some = classifier.quality_scores(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0), (5, 1, 0)], labels)).collect()
    assert len({(r.doc_id, r.score) for r in some}) == 3
    assert classifier.quality_scores(docs.limit(0), spark.createDataFrame([(1, 1, 0)], labels)).collect() == []
