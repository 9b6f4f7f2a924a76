"""The kernel against its definition, tolerance, and held-out accuracy."""

import os
import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import toxicity as tx

INSULTS = ["zwofflik", "prumbast", "kqeldor"]


def _bag(text):
    letters, starts, _ = tx.words_of([text])
    first, _ = tx.distinct(letters, starts) if len(starts) > 1 else ([], None)
    return b"".join(letters[starts[i] : starts[i + 1]].tobytes() + b"\0" for i in first)


def _texts(seed, n):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "in", "an", "st", "ent", "ou", "ing", "al", "re"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


def _spell(words):
    letters, starts, _ = tx.words_of(words)
    return tx._spelled(letters, starts, np.arange(len(starts) - 1))


def test_kernel_equals_its_definition():
    words = ["abcde", "abxcd", "bcdea", "ab", "aaaa"]
    row, edges = _spell(words)
    got = tx.Landmarks(row, edges).kernel(row, edges)

    def weights(word):
        s, out = [0, *(ord(c) - 96 for c in word), 0], {}
        for at in combinations(range(len(s)), 4):
            if at[3] - at[0] <= tx.SPAN:
                k = tuple(s[i] for i in at)
                out[k] = out.get(k, 0) + tx.DECAY ** (at[3] - at[0] - 3)
        return out

    def size(word):
        at = [c for c in combinations(range(len(word) + 2), 4) if c[3] - c[0] <= tx.SPAN]
        return sum(tx.DECAY ** (2 * (c[3] - c[0] - 3)) for c in at) ** 0.5

    short = ["aa" if w == "aaaa" else w for w in words]  # runs of a letter are cut to two
    for i, a in enumerate(short):
        for j, b in enumerate(short):
            wa, wb = weights(a), weights(b)
            want = sum(v * wb.get(k, 0) for k, v in wa.items()) / size(a) / size(b)
            assert abs(got[i, j] - want) < 1e-5


def test_words_and_spelled_out_letters():
    letters, starts, firsts = tx.words_of(["I.d.I-0.t a b", "", "ê$$ c", "d e", "aaaaab", "id iot you", "ó x word"])
    words = ["".join(chr(96 + c) for c in letters[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    own = lambda i: chr(96 + 27 + i)
    assert words == ["idiot", "ab", own(2) + "c", "de", "aab", "id", "idiot", "iot", "you", own(7) + "x", own(7) + "xword", "word"]
    assert firsts.tolist() == [0, 2, 2, 3, 4, 5, 9, 12]


def test_scores_equal_a_machine_by_definition():
    model = tx.fit([(_bag(t), y) for t, y in _texts(4, 400)])
    texts = ["the zwofflik ou prumbast", "", "an", "zw offlik kqeldor kqeldor erst", "ingone tent al"]

    def score(word):
        s, total, norm = [0, *word, 0], 0.0, 0.0
        for at in combinations(range(len(s)), 4):
            if at[3] - at[0] <= tx.SPAN:
                a, b, c, d = (s[i] for i in at)
                total += tx.DECAY ** (at[3] - at[0] - 3) * model.table[((a * tx.CLASSES + b) * tx.CLASSES + c) * tx.CLASSES + d]
                norm += tx.DECAY ** (2 * (at[3] - at[0] - 3))
        return total / max(norm, 1e-9) ** 0.5

    for text, got, p in zip(texts, model.worst(texts), model.score(texts), strict=True):
        assert abs(p - plain_score(model, text)) < 1e-3
        letters, starts, _ = tx.words_of([text])
        best = sorted({score(letters[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)}, reverse=True)[: tx.WORST]
        want = [max(x, 0) ** 2 for x in best] + [0.0] * (tx.WORST - len(best))
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy_and_tolerance():
    model = tx.fit([(_bag(t), y) for t, y in _texts(1, 600)])
    test = _texts(2, 400)
    score = model.score([t for t, _ in test])
    assert (((score >= tx.THRESHOLD) == [y for _, y in test]).mean()) > 0.98
    odd = ["the zwofflik an", "the z.w.o.f.f.l.i.k an", "the z w o f f l i k an", "the zw offlik an", "the zwof*flik an", "the ZWOFFFLIK an"]
    assert (model.score(odd) >= tx.THRESHOLD).all()
    # One letter put in anywhere, or written twice, changes nothing.
    for word in INSULTS:
        plain = model.score([f"the {word} an"])[0]
        put_in = [f"the {word[:i]}{c}{word[i:]} an" for i in range(1, len(word)) for c in "xzv" + word[i]]
        assert plain >= tx.THRESHOLD and np.allclose(model.score(put_in), plain, atol=1e-6)
        assert model.score([f"the {word[:3]}xz{word[3:]} an", f"the {word[:3]}therein an"]).max() < plain
    assert model.tolerance.insults >= {_bag(w)[:-1] for w in INSULTS}
    assert (model.score(["", " \n"]) < 0.5).all()


def test_words_of_clean_texts_are_exempt():
    """A word that clean texts have is not an insult for a letter too many."""
    texts = _texts(1, 600) + [("a prumbasto here", 0)] * 3
    model = tx.fit([(_bag(t), y) for t, y in texts])
    clean, put_in = model.score(["the prumbasto an", "the prumxbast an"])
    assert put_in >= tx.THRESHOLD > clean
    row, edges = _spell(["prumxbast"])
    own = tx.word_scores(row, edges, model.table)
    assert tx.tolerant_scores(row, edges, model.table, model.tolerance) > own
    exempt = tx.Tolerance(model.tolerance.insults, frozenset([_bag("prumxbast")[:-1]]))
    assert tx.tolerant_scores(row, edges, model.table, exempt) == own


def test_shortened_words():
    row, edges = _spell(["abbc", "ab"])
    views, view_edges, of = tx._shortened(row, edges, np.array([0, 1]))
    words = ["".join(chr(96 + c) for c in views[a + 1 : b - 1]) for a, b in zip(view_edges, view_edges[1:], strict=False)]
    assert list(zip(of.tolist(), words, strict=True)) == [(0, "bbc"), (0, "abc"), (0, "abb"), (1, "b"), (1, "a")]


def plain_score(model, text):
    """A text's score word by word, by the definitions."""

    def machine(word):
        s, total, norm = [0, *word, 0], 0.0, 0.0
        for i in range(len(s) - 3):
            for x, y, z in combinations(range(i + 1, min(len(s), i + tx.SPAN + 1)), 3):
                total += tx.DECAY ** (z - i - 3) * model.table[((s[i] * tx.CLASSES + s[x]) * tx.CLASSES + s[y]) * tx.CLASSES + s[z]]
                norm += tx.DECAY ** (2 * (z - i - 3))
        return total / max(norm, 1e-9) ** 0.5

    def score(word):
        own = machine(word)
        if own < tx.NEAR or len(word) - 1 < tx.REST or bytes(word) in model.tolerance.exempt:
            return own
        views = [word[:i] + word[i + 1 :] for i in range(len(word))]
        return max([own, *(machine(v) for v in views if bytes(v) in model.tolerance.insults)])

    letters, starts, _ = tx.words_of([text])
    words = {tuple(letters[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)}
    best = sorted((score(w) for w in words), reverse=True)[: tx.WORST]
    want = [max(x, 0) ** 2 for x in best] + [0.0] * (tx.WORST - len(best))
    p = model.floor + (1 - model.floor - model.chance) / (1 + np.exp(-(np.dot(want, model.slope) + model.shift)))
    return 1 / (1 + (1 - p) / p * np.exp(-model.moved))


def test_query_against_definitions(spark):
    """Scores of the query on the smallest given table, word by word."""
    from quarry.llm import queries

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = tx.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect() if len(r.text or "") < 4000}
    got = {r.doc_id: r.score for r in queries.op1_toxicity(spark, data).collect()}
    for i, text in texts.items():
        assert abs(got[i] - plain_score(model, text)) < 1e-3, i


def test_one_class_or_nothing():
    assert (tx.fit([]).score(["a b"]) < 0.5).all()
    assert (tx.fit([(b"\1\2\0", 0)]).score(["a b"]) < 0.5).all()
    assert (tx.fit([(b"\1\2\0", 1)]).score(["a b"]) > 0.5).all()
    assert len(tx.fit([(b"", 1), (b"", 0), (b"\1\2\0", 0)]).score([""])) == 1


def test_documents(spark):
    texts = _texts(3, 300)
    rows = [(i, t, "x") for i, (t, _) in enumerate(texts)] + [(None, "a", "x"), (900, None, "x"), (901, "", "x"), (1, texts[1][0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (5000, 0)], "doc_id long, toxic int")
    model = tx.train(docs, labels, per_class=100)
    got = tx.toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= tx.THRESHOLD) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.97
    assert tx.toxicity(docs.limit(0), tx.train(docs.limit(0), labels)).count() == 0


GIVEN = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the given tables")
def test_held_out_labels_of_the_given_table(spark):
    docs, labels = spark.read.parquet(f"{GIVEN}/documents.parquet"), spark.read.parquet(f"{GIVEN}/labels.parquet")
    scored = tx.toxicity(docs, tx.train(docs, labels)).join(labels, "doc_id").where(tx.is_held_out(tx.F.col("doc_id")))
    rows = scored.join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = [r for r in rows if r.score >= tx.THRESHOLD]
    toxic = [r for r in rows if r.toxic]
    assert sum(r.toxic for r in found) >= 0.95 * len(found)
    for lang, least in (("en", 0.85), ("de", 0.8), ("fr", 0.9), ("es", 0.8)):
        own = [r for r in toxic if r.lang == lang]
        assert sum(r.score >= tx.THRESHOLD for r in own) >= least * len(own), lang
    assert sum(r.score >= tx.THRESHOLD for r in toxic) >= 0.88 * len(toxic)
