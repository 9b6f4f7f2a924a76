"""Counts against plain Python; the model on made-up votes."""

import random
import re
from collections import Counter

from quarry.llm import quality


def brute(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    gone = [False] * len(words)
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            gone[i : i + 8] = [True] * 8
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(gone)


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a\n\n a\na\x0b\na", "x#|<> é$", "one two " * 30, "w " * 7, "w " * 8, "w " * 9, "\x1c\x85\xa0 x", "f\nf\nff\nff\nabc", "\f\n\f\nabc", "f f\nf f", "\v\n\v\f \r\n\t", "fv\nfv\ntr\ntr"]
    texts += [" ".join(rng.choices(["a", "b", "c\n", "\n", "é#"], k=rng.randint(0, 80))) for _ in range(60)]
    texts += ["".join(rng.choices("ftrvn \f\t\r\v\n\n", k=rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)] + [(None, "a", "k", 1)], "doc_id long, text string, key string, n_words int")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert len(got) == len(texts) + 1
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_model_finds_the_faulty():
    # Good texts rarely draw a vote against them, bad ones often draw several.
    rng, counts = random.Random(1), Counter()
    for _ in range(5000):
        bad = rng.random() < 0.1
        counts[tuple(-1 if rng.random() < (0.6 if bad else 0.003) else 0 for _ in range(5)) + (0 if bad or rng.random() < 0.1 else 1,)] += 1
    prior, odds = quality.fit(sorted(counts.items()))
    assert 0.8 < prior < 0.95
    assert all(w[-1] < -2 for w in odds[:5]) and odds[5][1] > 0
    assert quality.fit([])[1] == []


def test_plain_text_stays(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choices("the of and to in is that house man water long way".split(), k=80)) + "." for _ in range(100)]
    junk = [re.sub(" ", "### ", p) for p in plain[:10]] + [p.upper().replace(" ", "!! ") for p in plain[10:20]]
    df = spark.createDataFrame(list(enumerate(plain + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.quality_rules(df).where("kept").collect()}
    assert set(range(100)) <= kept and len(kept) <= 102


def test_good_documents_keep_every_column(spark):
    text = "the of and to in is that house man water long way with nothing else but plain words in it for this test of rows"
    df = spark.createDataFrame([(1, text, 4, "x"), (1, text, 5, "y"), (2, "short", 6, None), (None, text, 7, None)], "doc_id long, text string, _key int, row string")
    got = quality.good_documents(df)
    assert got.columns == df.columns
    assert sorted((r[2], r[3] or "") for r in got.collect()) == [(4, "x"), (5, "y"), (7, "")]
