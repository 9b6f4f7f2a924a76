"""Base patterns against their plain definitions; added spans; boosting."""

import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import boosting, pii


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group())):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aB@@..+-19 0(é%", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_added_spans_and_clean_text():
    texts = [
        "write to jo.do [at] mail [dot] org now",
        "call (030) 555-1234 today",
        "password=f8cb0ab732d29a210e next",
        "mail a.b@c.example.com or +1 (456) 555-2186, 10.0.0.1",
        "In 1999-2003, version 2.0.1, pages 10-245, on 2024-05-12 it cost $ 123.456.789. BY-NC 4.0.",
        "therendertionhethininganwhereofthe und-die-der-ein-eine-und",
        "",
    ]
    found = pii.find(texts, pii.judge())
    kinds = [[k for k, _, _ in b + m] for b, m in found]
    assert kinds == [["email"], ["phone"], ["secret"], ["email", "ip", "phone"], [], [], []]
    base, added = found[3]
    assert pii.redact(texts[3], base + added) == "mail <EMAIL> or <PHONE>, <IP>"


def test_long_runs_stay_linear():
    for text in ("9" * 60000, "a" * 60000 + "@", "1." * 30000, "+1" + " " * 60000, "a-" * 30000):
        pii.find([text], pii.judge())


def test_boosting_calibrates():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    model = boosting.fit(x, y, np.arange(3000) % 4 == 0)
    test = rng.random((1000, 4))
    want = (test[:, 0] > 0.5) ^ (test[:, 1] > 0.5)
    assert ((model.predict(test) > 0.5) == want).mean() > 0.97
    assert (np.diff(model.chance) >= 0).all()


def test_documents(spark):
    rows = [(1, "a@b.co"), (2, None), (3, ""), (None, "a@b.co"), (1, "a@b.co"), (4, "é " * 50000 + "a@b.co")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    got = pii.personal_data(df).collect()
    spans = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in got)
    one = [("email", 0, 6)]
    assert spans == [("1", one), ("1", one), ("2", []), ("3", []), ("4", [("email", 100000, 100006)]), ("None", one)]
    assert {r.redacted for r in got if r.doc_id == 1} == {"<EMAIL>"}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_added_spans_hold_on_new_sentences():
    """Fitted templates with new values, those that calibrated, and templates that
    nothing was fitted to."""
    model = pii.judge()
    for part, precision, recall in ((None, 0.98, 0.98), (0, 0.98, 0.95), (1, 0.85, 0.95)):
        rows, kinds, truth = pii.made_up(99, 3000, part)
        y = np.array(truth)
        taken = model.predict(np.array(rows)) >= np.array([model.thresholds[k] for k in kinds])
        assert y[taken].mean() >= precision and taken[y].mean() >= recall
    assert set(model.thresholds) == set(pii.KINDS)
    assert len(set(model.thresholds.values())) >= 3 and all(pii.LEAST <= t <= 1 or t == pii.NEVER for t in model.thresholds.values())


def test_thresholds():
    chance, truth = np.repeat([0.1, 0.6, 0.9], 30), np.repeat([False, True, True], 30)
    assert pii.threshold(chance, truth) == 0.6
    truth[40:] = False
    assert pii.threshold(chance, truth) == pii.NEVER
    assert pii.threshold(np.zeros(0), np.zeros(0, bool)) == pii.threshold(chance[60:70], ~truth[60:70]) == pii.NEVER


def test_spans_in_given_documents(spark):
    """What is added in the given texts is keyed secrets and numbers, nothing of
    the prose; of overlapping candidates the likeliest stays, by all pairs."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model = pii.judge()
    for text, (base, added) in zip(texts, pii.find(texts, model), strict=True):
        assert all(re.search(r"(?i)(token|secret|key|passw)\W*$", text[:a]) for k, a, _ in added if k == "secret")
        rows = [c for c in pii.candidates(text) if not any(c[1] < y and x < c[2] for _, x, y in base)]
        chance = model.predict(np.array([pii.describe(text, *c) for c in rows])) if rows else []
        kept = []
        for p, c in sorted(zip(chance, rows, strict=True), key=lambda x: (-x[0], x[1])):
            if p >= model.thresholds[c[0]] and not any(c[1] < y and x < c[2] for _, x, y in kept):
                kept.append(c)
        assert sorted(kept) == sorted(added)


def test_thousands_of_spans():
    parts = [f"a{i}@b.co and +1 {i % 10}55 {1000000 + i} or (030) 555-{1000 + i % 9000}" for i in range(8000)]
    began = time.process_time()
    ((base, added),) = pii.find([" ".join(parts)], pii.judge())
    assert time.process_time() - began < 10 and len(base) >= 8000
    spans = sorted((a, b) for _, a, b in added)
    assert all(b <= a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
