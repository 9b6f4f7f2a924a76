"""The audit against filtering in every order, document by document."""

import re
from itertools import permutations

from quarry.llm import interactions as ia


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    last = (1 << 63) - 1
    own = last if doc_id is None else doc_id
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": any((t or "") == text and (last if i is None else i) < own for i, t, _ in rows),
    }


def brute(rows, labels):
    known = {}
    for i, q, t in labels:
        if i is not None:
            a, b = known.get(i, (False, False))
            known[i] = (a or q == 1, b or t == 1)
    judged = [(lang or "", fails(text or "", i, rows), known.get(i, (False, False))) for i, text, lang in rows]
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(f, y) for p, f, y in judged if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(f, y) for f, y in left if f[name]]
                left = [(f, y) for f, y in left if not f[name]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[name] for f, _ in own) - len(gone), sum(f[name] and sum(f.values()) == 1 for f, _ in own),
                    sum(y[0] for _, y in gone), sum(y[1] for _, y in gone),
                ]
        for name in "ABCDE":
            steps = [k for k in out if k[0] == part and k[1][k[2] - 1] == name]
            total = sum(out[k][1] for k in steps)
            for k in steps:
                out[k].append(total)
    return out


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, part int, n int, applied int").repartition(3)
    found = ia.interaction_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in found}


def test_every_order(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(i, long + " x", "en") for i in range(40)]  # a hot text
    rows += [(100, None, "de"), (101, "", "de"), (102, "", None), (103, None, ""), (104, "A B C #", "fr"), (104, "A B C #", "fr"), (104, "A B C #", "en")]
    rows += [(None, "A B C #", "fr"), (None, long, "fr"), (None, long, "es"), (None, long, "es"), (1, "A " * 200, "es"), (2, long.upper() + "$", "es")]
    rows += [(3, "\x0b".join(f"é{i}\x85ß" for i in range(100)), "es"), (5, "w " * 99 + "|", "es"), (6, long, "only"), (7, long.replace("w", "É"), "only")]
    labels = [(0, 1, 0), (1, 0, 1), (104, 1, 1), (2, None, 1), (2, 1, None), (None, 1, 1), (999, 1, 1), (100, 0, 0), (39, 1, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_no_rows(spark):
    assert got(spark, [], []) == {}
    assert got(spark, [(1, None, None)], []) == brute([(1, None, None)], [])


def test_long_texts_in_pieces(monkeypatch):
    text = "Ab cd #x\n" * 50 + "y" * 90 + " z"
    whole = ia.failures(text.encode())
    for size in (7, 16, 40):
        monkeypatch.setattr(ia, "PIECE", size)
        assert b"".join(ia._pieces(text.encode())) == text.encode()
        assert ia.failures(text.encode()) == whole
