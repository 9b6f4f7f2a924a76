"""Personal data: base patterns, and boosted candidates beside them.

The base patterns are exact and always kept.  Beyond them, generators with
high recall propose spans that may overlap (written-out addresses, numbers in
national form, keyed secrets, long mixed tokens); boosted trees judge each by
its format and context, a calibrated threshold per kind selects, and of
selected spans that overlap the likeliest stays.  The trees are trained here,
on sentences made up from templates with a fixed seed, as no labels exist; other
templates, harder ones, calibrate them and set the thresholds.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import carried, doc_rows, slices, with_text

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "id"]
#: Share of personal data among the candidates of a kind that are taken, on
#: sentences of templates the trees have not seen: the least calibrated probability
#: from which it holds, and that so many such candidates reach, is the kind's
#: threshold, never below one half.  A kind without one adds nothing.
PRECISION, LEAST, LEAST_CASES, NEVER = 0.98, 0.5, 20, 2.0
#: Made-up sentences that the trees are fitted on, and as many that calibrate.
SENTENCES = 6000

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_ANY = re.compile(r"[0-9@]|[\[({] ?(?i:at) ?[\])}]|(?i:passw|secret|token|key)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @; its local part is the run of characters before
    it, as far left as the match before allows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m, start = _DOMAIN.match(text, at + 1), at
        if m:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _DIGIT.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                out.append((four[0][0], four[3][1]))
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    out += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


#: A written-out address from its "at" on.
_AT = re.compile(r" ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?(?i:dot) ?[\])}]) ?[A-Za-z0-9-]++)++")
_EDGE = re.compile(r"\b")


def _written(text: str) -> list[tuple[int, int]]:
    """Written-out addresses: the local part is the run of characters before
    the "at", from its first word edge, as far left as the match before allows."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        edge = _EDGE.search(text, start)
        if edge and edge.start() < m.start():
            out.append((edge.start(), m.end()))
            free = m.end()
    return out


#: High-recall generators beside it: kind and pattern; the span is group 1.
#: No run is cut: what is proposed is whole, however long.
GENERATORS = [
    ("phone", re.compile(r"(?<![\w.+])((?:\(\d{2,5}\)[ -]?|\d{2,5}[ -./])\d{2,5}(?:[ ./-]\d{2,5}){0,4})(?![\w.]\d|\w)", re.ASCII)),
    ("card", re.compile(r"(?<![\w.])(\d{4}[ .-]\d{4,6}[ .-]\d{4,5}(?:[ .-]\d{1,4})?)(?!\w)", re.ASCII)),
    ("id", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])", re.ASCII)),
    ("id", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b", re.ASCII)),
    ("secret", re.compile(r"(?i:passw(?:or)?d|passwd|secret|token|api[_-]?key|access[_-]?key|key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"']{6,}+)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])([A-Za-z0-9_/+-]{16,}+)")),
]
_KEYED = [
    re.compile(p)
    for p in (
        r"(?i)(?:tel|phone|call|fax|mobile|cell|number)\W{0,4}$",
        r"(?i)(?:passw(?:or)?d|passwd|secret|token|key)[\"']?\s*[=:]\s*[\"']?$",
        r"(?i)(?:ssn|social security|iban|account|passport)\W{0,4}(?:no\W{0,2}|number\W{0,2})?$",
        r"(?i)(?:mail|contact|write|reach)\W{0,4}(?:to|me|us)?\W{0,2}$",
        r"(?i)(?:card|visa|credit)\W{0,4}(?:no\W{0,2}|number\W{0,2})?$",
        r"(?i)(?:version|pages?|isbn|chapter|section|year|in|fig(?:ure)?|table|order|item|serial|part|lines?)\W{0,3}(?:no\W{0,2})?$",
        r"(?i)(?:eur|usd|\$|€|£)\s?$",
    )
]
N_FEATURES = 26


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _written(text)]
    for kind, pattern in GENERATORS:
        out += [(kind, *m.span(1)) for m in pattern.finditer(text)]
    return list(dict.fromkeys(out))


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    span, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 4]
    digits = _digits(span)
    n = len(span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    groups = _DIGIT.findall(span)
    upper, lower = sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:], strict=False))
    return [
        *(float(kind == k) for k in KINDS),
        float(n),
        float(len(digits)),
        upper / n,
        lower / n,
        len(digits) / n,
        entropy,
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        turns / n,
        float(bool(digits) and luhn(digits)),
        float(span[:1] == "("),
        float(span.count("-")),
        float(after[:1] in "%€$" and bool(after[:1])),
        *(float(bool(k.search(before))) for k in _KEYED),
    ]


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(["the", "on", "er", "in", "an", "re", "ent", "und", "ción", "eau", "st", "ing"]) for _ in range(rng.randint(1, 4)))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choices(string.digits, k=n - 1))


def _made_up(rng: random.Random) -> tuple[str, str, str, bool]:
    """Text before an item, the item, text after it, whether it is personal."""
    name = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9)))
    host = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9)))
    end = rng.choice(["com", "org", "net", "de", "fr", "es"])
    hexa = "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 18, 20, 24, 32, 40, 64])))
    mixed = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(16, 44)))
    d = lambda n: _number(rng, n)
    plain = rng.choice(["", "", _word(rng) + " "])
    choice = rng.randrange(26)
    if choice == 0:
        return plain, f"{name} [at] {host} [dot] {end}", "", True
    if choice == 1:
        return rng.choice(["mail to ", "contact ", ""]), f"{name}.{d(2)}(at){host}.{end}", "", True
    if choice == 2:
        return rng.choice(["call ", "tel. ", "phone: ", "mobile ", ""]), f"({d(3)}) 555-{d(4)}", "", True
    if choice == 3:
        return rng.choice(["call ", "tel. ", "phone: ", "fax "]), rng.choice([f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(5)}"]), "", True
    if choice == 4:
        return rng.choice(["password=", "passwd: ", 'token = "', "secret=", 'api_key: "', "key="]), rng.choice([hexa, mixed, "A9!" + mixed[:8]]), rng.choice(['"', ""]), True
    if choice == 5:
        return plain, "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)), "", True
    if choice == 6:
        return rng.choice(["", "ssn ", "SSN: ", "social security number "]), f"{d(3)}-{d(2)}-{d(4)}", "", True
    if choice == 7:
        return rng.choice(["iban ", "account ", ""]), f"{rng.choice(['DE', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", "", True
    if choice == 8:
        return rng.choice(["card ", "visa "]), f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", "", True
    if choice == 9:
        return plain, mixed[:8] + d(4) + mixed[8:] + d(2), "", True
    if choice == 10:
        return plain, f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", "", False
    if choice == 11:
        return plain, f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 31)}", "", False
    if choice == 12:
        return rng.choice(["version ", "", "section "]), f"{d(2)}.{d(2)}.{d(2)}", "", False
    if choice == 13:
        return rng.choice(["pages ", "in ", ""]), f"{d(2)}-{d(3)}", "", False
    if choice == 14:
        return rng.choice(["$", "EUR ", "€"]), f"{d(3)}.{d(3)}.{d(3)}", rng.choice(["", "€"]), False
    if choice == 15:
        return rng.choice(["isbn ", "ISBN: ", "chapter ", "part no. ", "order "]), f"{d(3)}-{d(2)}-{d(4)}", "", False
    if choice == 16:
        return plain, "".join(_word(rng) for _ in range(8)).replace("ó", "o"), "", False
    if choice == 17:
        return plain, "-".join(_word(rng).replace("ó", "o") for _ in range(5)), "", False
    if choice == 18:
        return rng.choice(["key: ", "token: ", "secret: ", "key="]), _word(rng) + _word(rng) + "ing", "", False
    if choice == 19:
        return plain, "/".join(_word(rng).replace("ó", "o") for _ in range(5)) + rng.choice(["", d(1), "." + d(2)]), "", False
    if choice == 20:
        return rng.choice(["order ", "item ", "no. ", ""]), f"{d(4)}-{d(2)}", "", False
    if choice == 21:
        return plain, "".join(rng.choices("=-_+", k=1)) * rng.randint(16, 40), "", False
    if choice == 22:
        return plain, "".join(rng.choices(string.ascii_uppercase, k=rng.randint(16, 30))), "", False
    if choice == 23:
        return plain, d(rng.randint(8, 24)), "", False
    if choice == 24:
        return plain, rng.choice("/_-").join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(rng.randint(3, 6))) + rng.choice(["", d(1), d(2), d(3)]), "", False
    return plain, f"{d(2)}.{d(2)}.{rng.randint(1900, 2030)}", "", False


def _unseen(rng: random.Random, part: int) -> tuple[str, str, str, bool]:
    """The same from templates that no tree is fitted on: of two parts, one
    calibrates and the other is for tests."""
    d = lambda n: _number(rng, n)
    low = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    name, host, end = low(rng.randint(4, 9)), low(rng.randint(4, 9)), rng.choice(["com", "org", "net", "edu", "info"])
    choice = rng.randrange(15)
    if choice == 0:
        return ["ask ", "write "][part], [f"{name}{{at}}{host}{{dot}}{end}", f"{name}_{low(4)} [AT] {host} [DOT] {end}"][part], "", True
    if choice == 1:
        return ["my mobile: ", "number "][part], [f"{d(4)}-{d(6)}", f"({d(4)}) {d(3)}-{d(4)}"][part], "", True
    if choice == 2:
        return ["tel ", "phone "][part], [f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"][part], "", True
    if choice == 3:
        return ["between ", "about "][part], [f"{d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}"][part], [" people", " km"][part], False
    if choice == 4:
        return ["ratio ", "lines "][part], [f"{d(3)}/{d(3)}", f"{d(4)}-{d(4)}"][part], "", False
    if choice == 5:
        return ["on ", "since "][part], [f"{rng.randint(10, 31)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)}", f"{rng.randint(10, 12)}-{rng.randint(10, 31)}-{rng.randint(1900, 2030)}"][part], "", False
    if choice == 6:
        return ["credit card ", "card no. "][part], [f"{d(4)} {d(6)} {d(5)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"][part], "", True
    if choice == 7:
        return ["serial ", "item "][part], [f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}"][part], "", False
    if choice == 8:
        return ["social security no. ", "SSN: "][part], f"{d(3)}-{d(2)}-{d(4)}", "", True
    if choice == 9:
        return ["figure ", "table "][part], f"{d(3)}-{d(2)}-{d(4)}", "", False
    if choice == 10:
        return ["PASSWORD = ", "access_key='"][part], [mixed(rng.randint(12, 30)), hexa(rng.choice([24, 32, 48])) + "'"][part].rstrip("'"), ["", "'"][part], True
    if choice == 11:
        return ["secret = ", "token: "][part], [hexa(rng.choice([20, 40])), mixed(rng.randint(20, 40))][part], "", True
    if choice == 12:
        return ["see ", "file "][part], ["_".join(low(rng.randint(3, 7)) for _ in range(4)), "/".join(low(rng.randint(3, 7)) for _ in range(4)) + d(2)][part], "", False
    if choice == 14:
        return ["ref ", "number "][part], [d(rng.randint(16, 22)), d(rng.randint(8, 18))][part], "", False
    return ["the key: ", "a token: "][part], ["".join(_word(rng) for _ in range(3)), "".join(_word(rng) for _ in range(2))][part].replace("ó", "o"), "", False


@dataclass
class Judge:
    """Calibrated trees, and from which probability each kind is taken."""

    trees: boosting.Boosted
    thresholds: dict[str, float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.trees.predict(x)


def made_up(seed: int, sentences: int, part: int | None = None) -> tuple[list[list[float]], list[str], list[bool]]:
    """Candidates of made-up sentences (of a ``part`` of the unseen templates, or
    of those for fitting): their features, kinds, and whether each is a whole item
    of personal data."""
    rng, rows, kinds, truth = random.Random(seed), [], [], []
    for _ in range(sentences):
        lead = " ".join(_word(rng) for _ in range(rng.randint(0, 5)))
        before, item, after, personal = _made_up(rng) if part is None else _unseen(rng, part)
        front = f"{lead} {before}" if lead else before
        text = f"{front}{item}{after} {_word(rng)}."
        for kind, a, b in candidates(text):
            if a < len(front) + len(item) and b > len(front):
                rows.append(describe(text, kind, a, b))
                kinds.append(kind)
                truth.append(personal and a <= len(front) + 1 and b >= len(front) + len(item) - 1)
    return rows, kinds, truth


def threshold(chance: np.ndarray, truth: np.ndarray) -> float:
    """The least probability from which the precision holds, on enough cases."""
    levels = [p for p in np.unique(chance) if p >= LEAST and (chance >= p).sum() >= LEAST_CASES and truth[chance >= p].mean() >= PRECISION]
    return float(min(levels, default=NEVER))


@lru_cache(maxsize=1)
def judge() -> Judge:
    """The fitted, calibrated trees; the same every time."""
    rows, _, truth = made_up(11, SENTENCES)
    more, kinds, known = made_up(12, SENTENCES, 0)
    x, y = np.array(rows + more), np.array(truth + known)
    held = np.arange(len(x)) >= len(rows)
    trees = boosting.fit(x, y, held)
    chance, of = trees.predict(x[held]), np.array(kinds)
    return Judge(trees, {k: threshold(chance[of == k], y[held][of == k]) for k in KINDS})


def _united(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, rising."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a span overlaps one of rising stretches that do not overlap."""
    at = bisect_left(starts, b) - 1
    return at >= 0 and ends[at] > a


def find(texts: list[str], model: Judge) -> list[tuple[list, list]]:
    """Base spans, and spans added by the model, of each text."""
    out, rows, where = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if _ANY.search(text) else []
        out.append((base, []))
        if not _ANY.search(text):
            continue
        covered = _united([(a, b) for _, a, b in base])
        for kind, a, b in candidates(text):
            if not _meets(*covered, a, b):
                rows.append(describe(text, kind, a, b))
                where.append((i, kind, a, b))
    if rows:
        chance = model.predict(np.array(rows))
        order = sorted(range(len(rows)), key=lambda k: (-chance[k], where[k]))
        taken: dict[int, tuple[list[int], list[int]]] = {}
        for k in order:
            i, kind, a, b = where[k]
            if chance[k] >= model.thresholds[kind]:
                starts, ends = taken.setdefault(i, ([], []))
                if not _meets(starts, ends, a, b):
                    at = bisect_left(starts, a)
                    starts.insert(at, a)
                    ends.insert(at, b)
                    out[i][1].append((kind, a, b))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the first one's kind in angle
    brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = "struct<kind: string, first: long, end: long>"


def personal_data(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``added`` spans (code points, end
    exclusive, by kind as listed, then start), ``redacted`` text.

    A map over rows.  Null and empty texts have no spans; equal texts have
    equal spans; texts of any length are read whole; extra columns fall away
    unless carried; an empty table gives an empty result.
    """
    model = judge()
    rows = doc_rows(docs, carry)
    row, row_schema = carried(rows)
    whole_row = [row] if row else []
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def rows_of(spans: list) -> list[dict]:
        return [{"kind": k, "first": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = batch.column("text").to_pylist()
                found = find(texts, model)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([rows_of(in_order(b)) for b, _ in found], kind),
                        pa.array([rows_of(in_order(m)) for _, m in found], kind),
                        pa.array([redact(t, b + m) for t, (b, m) in zip(texts, found, strict=True)], pa.string()),
                        *(batch.column(c) for c in whole_row),
                    ],
                    names=["doc_id", "base", "added", "redacted", *whole_row],
                )

    return rows.mapInArrow(run, f"doc_id long, base array<{SPAN}>, added array<{SPAN}>, redacted string{row_schema}")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans in their texts replaced."""
    return with_text(personal_data(docs, carry=True), docs, "redacted")
