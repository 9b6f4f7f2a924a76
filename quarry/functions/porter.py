"""Porter's stemmer, as published in 1980, with the customary amendments: short
words stay, ``-ies`` of a four-letter word gives ``-ie``, and final y becomes i
after a consonant that is not the first letter."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiou"
#: Endings and what takes their place, longest first where one ends another
#: (fixed values of the published algorithm).
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


#: Words that go their own way (fixed values of the customary amendments).
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def _consonant(w: str, i: int) -> bool:
    if w[i] == "y":
        return i == 0 or not _consonant(w, i - 1)
    return w[i] not in _VOWELS


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _closed(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or vowel, consonant."""
    n = len(w)
    if n == 2:
        return not _consonant(w, 0) and _consonant(w, 1)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-2] if w.endswith("sses") else w if w.endswith("ss") else w.removesuffix("s")


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end) and _has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w):
                return w if w[-1] in "lsz" else w[:-1]
            return w + "e" if _measure(w) == 1 and _closed(w) else w
    return w


def _replaced(w: str, table: tuple) -> str:
    """The longest ending of the table that fits, where its stem is long enough."""
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(end):
            stem = w[: -len(end)] + ("l" if end == "logi" else "")
            return w[: -len(end)] + new if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    w = _replaced(_replaced(w, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _closed(stem)):
            w = stem
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w[:-1]) > 1 else w
