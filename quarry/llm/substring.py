"""Substring removal: words in long stretches that other documents had first.

The contents of some anchors are a reference shard.  They build a suffix
automaton in document order, whose states know the first content that has their
substrings; the contents then stream through it, and where the matching
statistics reach the window length, the window occurs first in that content.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .repeats import Shard, Windows, covered, without_repeated

WORDS = 50
GRAM = 10
#: Contexts of one anchor beyond which its windows are contents of their own.
MOST = 4_000
#: Bytes of contents in one automaton, about; an anchor's stay together.
PART = 1 << 18


def first_contents(shard: Shard, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The content where each window of each content occurs first.  The place
    in it does not matter here: documents are compared alone."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in body.split(b" ")] for body in shard.bodies]
    automaton = SuffixAutomaton()
    for i, sequence in enumerate(sequences):
        automaton.add(sequence, i)
    out = []
    for sequence in sequences:
        size, first = automaton.matches(sequence, spec.length)
        if min(size[spec.length - 1 :]) < spec.length:
            raise AssertionError("a content is not in its own shard's automaton")
        out.append(np.array(first[spec.length - 1 :]))
    windows = np.array([len(o) for o in out])
    return np.concatenate(out), np.concatenate([np.arange(n) for n in windows.tolist()]), windows


def remove_repeated_words(docs: DataFrame, words: int = WORDS, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (text).

    A word goes if one of the windows of ``words`` words over it starts in a
    document with a smaller id as well.  Documents with the same id are one
    document for this; rows without an id come last and are one document.  Null
    and empty texts have no words; texts of any length are read whole; extra
    columns are ignored; an empty table gives an empty result.  Texts are judged
    as they came in, and windows are compared word by word, not by hashes.
    """
    spec = Windows(words, gram, words=True, within=False, most=MOST)

    def cut(text: str, found: bytes | None) -> tuple:
        split = text.encode().split()
        if not found:
            return len(split), 0, b" ".join(split)
        gone = covered(found, len(split), words)
        return len(split), int(gone.sum()), b" ".join(compress(split, (~gone).tolist()))

    done = without_repeated(docs, spec, first_contents, PART, cut, "n_words long, n_removed long, kept binary", buckets)
    return done.withColumn("kept", F.decode("kept", "UTF-8"))
