"""Counts of many terms in one pass of each text, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _automaton(terms: list[str]):
    """All terms in one automaton, each with its place in the list and length."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        machine.add_word(t, (i, len(t)))
    machine.make_automaton()
    return machine


def counts_in(machine, text: str) -> dict[int, int]:
    """How often each term occurs; occurrences of one term do not overlap, the
    leftmost counts."""
    found: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (i, size) in machine.iter(text):
        if end - size >= free.get(i, -1):
            free[i] = end
            found[i] = found.get(i, 0) + 1
    return found


def substring_counts(docs: DataFrame, keys: list[str], text: Column, terms: list[str], every: bool = False) -> DataFrame:
    """``(keys, term, count)`` for each of the terms that occurs in a text (with
    ``every`` for all of them, also of empty texts).

    A text is read once whatever the number of terms; the automaton is made in
    each task from the list of terms, which travels with the plan.  Empty terms
    and repeated ones do not count; null and empty texts hold no
    term; rows that repeat give theirs each.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    known = [t for t in dict.fromkeys(terms) if t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(known) if known else None
        for batch in batches:
            rows: list[int] = []
            which: list[int] = []
            counts: list[int] = []
            for n, body in enumerate(batch.column(len(keys))):
                found = counts_in(machine, body.as_py()) if machine is not None and body.is_valid else {}
                if every:
                    found = {i: found.get(i, 0) for i in range(len(known))}
                rows += [n] * len(found)
                which += found.keys()
                counts += found.values()
            own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            words = pa.array(known, pa.string()).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own, words, pa.array(counts, pa.int64())], names=[*keys, "term", "count"])

    return docs.select(*keys, text.alias("_text")).mapInArrow(run, f"{kinds}, term string, count long")
