"""Quality rules as weak supervision, on DataFrame expressions alone.

Each rule is a labelling function that votes 1 (keep), -1 (reject) or 0
(abstain).  Expectation maximisation over the counts of distinct vote vectors
estimates how far each rule can be trusted, and a document's verdict is its
posterior probability of being good rather than "passed every rule".

Nulls: a null text has no words and is rejected by the base rule.  Words are
runs of anything but the six ASCII white-space characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, keyed_rows, row_key, same_row, staged

WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_distinct", "n_stops"]
#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "der", "die", "und", "den", "von", "das", "ist", "nicht", "ein", "eine",
    "le", "la", "les", "des", "et", "un", "une", "que", "pour", "est",
    "el", "los", "las", "de", "y", "en", "por", "una", "con", "se",
]


def features(docs: DataFrame) -> DataFrame:
    """Counts of every whole text: the base columns and what the rules need."""
    words = F.filter(F.split("text", SPACE), lambda w: w != F.lit(""))
    d = doc_rows(docs).select("doc_id", "text", words.alias("_w"), row_key().alias("key"))
    lines = F.expr(r"filter(split(text, '\n'), x -> length(trim(translate(x, '\t\u000b\u000c\r', '    '))) > 0)")
    d = d.select("doc_id", "key", "text", "_w", lines.alias("_l"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    windows = F.expr(
        f"CASE WHEN size(_h) < {WINDOW} THEN array() ELSE transform(sequence(0, size(_h) - {WINDOW}), "
        f"i -> xxhash64({', '.join(f'_h[i + {j}]' for j in range(WINDOW))})) END"
    )
    d = d.select(
        "doc_id",
        "key",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stops"),
        windows.alias("_g"),
    )
    # The sort only runs for texts in which some window recurs.
    starts = F.expr(
        "array_sort(transform(filter(_s, (e, k) -> (k > 0 AND _s[k - 1].h = e.h)"
        " OR (k < size(_s) - 1 AND _s[k + 1].h = e.h)), e -> e.i))"
    )
    d = d.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).withColumn("_p", F.when(F.col("_s").isNotNull(), starts))
    covered = F.expr(
        f"aggregate(_p, named_struct('n', 0L, 'to', -1), (a, p) -> named_struct("
        f"'n', a.n + p + {WINDOW} - greatest(p, a.to), 'to', p + {WINDOW}), a -> a.n)"
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered.cast("long"), F.lit(0).cast("long"))).select(
        "doc_id", "key", *FEATURES, *MORE
    )


def _vote(reject: Column, keep: Column | None = None) -> Column:
    v = F.when(reject, -1)
    return (v if keep is None else v.when(keep, 1)).otherwise(0).cast("byte")


def rules() -> dict[str, Column]:
    """The labelling functions over the columns of :func:`features`.

    Most speak only against a document: that a text is free of one fault says
    little, so such rules abstain instead of voting to keep it.
    """
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "word_size": _vote((c < 2 * n) | (c > 14 * n)),
        "symbols": _vote(F.col("n_symbols") * 20 > c),
        "dup_lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > 3 * F.col("n_lines"))),
        "repeats": _vote(F.col("n_repeat_words") * 100 > 25 * n),
        "capitals": _vote(F.col("n_upper") * 10 > 4 * c),
        "variety": _vote((n >= 50) & (F.col("n_distinct") * 10 < n)),
        "function_words": _vote((F.col("n_stops") == 0) & (n >= 50), F.col("n_stops") * 20 > n),
    }


#: No rule may speak against more than this share of the good documents.
WRONG = 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.85):
    """EM for a two-class model with one vote distribution per rule and class.

    ``patterns`` has each distinct vote vector once with its count, at most
    three to the power of the number of rules.  A vote against a document is
    taken to be wrong for at most ``WRONG`` of the good ones, which fixes
    which of the two classes is the good one.  Returns the prior and, by
    rule, the log odds each vote adds.
    """
    if not patterns:
        return prior, []
    k = len(patterns[0][0])
    start = {1: {-1: WRONG, 0: 0.5, 1: 0.5 - WRONG}, -1: {-1: 0.3, 0: 0.5, 1: 0.2}}
    like = [{y: dict(start[y]) for y in (-1, 1)} for _ in range(k)]
    for _ in range(rounds):
        mass = {-1: 1.0, 1: 1.0}
        seen = [{y: {v: 0.0 for v in (-1, 0, 1)} for y in (-1, 1)} for _ in range(k)]
        for votes, n in patterns:
            lo = math.log(prior) - math.log(1 - prior)
            lo += sum(math.log(like[j][1][v]) - math.log(like[j][-1][v]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, lo))))
            mass[1] += n * p
            mass[-1] += n * (1 - p)
            for j, v in enumerate(votes):
                seen[j][1][v] += n * p
                seen[j][-1][v] += n * (1 - p)
        prior = min(0.99, max(0.5, mass[1] / (mass[1] + mass[-1])))
        for j in range(k):
            for y in (-1, 1):
                total = sum(seen[j][y].values()) + 3
                at = {v: (seen[j][y][v] + 1) / total for v in (-1, 0, 1)}
                if y == 1 and at[-1] > WRONG:
                    rest = (1 - WRONG) / (at[0] + at[1])
                    at = {-1: WRONG, 0: at[0] * rest, 1: at[1] * rest}
                like[j][y] = at
    odds = []
    for j in range(k):
        w = {v: math.log(like[j][1][v]) - math.log(like[j][-1][v]) for v in (-1, 0, 1)}
        # A vote never counts against its own meaning, and silence says nothing.
        odds.append({-1: min(0.0, w[-1]), 0: 0.0, 1: max(0.0, w[1])})
    return prior, odds


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: base counts, ``base_failed``, ``posterior``, ``kept``.

    Empty tables give empty results; equal rows get equal verdicts; extra
    columns are ignored.  The counts are staged once, so each text is read
    once for both the vote counts and the verdicts.
    """
    votes = rules()
    table = staged(features(docs), "quality")
    voted = table.select("doc_id", "key", *FEATURES, *(v.alias(f"v_{k}") for k, v in votes.items()))
    names = [f"v_{k}" for k in votes]
    counted = voted.groupBy(*names).count().collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(r[x] for x in names), r["count"]) for r in counted)
    prior, odds = fit(patterns)
    lo = F.lit(math.log(prior / (1 - prior)))
    for name, w in zip(names, odds, strict=False):
        lo = lo + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(0.0)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-lo))).withColumn("base_failed", base)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select(
        "doc_id", *FEATURES, "base_failed", "kept", "posterior", *names, "key"
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, with all their columns, that the rules keep.

    Rows equal in id and text share a verdict and all stay or go; null and
    empty texts go; an empty table stays empty.
    """
    good = quality_rules(docs).where("kept").select("doc_id", "key")
    return keyed_rows(docs).alias("d").join(good.alias("g"), same_row("d", "g"), "left_semi").select("d.row.*")
