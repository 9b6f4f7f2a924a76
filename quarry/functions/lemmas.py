"""Lemmas of words: irregular forms from a table, others by ordered rules whose
results have to be words of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Irregular forms of frequent English words (fixed values).
IRREGULAR = {
    "was": "be", "were": "be", "been": "be", "is": "be", "are": "be", "am": "be", "has": "have", "had": "have", "did": "do", "done": "do", "does": "do",
    "went": "go", "gone": "go", "goes": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "gave": "give", "given": "give",
    "came": "come", "became": "become", "knew": "know", "known": "know", "grew": "grow", "grown": "grow", "wrote": "write", "written": "write",
    "held": "hold", "sold": "sell", "told": "tell", "paid": "pay", "brought": "bring", "bought": "buy", "thought": "think", "sought": "seek",
    "began": "begin", "begun": "begin", "ran": "run", "rose": "rise", "risen": "rise", "fell": "fall", "fallen": "fall", "met": "meet", "led": "lead",
    "left": "leave", "lost": "lose", "kept": "keep", "felt": "feel", "meant": "mean", "built": "build", "sent": "send", "spent": "spend", "lent": "lend",
    "found": "find", "bound": "bind", "stood": "stand", "understood": "understand", "chose": "choose", "chosen": "choose", "drew": "draw", "drawn": "draw",
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "mice": "mouse", "indices": "index", "analyses": "analysis",
    "criteria": "criterion", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "less": "little", "least": "little", "more": "much", "most": "much",
}
#: Endings and what takes their place, in the order in which they are tried.
RULES = [
    ("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ves", "f"), ("ves", "fe"), ("men", "man"),
    ("s", ""), ("es", "e"), ("es", ""), ("ied", "y"), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""), ("er", "e"), ("er", ""), ("est", "e"), ("est", ""),
]
#: Endings after which a doubled consonant may be written once, and letters that a stem keeps at least.
DOUBLING, STEM = ("ed", "ing", "er", "est"), 2


def candidates(word: Column) -> Column:
    """Forms that a word may come from, with the order in which they are tried:
    the last of a doubled pair of letters goes before other ways."""
    out = []
    for i, (end, put) in enumerate(RULES):
        stem = F.substring(word, F.lit(1), F.length(word) - len(end))
        fits = F.endswith(word, F.lit(end)) & (F.length(stem) >= STEM)
        if end == "s":
            fits = fits & ~F.endswith(word, F.lit("ss")) & ~F.endswith(word, F.lit("us")) & ~F.endswith(word, F.lit("is"))
        if end in DOUBLING and put == "":
            twice = fits & (F.length(stem) > STEM) & stem.rlike(r"([b-df-hj-np-tv-z])\1$")
            out.append(F.when(twice, F.struct(F.lit(2 * i).alias("order"), F.substring(stem, F.lit(1), F.length(stem) - 1).alias("form"))))
        out.append(F.when(fits, F.struct(F.lit(2 * i + 1).alias("order"), F.concat(stem, F.lit(put)).alias("form"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def lemma_table(words: DataFrame, word: str = "word") -> DataFrame:
    """``(word, lemma)`` of distinct words in lower case: an irregular form's own
    lemma, the first form by the rules that is a word too, else the word itself.

    The words are the vocabulary; they meet their candidates by a join, so neither
    is held by a task or the driver.
    """
    spark = words.sparkSession
    vocabulary = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    tried = vocabulary.select("word", F.inline(candidates(F.col("word"))))
    known = tried.join(vocabulary.select(F.col("word").alias("form")), "form").groupBy("word").agg(F.min_by("form", "order").alias("_rule"))
    irregular = spark.createDataFrame(list(IRREGULAR.items()), "word string, _own string")
    met = vocabulary.join(known, "word", "left").join(F.broadcast(irregular), "word", "left")
    return met.select("word", F.coalesce("_own", "_rule", "word").alias("lemma"))


def lemma_counts(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``(key, lemma, count)``: how many words of each text have the lemma of one
    of the terms, by lemma; terms with one lemma are one row.

    Words lose their case and the signs around them.  The lemmas' forms are looked
    for in the corpus' vocabulary; those of the terms' lemmas, a few each, are all
    that the counting join holds.
    """
    spark = docs.sparkSession
    plain = F.transform(T.tokens(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    tokens = docs.select(F.col(key), F.explode(F.filter(plain, lambda w: w != "")).alias("word"))
    asked = spark.createDataFrame([(t.lower(),) for t in dict.fromkeys(terms) if t], "word string")
    table = lemma_table(tokens.select("word").unionByName(asked))
    wanted = table.join(F.broadcast(asked), "word", "left_semi").select("lemma").distinct()
    forms = table.join(F.broadcast(wanted), "lemma", "left_semi")
    return tokens.join(forms, "word").groupBy(key, "lemma").agg(F.count("*").alias("count"))
