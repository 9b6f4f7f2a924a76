"""Scoring one nested record set against another, field by field."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import values as V
from ..functions.porter import porter_stem
from ..functions.udf import arrow_udf
from .joins import ABSENT, matched_values


@arrow_udf("map<string,string>")
def flatten_json(records: pd.Series) -> pd.Series:
    """Leaves of a JSON record by path, parts joined by ``_``; values trimmed
    and in lower case; empty lists and objects leave no key."""

    def one(raw: str | None) -> dict | None:
        if raw is None:
            return None
        try:
            root = json.loads(raw)
        except ValueError:
            return None
        out, todo = {}, [("", root)]
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}{k}_", v) for k, v in reversed(list(x.items()))]
            elif isinstance(x, list):
                todo += [(f"{path}{i}_", v) for i, v in reversed(list(enumerate(x)))]
            else:
                out[path[:-1]] = str(x).strip().lower()
        return out

    return records.map(one)


def long_form(df: DataFrame, key: str, record: str) -> DataFrame:
    """A JSON record per row to ``(key, field, value)`` rows."""
    # What follows is dear and a small file is one task's, so records are dealt by
    # key first.
    dealt = df.select(key, F.col(record).alias("_r")).repartition(key)
    return dealt.select(key, F.explode(flatten_json("_r")).alias("field", "value"))


def canonical_key(c: Column | str) -> Column:
    """Field names with repeated parts taken once and generic derivative
    names spelled out.  The order of the steps matters."""
    return _last_repeats(_spelled_out(_first_repeats(T.col(c))))


def _first_repeats(k: Column) -> Column:
    k = F.regexp_replace(k, r"^(\w+)_\1_", "$1_")
    k = F.regexp_replace(k, r"_rptowner_", "_")
    k = F.regexp_replace(k, r"_(\w+)_\1_", "_")
    return F.regexp_replace(k, r"(shares_owned|nature_of_ownership)_\1", "$1")


def _spelled_out(k: Column) -> Column:
    derived = F.startswith(k, F.lit("derivative_transactions"))
    return F.when(derived & F.endswith(k, F.lit("_price")), F.regexp_replace(k, "_price", "_conversion_or_exercise_price")).when(
        derived & F.endswith(k, F.lit("_shares")) & ~F.endswith(k, F.lit("_underlying_security_shares")),
        F.regexp_replace(k, "_shares", "_underlying_security_shares"),
    ).otherwise(k)


def _last_repeats(k: Column) -> Column:
    # The replacement tries every length at every place; what it finds has a letter
    # before one _ that stands at the end of a later part too, which is soon seen.
    return F.when(k.rlike(r"([a-z_])_[a-z_]*\1(?=_|$)"), F.regexp_replace(k, r"([a-z_]+?)_\1(?=_|$)", "$1")).otherwise(k)


def without_index(c: Column | str) -> Column:
    return F.regexp_replace(T.col(c), r"_\d+_", "_")


def normal_value(key: Column | str, value: Column | str) -> Column:
    """A value made comparable, by the kind of field it stands in."""
    v = T.strip(value)
    return _normal(T.col(key), v, T.collapse(F.lower(v)), N.without_commas(v))


def _normal(k: Column, v: Column, low: Column, digits: Column) -> Column:
    """The same of a stripped value, its lower-case form and its form without commas."""
    is_state = (F.contains(k, F.lit("_state")) | F.endswith(k, F.lit("state"))) & ~F.contains(k, F.lit("state_description"))
    return (
        F.when(F.contains(F.lower(k), F.lit("_cik")), F.lower(T.zfill(v)))
        .when(digits.rlike(N.NUMERIC), N.shortest(digits))
        .when(F.startswith(k, F.lit("footnotes_")) | (k == "remarks"), low)
        .when(F.contains(k, F.lit("signature_name")), T.strip(T.signer(low)))
        .when(is_state, T.strip(T.drop_punctuation(V.state_code(F.regexp_replace(low, r"[^a-z\s]", "")))))
        .otherwise(T.strip(T.drop_punctuation(low)))
    )


def parity_value(key: Column | str, value: Column | str) -> Column:
    """The second rule set: amounts rounded half-even to two places, states by
    code, all else trimmed in lower case."""
    k, v = T.col(key), T.strip(value)
    amount = k.rlike("shares|price|value|amount") & N.is_numeric_like(v)
    rounded = N.canonical_number(F.bround(N.without_commas(v).try_cast("decimal(38,10)"), 2).cast("string"))
    is_state = F.contains(k, F.lit("state")) & ~F.contains(k, F.lit("description"))
    return F.when(amount, rounded).when(is_state, V.state_code(v)).otherwise(F.lower(v))


def comparable(rows: DataFrame) -> DataFrame:
    """``(key, field, value)`` rows: references merged into sorted sets,
    missing values dropped, values and fields made canonical."""
    is_ref = F.col("field").rlike(r"_fn(_\d+)?$")
    base = F.regexp_replace("field", r"_fn(_\d+)?$", "_fn")
    inline, plain = V.inline_refs("value"), V.footnote_refs("value")
    refs = (
        rows.where(is_ref)
        .select("key", base.alias("field"), F.when(F.size(inline) > 0, inline).otherwise(plain).alias("refs"))
        .groupBy("key", "field").agg(V.merged_refs("refs").alias("value"))
    )
    rest = rows.where(~is_ref)
    known = rest.unionByName(refs).where(~V.is_nullish("value"))
    # Columns of their own, so that what several rules read is made once a row.
    forms = known.withColumns({"_v": T.strip("value"), "_k": _first_repeats(F.col("field"))})
    forms = forms.withColumns({"_low": T.collapse(F.lower("_v")), "_digits": F.replace("_v", F.lit(","), F.lit("")), "_k": _spelled_out(F.col("_k"))})
    value = F.when(F.endswith("field", F.lit("_fn")), F.col("value")).otherwise(_normal(*map(F.col, ("field", "_v", "_low", "_digits"))))
    return forms.select("key", _last_repeats(F.col("_k")).alias("field"), value.alias("value"))


def with_streets(rows: DataFrame) -> DataFrame:
    """An owner's two street lines as one more, order-insensitive, field."""
    # One pass over the rows: a window of each owner's street lines, whose first row
    # brings the joined field with it.
    of = F.regexp_extract("field", r"^(reporting_owners_\d+)_street[12]$", 1)
    parts = rows.withColumn("_o", of).withColumn("_p", F.when(F.col("_o") != "", F.nullif(T.strip("value"), F.lit(""))))
    owner = Window.partitionBy("key", "_o")
    both = parts.select("key", "field", "value", "_o", F.collect_list("_p").over(owner).alias("_ps"), F.row_number().over(owner.orderBy("field", "value")).alias("_n"))
    itself = F.struct("field", "value")
    more = F.struct(F.concat("_o", F.lit("_street_combined")).alias("field"), F.array_join(F.array_sort("_ps"), "|").alias("value"))
    return both.select("key", F.inline(F.when((F.col("_n") == 1) & (F.size("_ps") > 0), F.array(itself, more)).otherwise(F.array(itself))))


def scored_fields(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``(field, tp, fp, fn)`` over comparable rows of both sides; a mismatch
    counts on both sides.  Summaries and single street lines are left out."""
    both = matched_values(truth, found, ["key", "field"])
    both = both.where(~F.contains("field", F.lit("summary")) & ~F.col("field").rlike(r"^reporting_owners_\d+_street[12]$"))
    return match_counts(both.withColumn("field_key", without_index("field")), "field_key", names="field").withColumnRenamed("field_key", "field")


def match_counts(both: DataFrame, by: str, names: str | None = None) -> DataFrame:
    t, f = F.col("truth"), F.col("found")
    there_t, there_f = t != ABSENT, f != ABSENT
    equal = (t == f) if names is None else T.names_agree(names, t, f)
    hit = there_t & there_f & equal
    return both.groupBy(by).agg(
        F.count_if(hit).alias("tp"), F.count_if(there_f & ~hit).alias("fp"), F.count_if(there_t & ~hit).alias("fn")
    )


def with_scores(counts: DataFrame, places: int = 6) -> DataFrame:
    """Precision, recall, F1 and support; zero where undefined."""
    p, r = N.ratio("tp", F.col("tp") + F.col("fp")), N.ratio("tp", F.col("tp") + F.col("fn"))
    f1 = N.ratio(2 * p * r, p + r)
    return counts.withColumns(
        {"precision": F.round(p, places), "recall": F.round(r, places), "f1": F.round(f1, places), "support": F.col("tp") + F.col("fn")}
    )


def sections_of(fields: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Fields once per section whose pattern they match (none or several)."""
    pairs = F.array(*(F.when(F.col("field").rlike(p), F.lit(s)) for s, p in sections.items()))
    return fields.withColumn("section", F.explode(F.filter(pairs, lambda x: x.isNotNull())))


def weighted_rollup(scores: DataFrame, by: str) -> DataFrame:
    """Means weighted by support, over what has any; and over everything."""
    some = scores.where("support > 0")
    weights = [F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in ("precision", "recall", "f1")]
    return some.groupBy(by).agg(*weights, F.sum("support").alias("support"))


def micro_rollup(counts: DataFrame, by: str) -> DataFrame:
    """Pooled counts by section, and overall, scored."""
    pooled = counts.rollup(by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return with_scores(pooled.withColumn(by, F.coalesce(by, F.lit("overall"))))


def macro_mean(scores: DataFrame) -> DataFrame:
    return scores.where("support > 0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("fields"))


def field_population(df: DataFrame) -> DataFrame:
    """Rows, filled rows and share by column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("filled")) for c in df.columns))
    one = counts.select("_n", F.inline(pairs))
    return one.select("field", F.col("_n").alias("total"), "filled", F.round(N.ratio("filled", "_n") * 100, 4).alias("percent"))


def value_in_text(value: Column | str, text: Column | str) -> Column:
    """pass or fail; n/a for a value that is missing."""
    v = T.col(value).cast("string")
    there = F.contains(F.lower(T.col(text)), F.lower(v))
    return F.when(v.isNull() | (v == ""), "n/a").when(there, "pass").otherwise("fail")


def rouge_words(text: str | None, stemmed: bool) -> list[str]:
    """Runs of ASCII letters and digits in lower case; with ``stemmed``, those
    of more than three characters by their stem."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return [porter_stem(w) if len(w) > 3 else w for w in words] if stemmed else words


def common_length(u: list[str], v: list[str]) -> int:
    """Length of the longest common subsequence, with a bit for each word of ``v``:
    a row of the usual table is one addition of long whole numbers."""
    where: dict[str, int] = {}
    for i, w in enumerate(v):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(v)) - 1
    row = full
    for w in u:
        hits = row & where.get(w, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(v) - row.bit_count()


def rouge(found: Column | str, truth: Column | str, stemmed: bool = True) -> Column:
    """F-measures ``(rouge1, rougeL)`` of two texts: of the overlap of their
    words as multisets, and of their longest common subsequence."""

    @arrow_udf("struct<rouge1: double, rougeL: double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            u, v = rouge_words(x, stemmed), rouge_words(y, stemmed)
            shared = sum((Counter(u) & Counter(v)).values())
            n = len(u) + len(v)
            rows.append((2 * shared / n if n else 0.0, 2 * common_length(u, v) / n if n else 0.0))
        return pd.DataFrame(rows, columns=["rouge1", "rougeL"], dtype=float)

    return run(T.col(found), T.col(truth))


def held_out(keys: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first keys of a hold-out list, at least one."""
    return keys.orderBy(order).limit(max(1, n)).select(key)


#: Fields of an extracted record that are numbers (fixed values).
NUMERIC_FIELDS = {
    "shares", "price", "transaction_total_value", "shares_owned_following_transaction", "value_owned_following_transaction",
    "conversion_or_exercise_price", "underlying_security_shares", "underlying_security_value",
}


@arrow_udf("string")
def sanitised(records: pd.Series) -> pd.Series:
    """JSON records with all texts trimmed and the numeric fields' texts, with
    or without thousands separators, as numbers; null for what is no JSON."""

    def clean(x, name: str = ""):
        if isinstance(x, dict):
            return {k: clean(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if not isinstance(x, str):
            return x
        plain = x.strip().replace(",", "")
        return float(plain) if name in NUMERIC_FIELDS and re.fullmatch(r"[-+]?\d+(?:\.\d+)?", plain) else x.strip()

    def one(raw: str | None) -> str | None:
        try:
            return json.dumps(clean(json.loads(raw)), ensure_ascii=False) if raw else None
        except ValueError:
            return None

    return records.map(one)


def first_mismatch(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """By type, in how many pairs each field is the first that differs;
    columns ``t_<field>`` and ``f_<field>``."""
    hits = F.filter(F.array(*(F.when(~F.col(f"t_{c}").eqNullSafe(F.col(f"f_{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    return pairs.select(key, F.try_element_at(hits, F.lit(1)).alias("field")).where("field IS NOT NULL").groupBy(key, "field").count()


def report_rows(scores: DataFrame, kind: str = "markdown") -> DataFrame:
    """Score rows as lines of a Markdown or LaTeX table."""
    num = [F.format_string("%.3f", F.col(c)) for c in ("precision", "recall", "f1")]
    cells = [F.col("field") if kind == "markdown" else T.escape_latex("field"), *num, F.col("support").cast("string")]
    if kind == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    else:
        line = F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\"))
    return scores.select("field", line.alias("line"))

