"""String expressions with the semantics filings need (all code points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zfill(c: Column | str, width: int = 10) -> Column:
    """Zero-pad on the left behind a sign; longer values stay whole."""
    s = col(c).cast("string")
    signed = s.rlike("^[+-]")
    sign, rest = F.when(signed, F.substring(s, 1, 1)).otherwise(""), F.when(signed, F.substr(s, F.lit(2))).otherwise(s)
    pad = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(s), F.lit(0)))
    return F.concat(sign, pad, rest)


def strip(c: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", " ")


def drop_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)[^\w\s]", "")


def signer(c: Column | str) -> Column:
    """A signature without its leading /s/ mark."""
    return F.regexp_replace(col(c), r"(?i)^/s/\s*", "")


def count_substring(text: Column | str, term: Column | str) -> Column:
    """Non-overlapping occurrences; none of an empty term."""
    t, p = col(text), col(term)
    n = (F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.nullif(F.length(p), F.lit(0))
    return F.coalesce(n, F.lit(0)).cast("long")


def count_token(tokens: Column | str, term: Column | str) -> Column:
    p = col(term)
    return F.size(F.filter(col(tokens), lambda x: x == p)).cast("long")


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def accession_of(path: Column | str) -> Column:
    """The accession number a filing's path ends in."""
    return F.replace(F.element_at(F.split(col(path), "/"), -1), F.lit(".txt"), F.lit(""))


def no_dashes(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("-"), F.lit(""))


def find_accession(values: Column) -> Column:
    """The first of an array of values that is an accession number."""
    return F.try_element_at(F.filter(values, lambda v: v.rlike(ACCESSION)), F.lit(1))


def clean_path(c: Column | str, root: str = "archive") -> Column:
    """A path under the archive's root, however much of it was given."""
    p = F.regexp_replace(col(c), "^/Archives/", "")
    return F.when(F.lower(p).like("data/%"), F.concat(F.lit(root + "/"), p)).otherwise(p)


def type_slug(c: Column | str) -> Column:
    """A document type as a file suffix: four characters, lower case."""
    return F.regexp_replace(F.substring(F.lower(col(c)), 1, 4), r"[/ ]", "")


def title_of(key: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(key), "[-_]", " "))


def escape_latex(c: Column | str) -> Column:
    out = col(c)
    for sign in "&%$_#":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def printable(c: Column | str) -> Column:
    """A key: printable ASCII alone."""
    return strip(F.regexp_replace(col(c), r"[^\x20-\x7E]", ""))


def no_nul(c: Column | str) -> Column:
    return strip(F.replace(col(c), F.lit("\0"), F.lit("")))


def decoded(c: Column | str) -> Column:
    """Bytes as UTF-8 or, where they are none, as ISO 8859-1."""
    b = col(c)
    return F.coalesce(F.try_validate_utf8(b.cast("string")), F.decode(b, "ISO-8859-1"))


def display_name(name: Column | str, ticker: Column | str, cik: Column | str) -> Column:
    other = F.coalesce(F.nullif(col(ticker), F.lit("")), col(cik).cast("string"))
    return F.concat(col(name), F.lit(" ("), other, F.lit(")"))


def names_agree(key: Column | str, a: Column | str, b: Column | str) -> Column:
    """Equal, or for name keys one within the other."""
    x, y = col(a), col(b)
    within = F.contains(x, y) | F.contains(y, x)
    return (x == y) | (F.contains(col(key), F.lit("name")) & (x != "") & (y != "") & within)


def join_url(base: Column | str, path: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(base), "/+$", ""), F.lit("/"), F.regexp_replace(col(path), "^/+", ""))
