"""Flags, missing values, lists and references."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Texts that stand for a missing value (fixed values).
NULLISH = ["", "none", "null", "[none]", "[null]", "[]", "{}", "_none_", "_none._", "_none", "none_", "n/a", "na"]
#: Codes of states by lower-case name (fixed values).
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}


def is_nullish(c: Column | str) -> Column:
    s = col(c)
    return s.isNull() | F.lower(strip(s.cast("string"))).isin(NULLISH)


def xml_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(col(c))).isin("1", "true", "yes", "y"), F.lit(False))


def strict_bool(c: Column | str) -> Column:
    """The strict reading: ``1`` or ``true`` as they stand, nothing else."""
    return F.coalesce(col(c).isin("1", "true"), F.lit(False))


def code_table(stylesheet: str) -> dict[str, str]:
    """Codes and their descriptions from the published stylesheet's choices, the
    place where the full list of states and countries is kept."""
    found = re.findall(r"(?s)<xsl:when\s+test=\"\$\w+\s*=\s*'([^']+)'\"\s*>\s*(.*?)\s*</xsl:when>", stylesheet)
    return {code: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", text)).strip() for code, text in found}


def description_of(code: Column | str, table: dict[str, str]) -> Column:
    """A code's description from a table; null for one it lacks."""
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.try_element_at(pairs, F.upper(strip(col(code))))


def first_present(*cols: Column | str) -> Column:
    """The first value neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cols))


def state_code(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """A state's code for its name, and any other text as it is; a longer
    table (territories, countries) is a parameter."""
    codes = F.create_map(*(F.lit(x) for x in chain.from_iterable((table or STATES).items())))
    # A lambda, so that the text is made once; and a projection that has one is compiled
    # in pieces, where whole-stage code may be one method too long for the JVM to compile.
    name = F.array(F.lower(strip(col(c))))
    return F.element_at(F.transform(name, lambda x: F.coalesce(F.try_element_at(codes, x), x)), 1)


def comma_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")


def joined(*cols: Column | str, sep: str = ", ") -> Column:
    """Parts that are there, joined."""
    return F.array_join(F.filter(F.array(*(col(c) for c in cols)), lambda x: x.isNotNull() & (x != "")), sep)


def _plain_ref(x: Column) -> Column:
    return strip(F.replace(F.upper(x), F.lit("F"), F.lit("")))


def footnote_refs(c: Column | str) -> Column:
    """Distinct ids without their F from a JSON array or a comma list."""
    s = strip(col(c))
    listed = F.when(F.startswith(s, F.lit("[")), F.from_json(s, "array<string>")).otherwise(F.split(s, ","))
    return F.array_distinct(F.filter(F.transform(listed, _plain_ref), lambda x: x != ""))


def inline_refs(c: Column | str) -> Column:
    """Ids of ``[^1]`` or ``[F1]`` marks within a text."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[\^?\s*([A-Za-z0-9]+)\s*\]"), F.lit(1)), _plain_ref)


def merged_refs(c: Column | str) -> Column:
    """An aggregate: a group's refs (arrays), distinct, sorted, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(col(c))))), "|")


def json_block(c: Column | str) -> Column:
    """The JSON of a text: its fenced block, or from the first brace to the
    last; thoughts, line comments and thousands separators removed."""
    s = F.regexp_replace(col(c), r"(?s)<thought>.*?</thought>", "")
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    body = first_present(fenced, F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    body = F.regexp_replace(body, r"(?m)^\s*#.*$", "")
    return F.regexp_replace(body, r"(?<=[0-9]),(?=[0-9]{3}(?:[,.\s}\]]|$))", "")
