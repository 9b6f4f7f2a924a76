"""Number expressions: lenient casts and a canonical text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

NUMERIC = r"^[-+]?[0-9]+(\.[0-9]+)?$"


def without_commas(c: Column | str) -> Column:
    return F.replace(strip(col(c).cast("string")), F.lit(","), F.lit(""))


def to_float(c: Column | str) -> Column:
    return without_commas(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    return strip(col(c).cast("string")).try_cast("long")


def is_numeric_like(c: Column | str) -> Column:
    return without_commas(c).rlike(NUMERIC)


def canonical_number(c: Column | str) -> Column:
    """Shortest decimal form: no point for whole numbers, no trailing zeros."""
    s = without_commas(c)
    return F.when(s.rlike(NUMERIC), shortest(s)).otherwise(s)


def shortest(digits: Column) -> Column:
    """The same of a text that is known to be a number without commas."""
    d = digits.try_cast("decimal(38,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(d, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(plain, "^-0$", "0")


def plain_float(c: Column | str, places: int = 10) -> Column:
    """A double as digits, without an exponent."""
    return canonical_number(col(c).cast(f"decimal(38,{places})").cast("string"))


def round_half_even(c: Column | str, places: int = 2) -> Column:
    return F.bround(col(c), places)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Zero where the divisor is."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def display(c: Column | str, least: int = 2, most: int = 2) -> Column:
    """A number for reading: thousands separated, at least and at most so many
    places (``###,##0.00`` has 2 and 2, ``###,##0.####`` 0 and 4)."""
    whole = F.format_number(F.bround(col(c).cast("decimal(38,10)"), most), most)
    cut = F.regexp_replace(whole, rf"(\.[0-9]{{{least}}}[0-9]*?)0+$", "$1") if most > least else whole
    return F.regexp_replace(cut, r"\.$", "")
