"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Layouts a header's date may have, in order of preference.
LAYOUTS = ["yyyyMMdd", "yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMddHHmmss", "MMMM d, yyyy", "MMM d, yyyy"]


def strict_date(c: Column | str) -> Column:
    """ISO dates only, dashes optional; null otherwise."""
    s = strip(col(c))
    plain = F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
    return F.coalesce(plain, F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")))


def lenient_date(c: Column | str) -> Column:
    s = strip(col(c))
    return F.coalesce(*(F.try_to_date(s, layout) for layout in LAYOUTS))


def period_label(form: Column | str, date: Column | str) -> Column:
    """``FY 2023`` for annual reports, ``Q2 2023`` for all others."""
    d = col(date)
    year = F.year(d).cast("string")
    quarter = F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), year)
    return F.when(F.startswith(col(form), F.lit("10-K")), F.concat(F.lit("FY "), year)).otherwise(quarter)


def quarter_name(month: Column | str) -> Column:
    m = col(month)
    return F.when(m.between(1, 12), F.concat(F.lit("QTR"), F.ceil(m / 3).cast("string")))


def dated_path(date: Column | str, name: Column | str, suffix: str = ".sgml.zst") -> Column:
    """``data/2023/QTR2/05/09/name.sgml.zst``."""
    d = col(date)
    parts = [
        F.lit("data"), F.date_format(d, "yyyy"), F.concat(F.lit("QTR"), F.quarter(d).cast("string")),
        F.date_format(d, "MM"), F.date_format(d, "dd"), F.concat(col(name), F.lit(suffix)),
    ]
    return F.concat_ws("/", *parts)


def resolved_path(stored: Column | str, year: Column | str, quarter: Column | str, month: Column | str, day: Column | str, name: Column | str, suffix: str = ".md.zst") -> Column:
    """The stored path or else one made from the parts, if none is missing or
    zero."""
    parts = [col(x) for x in (year, quarter, month, day)]
    usable = F.lit(True)
    for p in parts:
        usable = usable & F.coalesce(p != 0, F.lit(False))
    made = F.format_string("data/%d/QTR%d/%02d/%02d/%s" + suffix, *parts, col(name))
    return F.coalesce(F.nullif(col(stored), F.lit("")), F.when(usable, made))


def year_or(c: Column | str, today: Column | None = None) -> Column:
    """A year, or where there is none that of ``today`` (a parameter, so that a
    run can be repeated; else the day of the run)."""
    return F.coalesce(col(c).cast("int"), F.year(today if today is not None else F.current_date()))
