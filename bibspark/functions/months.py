"""Months: parsing, formatting, and the month of an ISO date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import trim

#: Fixed values.
FULL = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ABBREV_DOT = ["Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec."]
STYLES = ("KEEP_ORIGINAL", "ABBREV_DOT", "FULL_NAME")


def month_number(c: Column) -> Column:
    """1 to 12, or null. All digits of the value together decide first; else the first three letters."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    # only what is a month is cast: a cast that fails is an exception for each row
    digits = F.when(digits.rlike("^0*(?:[1-9]|1[0-2])$"), F.right(digits, F.lit(2)).try_cast("int"))
    start = F.left(trim(F.regexp_replace(F.lower(trim(c)), "[{}]", "")), F.lit(3))
    named = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in FULL]), start).cast("int")
    return F.coalesce(digits, F.when(named > 0, named))


def _name(n: Column, names: list[str]) -> Column:
    return F.when(n.between(1, 12), F.get(F.array(*map(F.lit, names)), n - 1))


def format_month(n: Column, style: str, original: Column) -> Column:
    """The month in a style; the original where it is kept, or where there is no such month."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    if style == "KEEP_ORIGINAL":
        return original
    return F.coalesce(_name(n, FULL if style == "FULL_NAME" else ABBREV_DOT), original)


def month_name(n: Column) -> Column:
    return _name(n, FULL)


def iso_month(date: Column) -> Column:
    """The name of the month of a date such as 2020-03-01, by position; null if it is shorter than year and month."""
    return F.when(F.length(date) >= 7, month_name(F.substring(date, 6, 2).try_cast("int")))
