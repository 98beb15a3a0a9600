"""Text, number and date display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Danish weekday names, Monday first.
WEEKDAYS_DA = ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag")


def area_name(column: Column, suffix: str = "Storkreds") -> Column:
    """Place name out of an area title: without the suffix word and a trailing genitive s."""
    return F.regexp_replace(F.trim(F.regexp_replace(column, suffix, "")), "s$", "")


def title_case(column: Column) -> Column:
    """Title case that also starts a new word after a hyphen."""
    return F.array_join(F.transform(F.split(column, "-"), F.initcap), "-")


def whole_number(column: Column) -> Column:
    """Text as BIGINT, NULL where it is no whole number of that range.

    The pattern is tested first: a failing cast raises and catches an error per row.
    """
    return F.regexp_substr(F.trim(column), F.lit(r"^[+-]?\d{1,19}$")).try_cast("bigint")


def decimal_number(column: Column) -> Column:
    """Text with a decimal point as DOUBLE, NULL where it is no number."""
    pattern = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.regexp_substr(F.trim(column), F.lit(pattern)).cast("double")


def round_name(column: Column) -> Column:
    """The part after ``- `` in ``Stage - Round``; NULL without one."""
    return F.regexp_substr(column, F.lit(r"(?<=- ).+"))


def stage_name(column: Column) -> Column:
    """The part before `` -`` in ``Stage - Round``; NULL without one."""
    return F.regexp_substr(column, F.lit(r".+(?= -)"))


def id_digits(column: Column) -> Column:
    """First run of digits in a composite id, as a number."""
    return whole_number(F.regexp_substr(column, F.lit(r"\d+")))


def point_part(column: Column, index: int) -> Column:
    """One number out of ``c(lon, lat)`` or ``lat,lon`` (index from 1)."""
    part = F.split_part(column, F.lit(","), F.lit(index))
    return decimal_number(F.regexp_replace(part, r"[c()]", ""))


def danish_number(column: Column, decimals: int = 0, big_mark: str = ".") -> Column:
    """Number text with a decimal comma and the given thousands mark."""
    return F.translate(F.format_number(column, decimals), ",.", big_mark + ",")


def percent_text(share: Column, decimals: int = 2) -> Column:
    """A share as ``12,34 %``."""
    return F.concat(danish_number(share * 100, decimals), F.lit(" %"))


def weekday_name(day: Column) -> Column:
    """Danish weekday name of a date."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS_DA]), F.weekday(day) + 1)
