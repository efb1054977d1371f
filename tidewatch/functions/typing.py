"""Text to contract types. Everything arrives as text; a value that cannot be typed becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WIDEST = 1e18


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _plain_number(text: Column) -> Column:
    """Refuses what the cast would take beyond decimal numerals: type suffixes and hexadecimal.
    Byte comparisons instead of a pattern, because this runs for every numeric cell."""
    suffixed = text.endswith("d") | text.endswith("D") | text.endswith("f") | text.endswith("F")
    spelled = F.lower(text).contains("inf")
    return spelled | ~(suffixed | text.contains("x") | text.contains("X"))


def _iso_day(text: Column) -> Column:
    """Starts like YYYY-MM-DD; the cast then checks the digits."""
    return (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & F.substring(text, 1, 1).between("0", "9")


def coerce(text: Column, kind: str) -> Column:
    """Typed value or NULL. Booleans never fail: only ``true`` and ``1`` (any case) are true.

    NaN, infinities, numbers of 1e18 and more (money sums are exact decimals), digit separators and short
    dates are refused; whole numbers truncate, so ``'2020.7'`` is 2020.
    """
    value = blank_to_null(text)
    if kind == "double":
        number = value.try_cast("double")
        return F.when(_plain_number(value) & (F.abs(number) < WIDEST), number)
    if kind == "int":
        return F.when(_plain_number(value), value.try_cast("double").try_cast("int"))
    if kind == "boolean":
        return F.lower(value).isin("true", "1")
    if kind == "date":
        return F.when((F.length(value) == 10) & _iso_day(value) & ~value.endswith(" "), value.try_cast("date"))
    if kind == "timestamp":
        joined = (F.length(value) == 10) | F.substring(value, 11, 1).isin("T", " ")
        return F.when(_iso_day(value) & joined, value.try_cast("timestamp"))
    return value


def cannot_coerce(text: Column, typed: Column, kind: str) -> Column:
    if kind in ("string", "boolean"):
        return F.lit(False)
    return blank_to_null(text).isNotNull() & typed.isNull()
