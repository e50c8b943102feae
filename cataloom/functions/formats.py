"""Numbers read from text and written for people."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"^[ \t\n]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_WHOLE_NUMBER = _NUMBER + r"[ \t\n]*$"


def leading_number(text: Column) -> Column:
    """The number that a text begins with; 0 where it begins with none, or with one beyond a double's range."""
    value = F.regexp_extract(text.cast("string"), _NUMBER, 1).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def is_number(text: Column) -> Column:
    """Whether all of a text is a number, blanks around it allowed."""
    return F.coalesce(text.cast("string").rlike(_WHOLE_NUMBER), F.lit(False))


def number_or_text_less(a: Column, b: Column) -> Column:
    """a < b as numbers where both are numbers, else as text."""
    return F.when(is_number(a) & is_number(b), leading_number(a) < leading_number(b)).otherwise(a.cast("string") < b.cast("string"))


def hours(value: Column, hide_zero: bool = False) -> Column:
    """H:MM:SS to the nearest second, never negative; with ``hide_zero`` M:SS below an hour."""
    whole = F.greatest(F.floor(leading_number(value) + 0.5), F.lit(0)).cast("bigint")
    long = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(whole < 3600, F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)).otherwise(long) if hide_zero else long


# Decimal places of a double as its exact binary value rounds: the JVM's formatting rounds the shortest decimal instead.
@F.pandas_udf(StringType())
def _places(value: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{p}f}" for v, p in zip(value, places, strict=True)])


def ratio(value: Column) -> Column:
    """Two places below 10, one from there on."""
    number = leading_number(value)
    return _places(number, F.when(number < 10, 2).otherwise(1))


def size(value: Column) -> Column:
    """A byte count with a decimal unit."""
    number = leading_number(value)
    scaled = F.when(number < 1_000_000, number / 1_000).when(number < 1_000_000_000, number / 1_000_000).otherwise(number / 1_000_000_000)
    shown = _places(scaled, F.when(number < 1_000_000_000, 1).otherwise(2))
    unit = F.when(number < 1_000_000, " kB").when(number < 1_000_000_000, " MB").otherwise(" GB")
    return F.when(number < 1_000, F.format_string("%d B", number.cast("bigint"))).otherwise(F.concat(shown, unit))


def _extended(text: str) -> Fraction:
    """The 80-bit float nearest to a decimal: 64 bits of it, ties to even."""
    value = Fraction(text)
    if not value:
        return value
    shift = abs(value.numerator).bit_length() - value.denominator.bit_length() - 64
    while abs(value) >= Fraction(2) ** (shift + 64):
        shift += 1
    while abs(value) < Fraction(2) ** (shift + 63):
        shift -= 1
    return round(value / Fraction(2) ** shift) * Fraction(2) ** shift


@F.pandas_udf(StringType())
def _rounded(text: pd.Series, places: pd.Series) -> pd.Series:
    def one(value: str | None, digits: int) -> str | None:
        if value is None or not re.fullmatch(r"[0-9]+(\.[0-9]*)?|\.[0-9]+", value):
            return None
        whole = round(_extended(value) * 10**digits)
        return f"{whole // 10**digits}.{whole % 10**digits:0{digits}d}" if digits else str(whole)

    return pd.Series([one(v, p) for v, p in zip(text, places, strict=True)])


def three_decimals(text: Column) -> Column:
    """A decimal text at three places, as 80-bit floats round; null where it is no plain decimal."""
    return _rounded(text, F.lit(3))


def no_decimals(text: Column) -> Column:
    return _rounded(text, F.lit(0))
