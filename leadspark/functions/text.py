"""Text cleaning. Java's ``\\s`` knows ASCII only, hence ``(?U)``, and plain ``trim`` only blanks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# All Unicode white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without white space at both ends; cheaper than a regular expression."""
    return F.trim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    """Runs of whitespace become one blank; ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_invisible(c: Column) -> Column:
    """Drop word joiners and zero-width spaces, turn no-break spaces into blanks, strip."""
    return strip(F.translate(c, " ⁠​", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def comparison_form(c: Column) -> Column:
    """Form under which two audience spellings count as the same."""
    return F.regexp_replace(collapse_spaces(F.lower(c)), r"\.+$", "")


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in normaliser."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def decimal_comma(c: Column) -> Column:
    """Number written with a decimal comma or point, null when it is not a number."""
    return F.regexp_replace(strip(c.cast("string")), ",", ".").try_cast("double")


def thousands(c: Column) -> Column:
    """Number written as ``1,234.5``, null when it is not a number."""
    return F.regexp_replace(strip(c.cast("string")), ",", "").try_cast("double")


def safe_ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """``top / bottom * scale``, 0 where the denominator is 0 or null."""
    return F.when(bottom != 0, top / bottom * F.lit(float(scale))).otherwise(F.lit(0.0))


def ratio_den1(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """``top / bottom * scale`` with a zero denominator read as 1."""
    return top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom) * F.lit(float(scale))


def percent_difference(value: Column, base: Column) -> Column:
    return F.coalesce(F.try_divide(value - base, base) * F.lit(100.0), F.lit(0.0))


def feature_name(name: str) -> str:
    """Column-name form used by the encoder (plan time, not a column function)."""
    kept = "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in name)
    return "_".join(piece for piece in kept.split("_") if piece)
