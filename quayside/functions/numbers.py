"""Locale-tolerant decimal parsing as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.contract import AMOUNT
from quayside.functions.text import strip

# Fixed format: digits with thousands commas, an optional fraction, one sign in front or behind, no exponent.
_UNSIGNED = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)"
NUMBER_PATTERN = rf"^(?:[+-]?{_UNSIGNED}|{_UNSIGNED}[+-])\z"


def packed_number(raw: Column) -> Column:
    """Trim and drop ASCII spaces."""
    return F.replace(strip(raw), F.lit(" "), F.lit(""))


def clean_number(packed: Column) -> Column:
    """Read a comma as the decimal mark when there is no point."""
    return F.when(F.contains(packed, F.lit(".")), packed).otherwise(F.replace(packed, F.lit(","), F.lit(".")))


def is_number(cleaned: Column) -> Column:
    """Whether text prepared by :func:`packed_number` and :func:`clean_number` is a number.

    Kept apart from the value, because a number may still not fit the type: that is a question of range.
    """
    return F.coalesce(cleaned.rlike(NUMBER_PATTERN), F.lit(False))


def number_value(cleaned: Column, readable: Column | None = None, decimal_type: str = AMOUNT) -> Column:
    """The number as a decimal; NULL when the text is no number or does not fit."""
    readable = is_number(cleaned) if readable is None else readable
    magnitude = F.when(readable, F.translate(cleaned, ",+-", "").try_cast(decimal_type))
    return F.when(F.contains(cleaned, F.lit("-")), -magnitude).otherwise(magnitude)


def number_text(cleaned: Column) -> Column:
    """The plain spelling used in messages: sign in front, no thousands commas, no idle zeros in front."""
    digits = F.translate(cleaned, ",+-", "")
    plain = F.regexp_replace(F.regexp_replace(digits, r"\.$", ""), r"^0+(?=[0-9])", "")
    plain = F.when(F.startswith(plain, F.lit(".")), F.concat(F.lit("0"), plain)).otherwise(plain)
    return F.when(F.contains(cleaned, F.lit("-")), F.concat(F.lit("-"), plain)).otherwise(plain)
