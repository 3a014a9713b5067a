"""Text and decimal columns as statements deliver them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the statement format: texts that mean "no value".
NULL_TEXTS = ("-", "--", "N/A")

WHITESPACE = " \t\n\r\f\v"
MONEY = "decimal(24,8)"
RATE = "decimal(24,10)"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def required_text(value: Column) -> Column:
    """Trimmed text, null when absent or blank. ``-`` counts as text here."""
    return F.nullif(trimmed(value), F.lit(""))


def optional_text(value: Column) -> Column:
    """Trimmed text, null when absent, blank or one of the no-value texts."""
    text = trimmed(value)
    return F.when(~text.isin("", *NULL_TEXTS), text)


def decimal_value(text: Column, decimal_type: str = MONEY) -> Column:
    """Decimal from text with thousands separators; null when it is not a finite number."""
    return F.translate(text, ",_", "").try_cast(decimal_type)


def normalized_side(value: Column) -> Column:
    return F.upper(trimmed(value))
