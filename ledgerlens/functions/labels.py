"""Numbers as text. `format_number` rounds the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands_text(column: Column) -> Column:
    """12345.0 -> 12,345"""
    return F.format_number(column, 0)


def percent_text(column: Column, digits: int) -> Column:
    """12.34 -> 12.3% (no thousands separators)"""
    return F.concat(F.translate(F.format_number(column, digits), ",", ""), F.lit("%"))


def plain_text(column: Column) -> Column:
    """A report figure without an exponent: Spark would write 12345678.0 as 1.2345678E7."""
    digits = column.cast("decimal(38,6)").cast("string")
    written_out = F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(column) >= 1e7, written_out).otherwise(column.cast("string"))
