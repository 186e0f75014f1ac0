"""Exact money, guarded ratios and one rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)


def exact(column: Column, data_type: T.DataType) -> Column:
    """The value as a decimal.

    Sums of doubles depend on the order in which tasks finish; sums of decimals do not, so the
    same rows always give the same report.
    """
    return column if isinstance(data_type, T.DecimalType) else column.cast(MONEY)


def round_n(column: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double, without a negative zero.

    `F.round(x, n)` rounds the printed decimal instead, which gives other last digits for
    values such as 1.005.
    """
    x = column.cast("double")
    if digits == 0:
        return F.round(x) + F.lit(0.0)
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale + F.lit(0.0)


def ratio(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """factor * part / whole in doubles; NULL when the whole is zero."""
    return F.lit(factor) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def pct(part: Column, whole: Column, digits: int) -> Column:
    """Percentage, rounded; NULL when the whole is zero."""
    return round_n(ratio(part, whole, 100.0), digits)
