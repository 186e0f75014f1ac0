"""Chart-ready tables made from the reports: value, sign, label text and axis bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlens.functions import percent_text, thousands_text


def _whole() -> WindowSpec:
    return Window.partitionBy()  # over the rows of one report


# Where the published charts put labels and axis ends.
BAND_LABEL_ABOVE, BAND_LABEL_BELOW = 1.6, -3.4  # margin points from a bar's end
PROFIT_AXIS_PAD, PROFIT_LABEL_GAP = 0.16, 0.06  # shares of the span, of the pad
GROWTH_LABEL_ABOVE, GROWTH_AXIS_ROOM = 0.55, 3.0  # margin points


def _sign(value: Column) -> Column:
    return F.when(value < 0, "loss").otherwise("profit")


def feed_discount(
    report: DataFrame, edges: Sequence[float], labels: Sequence[str], cut: float
) -> DataFrame:
    """Bars of margin per band; `split_at` is where the cut line stands between the bars."""
    margin = F.col("margin_pct")
    below = [label for edge, label in zip(edges, labels) if edge <= cut]
    shown_below = F.sum(F.col("discount_band").isin(below).cast("int")).over(_whole())
    return report.select(
        "discount_band",
        "margin_pct",
        _sign(margin).alias("sign"),
        percent_text(margin, 1).alias("label"),
        (margin + F.when(margin >= 0, BAND_LABEL_ABOVE).otherwise(BAND_LABEL_BELOW)).alias("label_y"),
        (shown_below - F.lit(0.5)).cast("double").alias("split_at"),
    ).orderBy("discount_band")


def feed_subcategory(report: DataFrame, *keys: str) -> DataFrame:
    """Bars of profit per sub-category, worst first, with room for labels on both sides."""
    profit = F.col("profit")
    low, high = F.min("profit").over(_whole()), F.max("profit").over(_whole())
    pad = (high - low) * PROFIT_AXIS_PAD
    return (
        report.withColumns({"_low": low - pad, "_high": high + pad, "_pad": pad})
        .select(
            *keys,
            "profit",
            _sign(profit).alias("sign"),
            thousands_text(profit).alias("label"),
            (
                profit
                + F.when(profit < 0, -PROFIT_LABEL_GAP).otherwise(PROFIT_LABEL_GAP) * F.col("_pad")
            ).alias("label_x"),
            F.col("_low").alias("axis_low"),
            F.col("_high").alias("axis_high"),
        )
        .orderBy("profit", *keys)
    )


def feed_growth(report: DataFrame) -> DataFrame:
    """Sales bars with the margin line on a second axis."""
    margin = F.col("margin_pct")
    return report.select(
        F.col("order_year").cast("string").alias("order_year"),
        "sales",
        "margin_pct",
        percent_text(margin, 2).alias("label"),
        (margin + GROWTH_LABEL_ABOVE).alias("label_y"),
        (F.min(margin).over(_whole()) - GROWTH_AXIS_ROOM).alias("axis_low"),
        (F.max(margin).over(_whole()) + GROWTH_AXIS_ROOM).alias("axis_high"),
    ).orderBy("order_year")
