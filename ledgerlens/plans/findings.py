"""Figures quoted beside the reports: domains, shares, totals, growth, stability, conservation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import literal, pct, round_n
from ledgerlens.operators.facts import Facts
from ledgerlens.operators.ranking import next_value


def group_margin(facts: Facts, *keys: str) -> DataFrame:
    """Lines, sales, profit and margin per group."""
    return (
        facts.totals(*keys)
        .select(
            *keys,
            F.col("lines").alias("order_lines"),
            round_n(F.col("sales"), 0).alias("sales"),
            round_n(F.col("profit"), 0).alias("profit"),
            pct(F.col("profit"), F.col("sales"), 2).alias("margin_pct"),
        )
        .orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    )


def domain_gaps(facts: Facts, column: str, ranges: int | None = None) -> DataFrame:
    """The distinct values of a measure, their lines and the distance to the next value.

    `ranges` sorts a measure of many distinct values side by side (see `rank_and_run`).
    """
    present = Facts(facts.frame.filter(F.col(column).isNotNull()).select(column, "lines"))
    values = present.frame.groupBy(column).agg(F.sum("lines").alias("order_lines"))
    return (
        next_value(values, column, "_next", ranges)
        .select(
            F.col(column).cast("double").alias(column),
            "order_lines",
            F.col("_next").cast("double").alias("next_value"),
            (F.col("_next") - F.col(column)).cast("double").alias("gap"),
        )
        .orderBy(column)
    )


def cut_totals(facts: Facts, cut: float) -> DataFrame:
    """Share of lines and sales, and profit, on either side of a discount cut."""
    side = (
        F.when(F.col("discount") <= literal(cut), "at or below cut")
        .when(F.col("discount") > literal(cut), "above cut")
        .otherwise("no discount given")
    )
    sides = Facts(facts.frame.withColumn("side", side)).totals("side")
    whole = Window.partitionBy()  # over three rows at most
    return (
        sides.withColumns(
            {"_lines": F.sum("lines").over(whole), "_sales": F.sum("sales").over(whole)}
        )
        .select(
            "side",
            F.col("lines").alias("order_lines"),
            pct(F.col("lines"), F.col("_lines"), 1).alias("line_share_pct"),
            round_n(F.col("sales"), 0).alias("sales"),
            pct(F.col("sales"), F.col("_sales"), 1).alias("sales_share_pct"),
            round_n(F.col("profit"), 0).alias("profit"),
        )
        .orderBy("side")
    )


def loss_totals(split: DataFrame, key: str, top: int) -> DataFrame:
    """From a loss split: the worst `top` members, the others together, and all together."""
    shown = F.when(F.col("loss_rank") <= top, F.col(key)).otherwise(F.lit("others"))
    return (
        split.withColumn("member", F.explode(F.array(shown, F.lit("all losing"))))
        .groupBy("member")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("profit").alias("profit"),
            F.sum("low_band_profit").alias("low_band_profit"),
            F.min("low_band_margin_pct").alias("lowest_low_band_margin_pct"),
            F.max("low_band_margin_pct").alias("highest_low_band_margin_pct"),
            F.sum("high_band_profit").alias("high_band_profit"),
        )
        .orderBy("member")
    )


def growth_first_last(trend: DataFrame) -> DataFrame:
    """Growth from the first to the last year of a yearly trend, and the span of its margins."""
    ends = trend.agg(
        F.min("order_year").alias("first_year"),
        F.max("order_year").alias("last_year"),
        F.min_by("sales", "order_year").alias("first_sales"),
        F.max_by("sales", "order_year").alias("last_sales"),
        F.min("margin_pct").alias("lowest_margin_pct"),
        F.max("margin_pct").alias("highest_margin_pct"),
    )
    first, last = F.col("first_sales"), F.col("last_sales")
    return ends.withColumn("growth_pct", pct(last - first, first, 1))


def sweep_stability(sweep: DataFrame) -> DataFrame:
    """Which thresholds give the same figures as the threshold before.

    `sweep` must be numbered: rounded labels can collide and tell no order.
    """
    before = Window.orderBy("step")
    metrics = [c for c in sweep.columns if c not in ("step", "threshold_pct")]
    same = reduce(
        lambda a, b: a & b, [F.col(m).eqNullSafe(F.lag(m).over(before)) for m in metrics]
    )
    previous = F.lag("threshold_pct").over(before)
    compared = sweep.select(
        "step",
        "threshold_pct",
        previous.alias("previous_threshold_pct"),
        F.when(previous.isNotNull(), same).alias("same_as_previous"),
    )
    return compared.orderBy("step").drop("step")


# What each report shows of orders, sales and profit; None where it shows none.
CONSERVED: Mapping[str, tuple[str | None, str, str | None]] = {
    "01_overview": ("total_orders", "total_sales", "total_profit"),
    "02_discount_impact": (None, "sales", "profit"),
    "03_profit_by_subcategory": (None, "sales", "profit"),
    "04_yearly_trend": ("orders", "sales", "profit"),
    "05_region_performance": ("orders", "sales", "profit"),
    "06_segment_by_category": (None, "total_sales", None),
}


def conservation(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Whether the reports add up to the same lines, orders, sales and profit, to the last digit.

    The reports carry their unrounded sums (`exact=True`). These must be equal, as decimals, in all
    reports, and every figure shown must be the rounding of the sum beside it. So a cent that one
    report loses is noticed however many rows there are. Orders are compared where a report
    counts them.
    """

    def off(shown: str | None, exact: str) -> Column:
        if shown is None:
            return F.lit(False)
        return ~F.col(shown).eqNullSafe(round_n(F.col(exact), 0))

    sums = [
        reports[name].agg(
            F.lit(name).alias("report"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("exact_lines").alias("order_lines"),
            (F.sum(orders) if orders else F.lit(None)).cast("long").alias("orders"),
            F.sum("exact_sales").alias("sales"),
            F.sum("exact_profit").alias("profit"),
            F.count_if(off(sales, "exact_sales") | off(profit, "exact_profit")).alias("misrounded"),
        )
        for name, (orders, sales, profit) in CONSERVED.items()
    ]
    stacked = reduce(DataFrame.unionByName, sums)
    whole = Window.partitionBy()  # one row per report

    def agrees(column: str) -> Column:
        first = F.max(F.when(F.col("report") == "01_overview", F.col(column))).over(whole)
        return F.col(column).eqNullSafe(first)

    ok = (
        agrees("order_lines")
        & (agrees("orders") | F.col("orders").isNull())
        & agrees("sales")
        & agrees("profit")
        & (F.col("misrounded") == 0)
    )
    told = {c: F.col(c).cast("double") for c in ("sales", "profit")}
    return stacked.withColumn("ok", ok).withColumns(told).orderBy("report")


def returned_margin(lines: Facts, returned: DataFrame) -> DataFrame:
    """Orders, sales and margin of orders with and without a return, from one pass.

    `returned` holds each returned order once, so a line meets at most one row.
    """
    marked = lines.frame.join(returned.withColumn("_hit", F.lit(True)), "order_id", "left")
    flagged = Facts(marked.withColumn("returned", F.coalesce(F.col("_hit"), F.lit(False))))
    return (
        flagged.totals("returned", orders=True)
        .select(
            "returned",
            "orders",
            F.col("lines").alias("order_lines"),
            round_n(F.col("sales"), 0).alias("sales"),
            round_n(F.col("profit"), 0).alias("profit"),
            pct(F.col("profit"), F.col("sales"), 2).alias("margin_pct"),
        )
        .orderBy("returned")
    )
