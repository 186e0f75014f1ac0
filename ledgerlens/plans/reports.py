"""The eight margin reports. Each takes facts (lines or a cube) and returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import band, literal, pct, ratio, round_n
from ledgerlens.operators.facts import Facts
from ledgerlens.operators.ranking import rank_and_run
from ledgerlens.plans.settings import Settings
from ledgerlens.session import durable


def _money(name: str, alias: str | None = None) -> Column:
    return round_n(F.col(name), 0).alias(alias or name)


def _margin(alias: str = "margin_pct", digits: int = 2) -> Column:
    return pct(F.col("profit"), F.col("sales"), digits).alias(alias)


def _line_share(part: str, alias: str) -> Column:
    return pct(F.col(part), F.col("lines"), 1).alias(alias)


# Unrounded sums that a report carries beside its figures when asked to.
EXACT = {"exact_lines": "lines", "exact_sales": "sales", "exact_profit": "profit"}


def _exact(wanted: bool) -> list[Column]:
    return [F.col(c).alias(name) for name, c in EXACT.items()] if wanted else []


def _ascending(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def overview(facts: Facts, exact: bool = False) -> DataFrame:
    """Key figures of the whole period in one row."""
    return facts.totals(orders=True).select(
        _money("sales", "total_sales"),
        _money("profit", "total_profit"),
        _margin(),
        F.col("orders").alias("total_orders"),
        F.col("lines").alias("total_rows"),
        round_n(ratio(F.col("sales"), F.col("orders")), 2).alias("avg_order_value"),
        F.col("first_date").alias("first_order_date"),
        F.col("last_date").alias("last_order_date"),
        _line_share("loss_lines", "loss_row_pct"),
        *_exact(exact),
    )


def discount_impact(
    facts: Facts, edges: Sequence[float], labels: Sequence[str], exact: bool = False
) -> DataFrame:
    """Margin by discount band, in order of discount; bands without lines do not appear."""
    banded = Facts(
        facts.frame.withColumn("discount_band", band(F.col("discount"), edges, labels))
    )
    per_band = banded.totals("discount_band", extra=[F.min("discount").alias("_lowest")])
    # The window runs over the bands, not over the lines.
    everything = F.sum("sales").over(Window.partitionBy())
    return (
        per_band.withColumn("_all_sales", everything)
        .orderBy(*_ascending("_lowest", "discount_band"))
        .select(
            "discount_band",
            F.col("lines").alias("order_lines"),
            _money("sales"),
            _money("profit"),
            _margin(),
            _line_share("loss_lines", "loss_line_pct"),
            pct(F.col("sales"), F.col("_all_sales"), 1).alias("sales_share_pct"),
            *_exact(exact),
        )
    )


def profit_rank(
    facts: Facts, *keys: str, ranges: int | None = None, exact: bool = False
) -> DataFrame:
    """Groups from worst to best profit, with the running profit. `ranges`: see `rank_and_run`."""
    ranked = rank_and_run(
        facts.totals(*keys), "profit", keys, "profit_rank_worst_first", "cumulative_profit", ranges
    )
    return ranked.select(
        *keys,
        F.col("lines").alias("order_lines"),
        _money("sales"),
        _money("profit"),
        _margin(),
        "profit_rank_worst_first",
        _money("cumulative_profit"),
        *_exact(exact),
    ).orderBy(*_ascending("profit", "profit_rank_worst_first", *keys))


def yearly_trend(facts: Facts, exact: bool = False) -> DataFrame:
    """Years with the change against the row before, taken from the rounded figures."""
    yearly = facts.totals("order_year", orders=True).select(
        "order_year", "orders", _money("sales"), _money("profit"), _margin(), *_exact(exact)
    )
    by_year = Window.orderBy(F.col("order_year").asc_nulls_last())
    before = F.col("prev_year_sales")
    return (
        yearly.withColumns(
            {
                "prev_year_sales": F.lag("sales").over(by_year),
                "_prev_margin": F.lag("margin_pct").over(by_year),
            }
        )
        .withColumns(
            {
                "sales_yoy_pct": pct(F.col("sales") - before, before, 1),
                "margin_yoy_pp": round_n(F.col("margin_pct") - F.col("_prev_margin"), 2),
            }
        )
        .select(
            "order_year", "orders", "sales", "profit", "margin_pct", "prev_year_sales",
            "sales_yoy_pct", "margin_yoy_pp", *(EXACT if exact else ()),
        )
        .orderBy(*_ascending("order_year"))
    )


def dimension_performance(
    facts: Facts, key: str, cut: float, open_ended: bool = False, exact: bool = False
) -> DataFrame:
    """Members of one dimension: size, margin, sales-weighted discount, share of high discounts.

    The total over all members is a window in one task, right for a few thousand members. For an
    `open_ended` dimension (products, customers) the members are written once and summed apart.
    """
    high = F.sum(F.when(F.col("discount") > literal(cut), F.col("lines")).otherwise(0))
    totals = facts.totals(key, orders=True, extra=[high.alias("high_lines")])
    if open_ended:
        totals = durable(totals, "members")
        all_sales = totals.agg(F.sum("sales")).scalar()
    else:
        all_sales = F.sum("sales").over(Window.partitionBy())
    return (
        totals.withColumn("_all_sales", all_sales)
        .select(
            key,
            "orders",
            _money("sales"),
            _money("profit"),
            _margin(),
            pct(F.col("sales"), F.col("_all_sales"), 1).alias("sales_share_pct"),
            pct(F.col("discount_sales"), F.col("sales"), 2).alias("weighted_discount_pct"),
            _line_share("high_lines", "high_discount_line_pct"),
            _line_share("loss_lines", "loss_line_pct"),
            *_exact(exact),
        )
        .orderBy(*_ascending("margin_pct", key))
    )


def segment_pivot(
    facts: Facts, row_key: str, pivot_key: str, values: Mapping[str, str], exact: bool = False
) -> DataFrame:
    """Sales and margin of each listed value side by side, one pass and no pivot discovery job."""

    def only(value: str, measure: str) -> Column:
        return F.sum(F.when(F.col(pivot_key) == value, F.col(measure)))

    extra = []
    for prefix, value in values.items():
        extra += [
            only(value, "sales").alias(f"_{prefix}_sales"),
            only(value, "profit").alias(f"_{prefix}_profit"),
        ]
    sales = [_money(f"_{p}_sales", f"{p}_sales") for p in values]
    margins = [
        pct(F.col(f"_{p}_profit"), F.col(f"_{p}_sales"), 1).alias(f"{p}_margin") for p in values
    ]
    return (
        facts.totals(row_key, extra=extra)
        .select(
            row_key, *sales, *margins, _money("sales", "total_sales"), _margin("overall_margin"),
            *_exact(exact),
        )
        .orderBy(F.col("overall_margin").desc_nulls_last(), *_ascending(row_key))
    )


def loss_split(facts: Facts, key: str, cut: float, ranges: int | None = None) -> DataFrame:
    """Members that lose money, their profit split at a discount cut.

    Ranks run over all members before the earning ones are left out.
    """
    low, high = F.col("discount") <= literal(cut), F.col("discount") > literal(cut)
    extra = [
        F.sum(F.when(low, F.col("sales"))).alias("low_sales"),
        F.sum(F.when(low, F.col("profit"))).alias("low_profit"),
        F.sum(F.when(high, F.col("profit"))).alias("high_profit"),
        F.sum(F.when(high, F.col("lines")).otherwise(0)).alias("high_lines"),
    ]
    ranked = rank_and_run(
        facts.totals(key, extra=extra), "profit", [key], "loss_rank", "_running", ranges
    )
    return (
        ranked.filter(F.col("profit") < 0)
        .select(
            "loss_rank",
            key,
            _money("sales"),
            _money("profit"),
            _margin(),
            _money("low_profit", "low_band_profit"),
            pct(F.col("low_profit"), F.col("low_sales"), 2).alias("low_band_margin_pct"),
            _money("high_profit", "high_band_profit"),
            _line_share("high_lines", "high_band_line_pct"),
        )
        .orderBy(*_ascending("profit", "loss_rank", key))
    )


def threshold_sweep(
    facts: Facts, thresholds: Sequence[float], numbered: bool = False
) -> DataFrame:
    """Margin below and above each threshold; `numbered` adds its place among them as `step`.

    Percent labels are whole numbers, so close thresholds may share one; the step never does.

    Lines are first summed by the interval between thresholds they fall in (one more interval
    than thresholds, whatever the number of discounts). Only those few sums meet the thresholds,
    so no line is ever multiplied. A missing discount lies on neither side but is part of the
    total.
    """
    steps = sorted(set(thresholds))
    passed = sum(((F.col("discount") > literal(t)).cast("int") for t in steps), F.lit(0))
    intervals = Facts(facts.frame.withColumn("_passed", passed)).totals("_passed")
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("_step"),
                F.round(literal(t) * 100, 0).cast("int").alias("threshold_pct"),
            )
            for i, t in enumerate(steps)
        ]
    )
    low, high = F.col("_passed") <= F.col("_step"), F.col("_passed") > F.col("_step")
    swept = (
        intervals.select("*", F.inline(points))
        .groupBy("_step", "threshold_pct")
        .agg(
            F.sum(F.when(low, F.col("sales"))).alias("low_sales"),
            F.sum(F.when(low, F.col("profit"))).alias("low_profit"),
            F.sum(F.when(high, F.col("sales"))).alias("high_sales"),
            F.sum(F.when(high, F.col("profit"))).alias("high_profit"),
            F.sum(F.col("profit")).alias("all_profit"),
        )
    )
    return swept.orderBy("_step").select(
        *([F.col("_step").alias("step")] if numbered else []),
        "threshold_pct",
        pct(F.col("low_profit"), F.col("low_sales"), 2).alias("low_margin_pct"),
        pct(F.col("high_profit"), F.col("high_sales"), 2).alias("high_margin_pct"),
        _money("high_profit", "high_band_profit"),
        pct(F.col("high_profit"), F.col("all_profit"), 1).alias("high_loss_pct_of_total_profit"),
    )


@dataclass(frozen=True)
class Report:
    """A named report: how to build it, the staging columns it reads, the order of its rows.

    A leading minus in `order` means descending. A report that `conserves` covers every line once and
    takes `exact=True`.
    """

    build: Callable[..., DataFrame]
    columns: tuple[str, ...]
    order: tuple[str, ...] = ()
    conserves: bool = True


# Run in name order.
REPORTS: dict[str, Report] = {
    "01_overview": Report(
        lambda f, s, **more: overview(f, **more), ("order_id", "order_date", "sales", "profit")
    ),
    "02_discount_impact": Report(
        lambda f, s, **more: discount_impact(f, s.band_edges, s.band_labels, **more),
        ("discount", "sales", "profit"),
        ("discount_band",),  # labels start with their position
    ),
    "03_profit_by_subcategory": Report(
        lambda f, s, **more: profit_rank(f, "category", "sub_category", **more),
        ("category", "sub_category", "sales", "profit"),
        ("profit_rank_worst_first", "category", "sub_category"),
    ),
    "04_yearly_trend": Report(
        lambda f, s, **more: yearly_trend(f, **more),
        ("order_id", "order_date", "sales", "profit"),
        ("order_year",),
    ),
    "05_region_performance": Report(
        lambda f, s, **more: dimension_performance(f, "region", s.cut, **more),
        ("order_id", "region", "discount", "sales", "profit"),
        ("margin_pct", "region"),
    ),
    "06_segment_by_category": Report(
        lambda f, s, **more: segment_pivot(f, "segment", "category", s.categories, **more),
        ("segment", "category", "sales", "profit"),
        ("-overall_margin", "segment"),
    ),
    "07_state_loss_split": Report(
        lambda f, s: loss_split(f, "state", s.cut),
        ("state", "discount", "sales", "profit"),
        ("loss_rank", "state"),
        conserves=False,  # earning states are left out
    ),
    "08_threshold_sensitivity": Report(
        lambda f, s: threshold_sweep(f, s.thresholds),
        ("discount", "sales", "profit"),
        ("threshold_pct",),
        conserves=False,  # every threshold covers all lines
    ),
}
