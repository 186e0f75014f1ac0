"""Edge rows through the reports, and lines against cubes."""

import datetime as dt
import random

import pytest
from conftest import TESTDATA
from ledgerlens.operators.facts import CUBES, DATES, SUMS, count_orders, cubes, grouped_once, line_facts
from ledgerlens.plans import findings, reports
from ledgerlens.plans.pipeline import build_reports
from ledgerlens.plans.registered import SETTINGS
from ledgerlens.plans.settings import RETAIL
from ledgerlens.sources.retail_view import order_lines
from lines import make
from pyspark.sql import functions as F

Y = dt.date


def facts(spark, *changes):
    return line_facts(make(spark, *changes))


def test_bands_in_order_of_discount_and_null_in_the_last(spark):
    f = facts(spark, {"discount": 0.2}, {"discount": None, "profit": -1.0}, {"discount": 0.0},
              {"discount": 0.8}, {"discount": -0.1})
    rows = reports.discount_impact(f, RETAIL.band_edges, RETAIL.band_labels).collect()
    assert [r.discount_band for r in rows] == ["2. 10%", "1. 无折扣", "3. 15%/20%", "6. 45% 以上"]
    assert [r.order_lines for r in rows] == [1, 1, 1, 2]
    assert rows[-1].loss_line_pct == 50.0 and rows[0].sales_share_pct == 20.0


def test_zero_sales_gives_null_ratio(spark):
    f = facts(spark, {"sales": 0.0, "profit": -3.0})
    row = reports.overview(f).first()
    assert row.margin_pct is None and row.total_profit == -3.0 and row.avg_order_value == 0.0


def test_overview_of_no_lines(spark):
    empty = line_facts(make(spark, {}).filter("row_id < 0"))
    row = reports.overview(empty).first()
    assert (row.total_rows, row.total_orders, row.total_sales) == (0, 0, None)
    assert reports.threshold_sweep(empty, (0.1,)).count() == 0


def test_equal_profits_share_a_rank(spark):
    f = facts(spark, {"sub_category": "a", "profit": 1.0}, {"sub_category": "b", "profit": 1.0},
              {"sub_category": "c", "profit": 2.0})
    rows = reports.profit_rank(f, "category", "sub_category").collect()
    assert [(r.profit_rank_worst_first, r.cumulative_profit) for r in rows] == [
        (1, 1.0), (1, 2.0), (3, 4.0),
    ]


def test_missing_year_compares_with_the_row_before(spark):
    f = facts(spark, {"order_date": Y(2015, 1, 1), "sales": 100.0},
              {"order_date": Y(2018, 1, 1), "sales": 150.0, "order_id": "B"})
    first, last = reports.yearly_trend(f).collect()
    assert (first.prev_year_sales, first.sales_yoy_pct, first.margin_yoy_pp) == (None, None, None)
    assert (last.order_year, last.prev_year_sales, last.sales_yoy_pct) == (2018, 100.0, 50.0)


def test_state_without_high_discounts(spark):
    f = facts(spark, {"state": "Ohio", "profit": -5.0}, {"state": "Utah", "profit": 5.0},
              {"state": "Iowa", "profit": -0.4, "discount": 0.3})
    rows = reports.loss_split(f, "state", 0.2).collect()
    assert [(r.loss_rank, r.state) for r in rows] == [(1, "Ohio"), (2, "Iowa")]
    assert rows[0].high_band_profit is None and rows[0].high_band_line_pct == 0.0
    # Iowa loses 0.4: kept by its exact profit although it rounds to zero.
    assert str(rows[1].profit) == "0.0" and rows[1].low_band_profit is None


def test_pivot_leaves_absent_categories_null(spark):
    row = reports.segment_pivot(facts(spark, {}), "segment", "category", RETAIL.categories).first()
    assert (row.furniture_sales, row.office_sales, row.tech_margin) == (100.0, None, None)


def test_sweep_with_missing_discount_and_empty_sides(spark):
    f = facts(spark, {"discount": 0.1, "profit": 10.0}, {"discount": 0.3, "profit": -20.0},
              {"discount": None, "profit": 50.0})
    rows = reports.threshold_sweep(f, (0.3, 0.1, 0.2)).collect()
    assert [r.threshold_pct for r in rows] == [10, 20, 30]
    assert [r.high_band_profit for r in rows] == [-20.0, -20.0, None]
    assert rows[0].high_loss_pct_of_total_profit == -50.0  # of 40, the missing discount included
    stable = findings.sweep_stability(
        reports.threshold_sweep(f, (0.1, 0.2, 0.3), numbered=True)
    ).collect()
    assert [r.same_as_previous for r in stable] == [None, True, False]


def test_an_order_counts_once_per_region(spark):
    f = facts(spark, {"region": "East"}, {"region": "West"}, {"region": "West"}, {"region": None})
    rows = reports.dimension_performance(f, "region", 0.2).collect()
    assert {r.region: r.orders for r in rows} == {"East": 1, "West": 1, None: 1}
    shared = cubes(f).serving(("region",))
    again = reports.dimension_performance(shared, "region", 0.2).collect()
    assert {r.region: r.orders for r in again} == {"East": 1, "West": 1, None: 1}


def test_loss_totals(spark):
    f = facts(spark, *[{"state": s, "profit": p, "discount": 0.5}
                       for s, p in (("a", -9.0), ("b", -5.0), ("c", -3.0), ("d", 1.0))])
    rows = findings.loss_totals(reports.loss_split(f, "state", 0.2), "state", 1).collect()
    assert [(r.member, r.members, r.profit) for r in rows] == [
        ("a", 1, -9.0), ("all losing", 3, -17.0), ("others", 2, -8.0),
    ]


def conserved(f):
    return {r.report: r.ok for r in findings.conservation(build_reports(f, RETAIL, exact=True)).collect()}


def test_conservation_notices_an_order_in_two_regions(spark):
    whole = facts(spark, {"order_id": "A"}, {"order_id": "B", "region": "West"})
    torn = facts(spark, {"order_id": "A"}, {"order_id": "A", "region": "West"})
    assert all(conserved(whole).values())
    ok = conserved(torn)
    assert not ok["05_region_performance"] and ok["04_yearly_trend"]


def test_conservation_notices_one_cent(spark):
    """One of many lines is a cent short in one report; all figures shown stay the same."""
    f = facts(spark, *[{"sales": 100.25, "region": r, "order_id": f"{r}{k}"} for k in range(40) for r in ("East", "West")])
    built = build_reports(f, RETAIL, exact=True)
    assert all(r.ok for r in findings.conservation(built).collect())
    cent = F.when(F.col("region") == "East", F.col("exact_sales") - F.lit("0.01").cast("decimal(18,6)"))
    short = built["05_region_performance"].withColumn("exact_sales", F.coalesce(cent, "exact_sales"))
    ok = {r.report: r.ok for r in findings.conservation({**built, "05_region_performance": short}).collect()}
    assert [name for name, good in ok.items() if not good] == ["05_region_performance"]
    wrong = built["06_segment_by_category"].withColumn("total_sales", F.col("total_sales") + 1)
    rows = findings.conservation({**built, "06_segment_by_category": wrong}).collect()
    assert [(r.report, r.misrounded) for r in rows if not r.ok] == [("06_segment_by_category", 1)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_reports_read_the_lines_once_without_sorting(spark):
    """One scan of each table for sums and orders; hash aggregates only, and orders move once."""
    grouped = grouped_once(line_facts(order_lines(spark, f"{TESTDATA}/sf0.001")))
    plan = plan_of(grouped)
    for table, column in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        assert sum("FileScan" in x and column in x for x in plan.splitlines()) == 1, table
    aggregated = plan.split("Expand")[0]
    assert "Window" not in plan and "SortAggregate" not in plan and "Sort " not in aggregated
    rows = spark.createDataFrame([], "order_id string, order_year long, region string")
    counted = plan_of(count_orders(rows))
    assert "Window" not in counted and "Sort" not in counted
    assert counted.count("Exchange") == 2  # the orders, and a count for each member


def test_the_order_set_makes_no_sums(spark):
    """Sums that nobody reads are not shuffled beside every order."""
    f = facts(spark, {"order_id": "A"}, {"order_id": "A", "sales": None}, {"order_id": "B", "profit": -2.0})
    grouped = grouped_once(f)
    partial = next(x for x in plan_of(grouped).splitlines() if "partial_sum(" in x)
    assert partial.count("partial_sum(CASE WHEN") == partial.count("partial_sum(") == len(SUMS)
    assert partial.count("partial_min(CASE WHEN") == partial.count("partial_max(CASE WHEN") == len(DATES) // 2
    rows = [r.asDict() for r in grouped.collect()]
    orders = [r for r in rows if r["cube"] == len(CUBES)]
    assert sorted(r["order_id"] for r in orders) == ["A", "B"]
    assert all(r[m] is None for r in orders for m in (*SUMS, *DATES))
    assert {r["lines"] for r in rows if r["cube"] == 2} == {3}


def test_orders_count_once_for_each_member(spark):
    f = facts(spark, {"order_id": "A"}, {"order_id": "A", "order_date": Y(2017, 1, 1)},
              {"order_id": "A", "region": "West"}, {"order_id": None}, {"order_id": "B", "region": None})
    shared = cubes(f)
    got = {(r.grouping, r.order_year, r.region): r.orders for r in shared.order_counts.collect()}
    assert got == {
        ("", None, None): 2, ("order_year", 2016, None): 2, ("order_year", 2017, None): 1,
        ("region", None, "Central"): 1, ("region", None, "West"): 1, ("region", None, None): 1,
    }
    with pytest.raises(ValueError, match="order_id"):
        cubes(line_facts(make(spark, {}).drop("order_id")))


def test_returned_margin(spark):
    f = facts(spark, {"order_id": "A"}, {"order_id": "A"}, {"order_id": "B"})
    back = spark.createDataFrame([("A",), ("Z",)], "order_id string")
    rows = findings.returned_margin(f, back).collect()
    assert [(r.returned, r.orders, r.order_lines) for r in rows] == [(False, 1, 1), (True, 1, 2)]


def test_domain_gaps(spark):
    f = facts(spark, {"discount": 0.2}, {"discount": 0.3}, {"discount": 0.2}, {"discount": None})
    rows = findings.domain_gaps(f, "discount").collect()
    assert [(r.discount, r.order_lines, r.next_value) for r in rows] == [(0.2, 2, 0.3), (0.3, 1, None)]
    assert findings.domain_gaps(f, "discount", ranges=3).collect() == rows


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_cubes_give_the_same_reports_as_lines(spark, shared_and_lines, name):
    shared, lines = shared_and_lines
    got, want = shared[name], lines[name]
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.collect() == want.collect()


@pytest.fixture(scope="module")
def shared_and_lines(spark):
    f = line_facts(order_lines(spark, f"{TESTDATA}/sf0.001"))
    return build_reports(cubes(f), SETTINGS), build_reports(f, SETTINGS)


def test_no_cube_for_unknown_combination(spark):
    with pytest.raises(ValueError):
        cubes(facts(spark, {})).serving(("state", "category"))


def test_no_reports_registered(spark):
    with pytest.raises(ValueError):
        build_reports(facts(spark, {}), RETAIL, {})


def test_stability_does_not_depend_on_row_order(spark):
    """0.035 and 0.04 share the label 4; shuffled rows must still be compared in sweep order."""
    f = line_facts(make(spark, {"discount": 0.03}, {"discount": 0.038}, {"discount": 0.045}))
    sweep = reports.threshold_sweep(f, (0.02, 0.035, 0.04, 0.042), numbered=True)
    rows = sweep.collect()
    assert [r.threshold_pct for r in rows] == [2, 4, 4, 4]
    want = findings.sweep_stability(sweep).collect()
    assert [r.same_as_previous for r in want] == [None, False, False, True]
    for seed in range(4):
        mixed = random.Random(seed).sample(rows, len(rows))
        shuffled = spark.createDataFrame(mixed, sweep.schema).coalesce(1)
        assert findings.sweep_stability(shuffled).collect() == want


def test_open_ended_dimensions_give_the_same_rows(spark):
    lines = order_lines(spark, f"{TESTDATA}/sf0.001")
    few = reports.dimension_performance(line_facts(lines), "product_id", 0.05)
    many = reports.dimension_performance(line_facts(lines), "product_id", 0.05, open_ended=True)
    assert many.collect() == few.collect()
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan
