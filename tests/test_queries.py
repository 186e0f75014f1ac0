"""Every registered query against its SQL, over the whole tables."""

import importlib

import pytest
from compare import _plain as plain
from compare import differences, duck
from conftest import TESTDATA
from ledgerlens.plans.registered import QUERIES
from ledgerlens.plans.reports import REPORTS
from oracles import ORACLES


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def data(request):
    folder = f"{TESTDATA}/{request.param}"
    return folder, duck(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, name):
    folder, con = data
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []


# Queries that promise an order of rows; a leading minus means descending.
ORDERED = {
    "discount_impact": REPORTS["02_discount_impact"].order,
    "subcategory_profit": REPORTS["03_profit_by_subcategory"].order,
    "yearly_trend": REPORTS["04_yearly_trend"].order,
    "region_performance": REPORTS["05_region_performance"].order,
    "segment_by_category": REPORTS["06_segment_by_category"].order,
    "state_loss_split": REPORTS["07_state_loss_split"].order,
    "threshold_sensitivity": REPORTS["08_threshold_sensitivity"].order,
    "report_csv_roundtrip": REPORTS["03_profit_by_subcategory"].order,
    "run_summary": ("report",),
    "feed_discount": ("discount_band",),
    "feed_subcategory": ("profit", "category", "sub_category"),
    "feed_growth": ("order_year",),
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_the_promised_order(spark, data, name):
    folder, con = data
    rows = QUERIES[name](spark, folder).collect()
    by = ", ".join(
        f"{c.removeprefix('-')} {'DESC' if c.startswith('-') else 'ASC'} NULLS LAST" for c in ORDERED[name]
    )
    result = con.execute(f"SELECT * FROM ({ORACLES[name]}) ORDER BY {by}")
    columns = [d[0] for d in result.description]
    assert [tuple(plain(r[c]) for c in columns) for r in rows] == [
        tuple(map(plain, r)) for r in result.fetchall()
    ]


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 6
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
