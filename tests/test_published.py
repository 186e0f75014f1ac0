"""Lines made to have published totals must give the published ratios."""

import datetime as dt

from ledgerlens.operators.facts import line_facts
from ledgerlens.plans import findings, reports
from lines import make

# Year, sales, profit, margin, growth, change of margin.
YEARS = (
    (2015, 484247, 49544, 10.23, None, None),
    (2016, 470533, 61619, 13.10, -2.8, 2.87),
    (2017, 609206, 81795, 13.43, 29.5, 0.33),
    (2018, 733215, 93439, 12.74, 20.4, -0.69),
)

# Region, sales, profit, margin, share of sales.
REGIONS = (
    ("Central", 501240, 39706, 7.92, 21.8),
    ("South", 391722, 46749, 11.93, 17.1),
    ("East", 678781, 91523, 13.48, 29.5),
    ("West", 725458, 108418, 14.94, 31.6),
)

# Threshold, profit above it, share of the total profit of 286,397.
SWEEP = (
    (10, -43620, -15.2),
    (15, -45039, -15.7),
    (20, -135376, -47.3),
    (25, -135376, -47.3),
    (30, -125007, -43.6),
    (35, -122616, -42.8),
)

# State, profit at discounts up to 20%, profit above.
STATES = (
    ("Texas", 8226, -33955),
    ("Ohio", 3256, -20227),
    ("Pennsylvania", 580, -16140),
    ("Illinois", 5829, -18437),
    ("North Carolina", 3586, -11077),
    ("Colorado", 1620, -8148),
    ("Tennessee", 1232, -6574),
    ("Arizona", 2301, -5729),
    ("Florida", 3831, -7230),
    ("Oregon", 948, -2138),
)


def close(got, want, tolerance=0.011):
    return (got is None) == (want is None) and (got is None or abs(got - want) <= tolerance)


def test_yearly_trend(spark):
    lines = make(spark, *[{"order_id": str(y), "order_date": dt.date(y, 5, 5), "sales": float(s),
                           "profit": float(p)} for y, s, p, *_ in YEARS])
    trend = reports.yearly_trend(line_facts(lines))
    for row, (year, sales, _, margin, growth, change) in zip(trend.collect(), YEARS):
        assert (row.order_year, row.sales) == (year, float(sales))
        assert close(row.margin_pct, margin) and close(row.sales_yoy_pct, growth)
        assert close(row.margin_yoy_pp, change)
    assert findings.growth_first_last(trend).first().growth_pct == 51.4


def test_regions(spark):
    lines = make(spark, *[{"region": r, "sales": float(s), "profit": float(p)}
                          for r, s, p, *_ in REGIONS])
    rows = reports.dimension_performance(line_facts(lines), "region", 0.2).collect()
    assert [r.region for r in rows] == [r[0] for r in REGIONS]  # worst margin first
    for row, (_, _, _, margin, share) in zip(rows, REGIONS):
        assert close(row.margin_pct, margin) and close(row.sales_share_pct, share)


def test_sweep(spark):
    # Profit between neighbouring thresholds is the difference of the profits above them.
    above = [p for _, p, _ in SWEEP]
    inside = [a - b for a, b in zip([286397, *above], [*above, 0])]
    at = [0.0, 0.15, 0.20, 0.25, 0.30, 0.32, 0.80]
    lines = make(spark, *[{"discount": d, "profit": float(p)} for d, p in zip(at, inside) if p])
    sweep = reports.threshold_sweep(line_facts(lines), [t / 100 for t, _, _ in SWEEP], numbered=True)
    rows = sweep.collect()
    assert [(r.threshold_pct, r.high_band_profit) for r in rows] == [
        (t, float(p)) for t, p, _ in SWEEP
    ]
    assert all(close(r.high_loss_pct_of_total_profit, s, 0.1) for r, (_, _, s) in zip(rows, SWEEP))
    same = {r.threshold_pct: r.same_as_previous for r in findings.sweep_stability(sweep).collect()}
    assert same[25] and not same[20] and not same[30]


def test_losing_states(spark):
    lines = make(spark, {"state": "Utah", "profit": 1.0}, *[
        {"state": s, "profit": float(p), "discount": d}
        for s, low, high in STATES for p, d in ((low, 0.2), (high, 0.3))
    ])
    split = reports.loss_split(line_facts(lines), "state", 0.2)
    rows = split.collect()
    assert [r.state for r in rows] == [s for s, _, _ in STATES]
    totals = {r.member: r for r in findings.loss_totals(split, "state", 4).collect()}
    assert totals["all losing"].low_band_profit == 31409.0
    assert totals["all losing"].high_band_profit == -129655.0
    assert totals["others"].members == 6 and totals["others"].profit == -27378.0
