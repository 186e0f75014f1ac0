"""Random order lines with NULLs, ties and edge discounts, under the retail parameters.

Every report is compared with SQL over the same rows, from the lines and from the cubes.
"""

import datetime as dt
import random

import duckdb
import pytest
from compare import differences
from ledgerlens.operators.facts import cubes, line_facts
from ledgerlens.operators.gates import run_gates
from ledgerlens.plans.pipeline import build_reports
from ledgerlens.plans.settings import RETAIL, RETAIL_GATES
from lines import SCHEMA
from oracles import LOSS, MARGIN, MONEY, OVERVIEW, YEARS, N, P, S, _pct, _rnd

DISCOUNTS = (0.0, 0.1, 0.15, 0.2, 0.3, 0.32, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8)


def random_lines(seed, n=1500):
    rng = random.Random(seed)

    def some(value, missing=0.03):
        return None if rng.random() < missing else value

    rows = []
    for _ in range(n):
        day = dt.date(2014, 12, 1) + dt.timedelta(days=rng.randrange(1550))
        rows.append(
            (
                some(rng.randrange(2 * n)),
                some(f"O-{rng.randrange(n // 3)}"),
                some(day),
                some(day + dt.timedelta(days=rng.randrange(-1, 8))),
                rng.choice(["First", "Second"]),
                some(f"C-{rng.randrange(50)}"),
                some(rng.choice(["one", "two", "three"])),
                some(rng.choice("abcdefghijklm")),
                some(rng.choice([*RETAIL_GATES.domains["region"], "Mars"])),
                some(f"P-{rng.randrange(80)}"),
                some(rng.choice([*RETAIL.categories.values(), "Toys"])),
                rng.choice(["x", "y", "z"]),
                some(round(rng.choice([0.0, 5.0, rng.uniform(0, 999)]), 2)),
                some(rng.randrange(0, 5)),
                some(rng.choice((*DISCOUNTS, -0.1, 0.85))),
                some(round(rng.uniform(-300, 300), 4)),
            )
        )
    return rows


LINES = """lines AS (SELECT * REPLACE (CAST(sales AS DECIMAL(18,6)) AS sales,
  CAST(profit AS DECIMAL(18,6)) AS profit, CAST(discount AS DECIMAL(18,6)) AS discount) FROM raw)"""

# The first band is the lines at its edge, the last one has none.
BAND_CASES = " ".join(
    f"WHEN discount {'=' if i == 0 else '<='} {edge} THEN '{label}'"
    for i, (edge, label) in enumerate(zip(RETAIL.band_edges, RETAIL.band_labels))
)
BANDS = f"""
SELECT CASE {BAND_CASES} ELSE '{RETAIL.band_labels[-1]}' END AS discount_band,
       {N} AS order_lines, {MONEY}, {MARGIN}, {_pct(LOSS, N, 1)} AS loss_line_pct,
       {_pct(S, '(SELECT SUM(sales) FROM lines)', 1)} AS sales_share_pct
FROM lines GROUP BY 1"""

SUBCATEGORIES = f"""
SELECT category, sub_category, n AS order_lines, {_rnd('s')} AS sales, {_rnd('p')} AS profit,
       {_pct('p', 's', 2)} AS margin_pct,
       CAST(RANK() OVER (ORDER BY p NULLS LAST) AS BIGINT) AS profit_rank_worst_first,
       {_rnd('''SUM(p) OVER (ORDER BY p NULLS LAST, category NULLS LAST, sub_category
                             ROWS UNBOUNDED PRECEDING)''')} AS cumulative_profit
FROM (SELECT category, sub_category, {N} AS n, {S} AS s, {P} AS p FROM lines GROUP BY 1, 2)"""

REGIONS = f"""
SELECT region, COUNT(DISTINCT order_id) AS orders, {MONEY}, {MARGIN},
       {_pct(S, '(SELECT SUM(sales) FROM lines)', 1)} AS sales_share_pct,
       {_pct('SUM(discount * sales)', S, 2)} AS weighted_discount_pct,
       {_pct(f'COUNT(*) FILTER (WHERE discount > {RETAIL.cut})', N, 1)} AS high_discount_line_pct,
       {_pct(LOSS, N, 1)} AS loss_line_pct
FROM lines GROUP BY region"""

PIVOT = RETAIL.categories


def of(value, measure):
    return f"SUM(CASE WHEN category = '{value}' THEN {measure} END)"


SEGMENTS = f"""
SELECT segment, {', '.join(f"{_rnd(of(v, 'sales'))} AS {k}_sales" for k, v in PIVOT.items())},
       {', '.join(f"{_pct(of(v, 'profit'), of(v, 'sales'), 1)} AS {k}_margin"
                  for k, v in PIVOT.items())},
       {_rnd(S)} AS total_sales, {_pct(P, S, 2)} AS overall_margin
FROM lines GROUP BY segment"""

STATES = f"""
SELECT CAST(loss_rank AS BIGINT) AS loss_rank, state, {_rnd('s')} AS sales, {_rnd('p')} AS profit,
       {_pct('p', 's', 2)} AS margin_pct, {_rnd('lp')} AS low_band_profit,
       {_pct('lp', 'ls', 2)} AS low_band_margin_pct, {_rnd('hp')} AS high_band_profit,
       {_pct('hn', 'n', 1)} AS high_band_line_pct
FROM (SELECT *, RANK() OVER (ORDER BY p NULLS LAST) AS loss_rank
      FROM (SELECT state, {S} AS s, {P} AS p, {N} AS n,
                   SUM(sales) FILTER (discount <= {RETAIL.cut}) AS ls,
                   SUM(profit) FILTER (discount <= {RETAIL.cut}) AS lp,
                   SUM(profit) FILTER (discount > {RETAIL.cut}) AS hp,
                   COUNT(*) FILTER (discount > {RETAIL.cut}) AS hn
            FROM lines GROUP BY state)) WHERE p < 0"""

SWEEP = " UNION ALL ".join(
    f"""SELECT CAST({round(t * 100)} AS INTEGER) AS threshold_pct,
       {_pct(f'SUM(CASE WHEN discount <= {t} THEN profit END)',
             f'SUM(CASE WHEN discount <= {t} THEN sales END)', 2)} AS low_margin_pct,
       {_pct(f'SUM(CASE WHEN discount > {t} THEN profit END)',
             f'SUM(CASE WHEN discount > {t} THEN sales END)', 2)} AS high_margin_pct,
       {_rnd(f'SUM(CASE WHEN discount > {t} THEN profit END)')} AS high_band_profit,
       {_pct(f'SUM(CASE WHEN discount > {t} THEN profit END)', P, 1)}
         AS high_loss_pct_of_total_profit FROM lines"""
    for t in RETAIL.thresholds
)

EXPECTED = {
    "01_overview": OVERVIEW,
    "02_discount_impact": BANDS,
    "03_profit_by_subcategory": SUBCATEGORIES,
    "04_yearly_trend": YEARS,
    "05_region_performance": REGIONS,
    "06_segment_by_category": SEGMENTS,
    "07_state_loss_split": STATES,
    "08_threshold_sensitivity": SWEEP,
}

R = RETAIL_GATES


def any_of(conditions):
    return f"SELECT {N} FROM raw WHERE " + " OR ".join(conditions)


def bounds(column, low, high, low_allowed):
    below = [] if low is None else [f"{column} {'<' if low_allowed else '<='} {low}"]
    return below + ([] if high is None else [f"{column} > {high}"])


GATES = {
    "pk_unique": f"SELECT {N} - COUNT(DISTINCT {R.key}) FROM raw",
    "no_null_keys": any_of(f"{c} IS NULL" for c in R.required_keys),
    "no_null_measures": any_of(f"{c} IS NULL" for c in R.required_measures),
    "date_sanity": any_of([
        f"{R.ship_date} < {R.order_date}",
        f"{R.order_date} NOT BETWEEN DATE '{R.first_day}' AND DATE '{R.last_day}'",
    ]),
    "value_range": any_of(c for name, rule in R.ranges.items() for c in bounds(name, *rule)),
    "enum_domain": any_of(f"{c} NOT IN {allowed}" for c, allowed in R.domains.items()),
    "order_grain_consistency": f"SELECT {N} FROM (SELECT {R.grain_key} FROM raw GROUP BY 1 HAVING "
    + " OR ".join(f"COUNT(DISTINCT {c}) > 1" for c in R.grain_columns)
    + ")",
}


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("random") / "lines.parquet")
    frame = spark.createDataFrame(random_lines(request.param), SCHEMA)
    frame.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw AS SELECT * FROM '{path}/*.parquet'")
    lines = spark.read.parquet(path)
    facts = line_facts(lines)
    return lines, build_reports(facts, RETAIL), build_reports(cubes(facts), RETAIL), con


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_report(data, name):
    _, from_lines, from_cubes, con = data
    sql = f"WITH {LINES} {EXPECTED[name]}"
    assert differences(from_lines[name], con, sql) == []
    assert differences(from_cubes[name], con, sql) == []


def test_gates(data):
    lines, *_, con = data
    got = {r.check_name: r.failed for r in run_gates(lines, RETAIL_GATES).collect()}
    want = {name: con.execute(sql).fetchone()[0] for name, sql in GATES.items()}
    assert got.pop("row_count") == R.expected_rows - 1500
    assert got == want and all(want.values())
