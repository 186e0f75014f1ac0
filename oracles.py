"""SQL that states each registered query a second time, for comparison in another engine.

The SQL follows the meaning of the query, not its Spark plan: inner joins over all tables, one
aggregate per report, no cells, no ranges.
"""

from __future__ import annotations

LINES = """
lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_shipdate AS DATE) AS ship_date, o_orderpriority AS ship_mode,
         o_custkey AS customer_id, c_mktsegment AS segment, n_name AS state, r_name AS region,
         l_partkey AS product_id, p_type AS category, p_brand AS sub_category,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sales,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(
           1 - CAST(l_discount AS DECIMAL(4,2)) - (0.86 + 0.0012 * p_size
             + 0.006 * (n_nationkey % 10) + 0.01 * (CAST(substr(p_brand, 7) AS INTEGER) % 5))
           AS DECIMAL(6,4)) AS DECIMAL(18,6)) AS profit,
         l_returnflag
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = l_partkey
)"""


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _rnd(x: str, digits: int = 0) -> str:
    return f"(ROUND({_dbl(x)}, {digits}) + 0.0)"


def _pct(a: str, b: str, digits: int) -> str:
    return f"(ROUND(100.0 * {_dbl(a)} / NULLIF({_dbl(b)}, 0), {digits}) + 0.0)"


S, P, N = "SUM(sales)", "SUM(profit)", "COUNT(*)"
LOSS = "COUNT(*) FILTER (WHERE profit < 0)"
MONEY = f"{_rnd(S)} AS sales, {_rnd(P)} AS profit"
MARGIN = f"{_pct(P, S, 2)} AS margin_pct"

OVERVIEW = f"""
SELECT {_rnd(S)} AS total_sales, {_rnd(P)} AS total_profit, {MARGIN},
       COUNT(DISTINCT order_id) AS total_orders, {N} AS total_rows,
       ROUND({_dbl(S)} / NULLIF(COUNT(DISTINCT order_id), 0), 2) + 0.0 AS avg_order_value,
       MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
       {_pct(LOSS, N, 1)} AS loss_row_pct
FROM lines"""

BANDS = f"""
SELECT CASE WHEN discount = 0 THEN '1. none' WHEN discount <= 0.02 THEN '2. to 2%'
            WHEN discount <= 0.04 THEN '3. to 4%' WHEN discount <= 0.06 THEN '4. to 6%'
            WHEN discount <= 0.08 THEN '5. to 8%' ELSE '6. above 8%' END AS discount_band,
       {N} AS order_lines, {MONEY}, {MARGIN}, {_pct(LOSS, N, 1)} AS loss_line_pct,
       {_pct(S, '(SELECT SUM(sales) FROM lines)', 1)} AS sales_share_pct
FROM lines GROUP BY 1"""


def _ranked(keys: str) -> str:
    return f"""
SELECT {keys}, order_lines, {_rnd('s')} AS sales, {_rnd('p')} AS profit,
       {_pct('p', 's', 2)} AS margin_pct,
       CAST(RANK() OVER (ORDER BY p NULLS LAST) AS BIGINT) AS profit_rank_worst_first,
       {_rnd(f'SUM(p) OVER (ORDER BY p NULLS LAST, {keys} ROWS UNBOUNDED PRECEDING)')}
         AS cumulative_profit
FROM (SELECT {keys}, {N} AS order_lines, {S} AS s, {P} AS p FROM lines GROUP BY {keys})"""


SUBCATEGORIES = _ranked("category, sub_category")

YEARS = f"""
SELECT *, LAG(sales) OVER w AS prev_year_sales,
       ROUND(100.0 * (sales - LAG(sales) OVER w) / NULLIF(LAG(sales) OVER w, 0), 1) + 0.0
         AS sales_yoy_pct,
       ROUND(margin_pct - LAG(margin_pct) OVER w, 2) + 0.0 AS margin_yoy_pp
FROM (SELECT CAST(YEAR(order_date) AS BIGINT) AS order_year,
             COUNT(DISTINCT order_id) AS orders, {MONEY}, {MARGIN}
      FROM lines GROUP BY 1)
WINDOW w AS (ORDER BY order_year)"""

REGIONS = f"""
SELECT region, COUNT(DISTINCT order_id) AS orders, {MONEY}, {MARGIN},
       {_pct(S, '(SELECT SUM(sales) FROM lines)', 1)} AS sales_share_pct,
       {_pct('SUM(discount * sales)', S, 2)} AS weighted_discount_pct,
       {_pct('COUNT(*) FILTER (WHERE discount > 0.05)', N, 1)} AS high_discount_line_pct,
       {_pct(LOSS, N, 1)} AS loss_line_pct
FROM lines GROUP BY region"""

CATEGORIES = ("economy", "large", "medium", "promo", "small", "standard")


def _of(category: str, measure: str) -> str:
    return f"SUM({measure}) FILTER (WHERE category = '{category.upper()}')"


SEGMENTS = f"""
SELECT segment,
       {', '.join(f"{_rnd(_of(c, 'sales'))} AS {c}_sales" for c in CATEGORIES)},
       {', '.join(
           f"{_pct(_of(c, 'profit'), _of(c, 'sales'), 1)} AS {c}_margin" for c in CATEGORIES
       )},
       {_rnd(S)} AS total_sales, {_pct(P, S, 2)} AS overall_margin
FROM lines GROUP BY segment"""

STATES = f"""
SELECT CAST(loss_rank AS BIGINT) AS loss_rank, state, {_rnd('s')} AS sales, {_rnd('p')} AS profit,
       {_pct('p', 's', 2)} AS margin_pct, {_rnd('low_p')} AS low_band_profit,
       {_pct('low_p', 'low_s', 2)} AS low_band_margin_pct, {_rnd('high_p')} AS high_band_profit,
       {_pct('high_n', 'n', 1)} AS high_band_line_pct
FROM (SELECT *, RANK() OVER (ORDER BY p NULLS LAST) AS loss_rank
      FROM (SELECT state, {S} AS s, {P} AS p, {N} AS n,
                   SUM(sales) FILTER (WHERE discount <= 0.05) AS low_s,
                   SUM(profit) FILTER (WHERE discount <= 0.05) AS low_p,
                   SUM(profit) FILTER (WHERE discount > 0.05) AS high_p,
                   COUNT(*) FILTER (WHERE discount > 0.05) AS high_n
            FROM lines GROUP BY state))
WHERE p < 0"""


def _sweep(*thresholds: str) -> str:
    low, high = "FILTER (WHERE discount <= t)", "FILTER (WHERE discount > t)"
    values = ", ".join(f"(CAST({t} AS DECIMAL(4,3)))" for t in thresholds)
    return f"""
SELECT CAST(ROUND(t * 100) AS INTEGER) AS threshold_pct,
       {_pct(f'SUM(profit) {low}', f'SUM(sales) {low}', 2)} AS low_margin_pct,
       {_pct(f'SUM(profit) {high}', f'SUM(sales) {high}', 2)} AS high_margin_pct,
       {_rnd(f'SUM(profit) {high}')} AS high_band_profit,
       {_pct(f'SUM(profit) {high}', '(SELECT SUM(profit) FROM lines)', 1)}
         AS high_loss_pct_of_total_profit, t
FROM (VALUES {values}) AS thresholds(t), lines GROUP BY t"""


SWEEP = f"SELECT * EXCLUDE (t) FROM ({_sweep('0.02', '0.04', '0.06', '0.08')})"

METRICS = (
    "low_margin_pct",
    "high_margin_pct",
    "high_band_profit",
    "high_loss_pct_of_total_profit",
)
STABILITY = f"""
SELECT threshold_pct, LAG(threshold_pct) OVER w AS previous_threshold_pct,
       CASE WHEN LAG(threshold_pct) OVER w IS NOT NULL THEN
         {' AND '.join(f'{m} IS NOT DISTINCT FROM LAG({m}) OVER w' for m in METRICS)}
       END AS same_as_previous
FROM ({_sweep('0.02', '0.03', '0.035', '0.04', '0.045', '0.05')})
WINDOW w AS (ORDER BY t)"""

GRAIN = ("order_date", "ship_date", "customer_id", "ship_mode", "state", "region", "segment")
GATES = {
    "row_count": (
        "'50000 rows expected'",
        f"SELECT ABS({N} - 50000) FROM lines",
    ),
    "pk_unique": (
        "'row_id is present and unique'",
        f"SELECT {N} - COUNT(DISTINCT CASE WHEN order_id % 89 = 0 THEN CAST(order_id AS VARCHAR)"
        " ELSE row_id END) FROM lines",
    ),
    "no_null_keys": (
        "'order_id, customer_id, product_id are present'",
        f"SELECT {N} FROM lines"
        " WHERE order_id IS NULL OR customer_id IS NULL OR product_id IS NULL OR product_id % 97 = 0",
    ),
    "no_null_measures": (
        "'sales, quantity, discount, profit are present'",
        f"SELECT {N} FROM lines WHERE sales IS NULL OR quantity IS NULL OR quantity = 13"
        " OR discount IS NULL OR profit IS NULL",
    ),
    "date_sanity": (
        "'ship_date not before order_date, which lies in 1995-01-01 .. 2000-12-31'",
        f"SELECT {N} FROM lines WHERE ship_date < order_date"
        " OR order_date NOT BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'",
    ),
    "value_range": (
        "'discount, quantity, sales are in range'",
        f"SELECT {N} FROM lines WHERE discount NOT BETWEEN 0 AND 0.08 OR quantity <= 0"
        " OR sales <= 0",
    ),
    "enum_domain": (
        "'category, region hold listed values'",
        f"SELECT {N} FROM lines"
        " WHERE category NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL')"
        " OR region NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')",
    ),
    "order_grain_consistency": (
        f"'one value per order_id of {', '.join(GRAIN)}'",
        f"SELECT {N} FROM (SELECT order_id FROM lines GROUP BY order_id HAVING "
        + " OR ".join(f"COUNT(DISTINCT {c}) > 1" for c in GRAIN)
        + ")",
    ),
}
GATE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, {text} AS description, CAST(({sql}) AS BIGINT) AS failed"
    for name, (text, sql) in GATES.items()
)

DOMAIN = f"""
SELECT {_dbl('discount')} AS discount, order_lines,
       {_dbl('LEAD(discount) OVER w')} AS next_value,
       {_dbl('LEAD(discount) OVER w - discount')} AS gap
FROM (SELECT discount, {N} AS order_lines FROM lines GROUP BY discount)
WINDOW w AS (ORDER BY discount)"""

CUT = f"""
SELECT CASE WHEN discount <= 0.05 THEN 'at or below cut' WHEN discount > 0.05 THEN 'above cut'
            ELSE 'no discount given' END AS side,
       {N} AS order_lines, {_pct(N, '(SELECT COUNT(*) FROM lines)', 1)} AS line_share_pct,
       {_rnd(S)} AS sales, {_pct(S, '(SELECT SUM(sales) FROM lines)', 1)} AS sales_share_pct,
       {_rnd(P)} AS profit
FROM lines GROUP BY 1"""

STATE_TOTALS = f"""
SELECT member, COUNT(*) AS members, SUM(profit) AS profit,
       SUM(low_band_profit) AS low_band_profit,
       MIN(low_band_margin_pct) AS lowest_low_band_margin_pct,
       MAX(low_band_margin_pct) AS highest_low_band_margin_pct,
       SUM(high_band_profit) AS high_band_profit
FROM (SELECT *, CASE WHEN loss_rank <= 2 THEN state ELSE 'others' END AS member FROM states
      UNION ALL SELECT *, 'all losing' FROM states)
GROUP BY member"""

GROWTH = """
SELECT MIN(order_year) AS first_year, MAX(order_year) AS last_year,
       MIN_BY(sales, order_year) AS first_sales, MAX_BY(sales, order_year) AS last_sales,
       MIN(margin_pct) AS lowest_margin_pct, MAX(margin_pct) AS highest_margin_pct,
       ROUND(100.0 * (MAX_BY(sales, order_year) - MIN_BY(sales, order_year))
             / NULLIF(MIN_BY(sales, order_year), 0), 1) + 0.0 AS growth_pct
FROM years"""

# report name -> (grouping, whether it counts orders); the sums are taken without rounding
CONSERVED = {
    "01_overview": ("'all'", True),
    "02_discount_impact": (
        "CASE WHEN discount = 0 THEN 0 ELSE least(floor((100 * discount - 1) / 2), 4) + 1 END", False
    ),
    "03_profit_by_subcategory": ("category, sub_category", False),
    "04_yearly_trend": ("year(order_date)", True),
    "05_region_performance": ("region", True),
    "06_segment_by_category": ("segment", False),
}
CONSERVATION = " UNION ALL ".join(
    f"SELECT '{name}' AS report, COUNT(*) AS n_rows, CAST(SUM(n) AS BIGINT) AS order_lines,"
    f" {'CAST(SUM(o) AS BIGINT)' if orders else 'CAST(NULL AS BIGINT)'} AS orders,"
    f" SUM(s) AS sales, SUM(p) AS profit"
    f" FROM (SELECT {N} AS n, COUNT(DISTINCT order_id) AS o, {S} AS s, {P} AS p FROM lines GROUP BY {keys})"
    for name, (keys, orders) in CONSERVED.items()
)
CONSERVATION = f"""
SELECT c.report, c.n_rows, c.order_lines, c.orders, {_dbl("c.sales")} AS sales, {_dbl("c.profit")} AS profit,
       CAST(0 AS BIGINT) AS misrounded,
       c.order_lines = t.n AND coalesce(c.orders = t.o, TRUE) AND c.sales = t.s AND c.profit = t.p AS ok
FROM ({CONSERVATION}) c,
     (SELECT {N} AS n, COUNT(DISTINCT order_id) AS o, {S} AS s, {P} AS p FROM lines) t"""

REPORT_CTES = {
    "overview": OVERVIEW,
    "bands": BANDS,
    "subcategories": SUBCATEGORIES,
    "years": YEARS,
    "regions": REGIONS,
    "segments": SEGMENTS,
    "states": STATES,
    "sweep": SWEEP,
}
# report name -> (CTE, number of columns)
SUMMARY = {
    "01_overview": ("overview", 9),
    "02_discount_impact": ("bands", 7),
    "03_profit_by_subcategory": ("subcategories", 8),
    "04_yearly_trend": ("years", 8),
    "05_region_performance": ("regions", 9),
    "06_segment_by_category": ("segments", 15),
    "07_state_loss_split": ("states", 9),
    "08_threshold_sensitivity": ("sweep", 5),
}
RUN_SUMMARY = " UNION ALL ".join(
    f"SELECT '{name}' AS report, COUNT(*) AS n_rows, CAST({n} AS BIGINT) AS n_cols FROM {cte}"
    for name, (cte, n) in SUMMARY.items()
)

FEED_DISCOUNT = """
SELECT discount_band, margin_pct, CASE WHEN margin_pct < 0 THEN 'loss' ELSE 'profit' END AS sign,
       format('{:.1f}%', margin_pct) AS label,
       margin_pct + CASE WHEN margin_pct >= 0 THEN 1.6 ELSE -3.4 END AS label_y,
       CAST((SELECT COUNT(*) FROM bands WHERE left(discount_band, 1) <= '3') - 0.5 AS DOUBLE)
         AS split_at
FROM bands"""

FEED_SUBCATEGORY = """
SELECT category, sub_category, profit,
       CASE WHEN profit < 0 THEN 'loss' ELSE 'profit' END AS sign,
       format('{:,.0f}', profit) AS label,
       profit + CASE WHEN profit < 0 THEN -0.06 ELSE 0.06 END * pad AS label_x,
       low - pad AS axis_low, high + pad AS axis_high
FROM subcategories, (SELECT MIN(profit) AS low, MAX(profit) AS high,
                            (MAX(profit) - MIN(profit)) * CAST(0.16 AS DOUBLE) AS pad
                     FROM subcategories)"""

FEED_GROWTH = """
SELECT CAST(order_year AS VARCHAR) AS order_year, sales, margin_pct,
       format('{:.2f}%', margin_pct) AS label, margin_pct + 0.55 AS label_y,
       (SELECT MIN(margin_pct) FROM years) - 3.0 AS axis_low,
       (SELECT MAX(margin_pct) FROM years) + 3.0 AS axis_high
FROM years"""

RETURNED = f"""
SELECT order_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned,
       COUNT(DISTINCT order_id) AS orders, {N} AS order_lines, {MONEY}, {MARGIN}
FROM lines GROUP BY 1"""

CSV_ROWS = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
       o_orderpriority || ', "' || o_orderstatus || '"' AS ship_mode,
       CAST(o_totalprice AS DECIMAL(18,2)) AS order_total, CAST(NULL AS VARCHAR) AS note
FROM orders"""

FOREIGN_ROWS = """
SELECT c_name || ',' || c_nationkey AS line FROM customer
UNION ALL SELECT 'Yes,' || l_orderkey FROM
  (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT repeat(' ', n_nationkey) FROM nation"""

# The long note is one record of the first region, of about 5 MB.
MESSY_ROWS = """
SELECT o_orderkey AS order_id, o_orderpriority || ' 5" pipe' AS size_text,
       CAST(length(o_orderstatus) + 7 AS BIGINT) AS note_chars,
       'x' || chr(13) || chr(10) || '"' || o_orderstatus || '",' || chr(10) AS note_head
FROM orders
UNION ALL
SELECT -1, r_name, CAST(300000 * (length(r_name) + 9) AS BIGINT),
       substr(repeat(r_name || ', line' || chr(13) || chr(10) || ' ', 5), 1, 20)
FROM region WHERE r_regionkey = 0"""


def _over(body: str, *ctes: str) -> str:
    named = "".join(f",\n{name} AS ({REPORT_CTES[name]})" for name in ctes)
    return f"WITH {LINES}{named}\n{body}"


ORACLES: dict[str, str] = {
    "staging_orders": _over("SELECT * EXCLUDE (l_returnflag) FROM lines"),
    "overview": _over(OVERVIEW),
    "discount_impact": _over(BANDS),
    "subcategory_profit": _over(SUBCATEGORIES),
    "yearly_trend": _over(YEARS),
    "region_performance": _over(REGIONS),
    "segment_by_category": _over(SEGMENTS),
    "state_loss_split": _over(STATES),
    "threshold_sensitivity": _over(SWEEP),
    "quality_gates": _over(f"SELECT *, failed = 0 AS ok FROM ({GATE_ROWS})"),
    "product_profit_rank": _over(_ranked("product_id")),
    "category_margin": _over(
        f"SELECT category, {N} AS order_lines, {MONEY}, {MARGIN} FROM lines GROUP BY category"
    ),
    "measure_domain_gaps": _over(DOMAIN),
    "cut_totals": _over(CUT),
    "loss_state_totals": _over(STATE_TOTALS, "states"),
    "growth_first_last": _over(GROWTH, "years"),
    "threshold_stability": _over(STABILITY),
    "conservation": _over(CONSERVATION),
    "run_summary": _over(RUN_SUMMARY, *REPORT_CTES),
    "feed_discount": _over(FEED_DISCOUNT, "bands"),
    "feed_subcategory": _over(FEED_SUBCATEGORY, "subcategories"),
    "feed_growth": _over(FEED_GROWTH, "years"),
    "returned_order_margin": _over(RETURNED),
    "csv_contract": CSV_ROWS,
    "csv_quarantine": FOREIGN_ROWS,
    "csv_file_contract": CSV_ROWS.replace("', \"'", "',' || chr(10) || '\"'"),
    "csv_file_quarantine": FOREIGN_ROWS,
    "csv_messy_files": MESSY_ROWS,
    "raw_landing": f"""SELECT 'kept' AS layer, (SELECT COUNT(*) FROM orders) AS counted,
       concat_ws('|', o_orderkey, o_custkey, strftime(o_orderdate, '%-m/%-d/%Y'),
                 o_orderpriority || ',' || chr(10) || '"' || o_orderstatus || '"',
                 CAST(o_totalprice AS DECIMAL(18,2))) AS line FROM orders
UNION ALL SELECT 'rejected', (SELECT COUNT(*) FROM ({FOREIGN_ROWS})), line FROM ({FOREIGN_ROWS})""",
    "staging_publish": _over("SELECT order_id, product_id, discount, sales FROM lines"),
    "pipeline_reports": _over(
        "SELECT *, (SELECT COUNT(*) FROM lines) AS raw_rows,"
        " (SELECT COUNT(*) FROM region) AS rejected_rows,"
        f" (SELECT COUNT(*) FROM lines) AS staging_rows FROM ({RUN_SUMMARY})",
        *REPORT_CTES,
    ),
    "load_counts": f"SELECT 'kept' AS layer, COUNT(*) AS n_rows FROM orders"
    f" UNION ALL SELECT 'rejected', COUNT(*) FROM ({FOREIGN_ROWS})",
    "report_csv_roundtrip": _over(SUBCATEGORIES),
}
