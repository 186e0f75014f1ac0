"""The queries run against the star-schema test tables, by name."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.facts import Facts, cubes, line_facts
from ledgerlens.operators.gates import GateFailure, GateRules, run_gates
from ledgerlens.plans import findings, reports
from ledgerlens.plans.feeds import feed_discount, feed_growth, feed_subcategory
from ledgerlens.plans.pipeline import build_reports, run_pipeline, run_summary
from ledgerlens.plans.settings import Settings
from ledgerlens.session import durable, new_folder, plan_bytes, shuffle_tasks, shuffles_released
from ledgerlens.sources.contract import US_DATE, to_staging
from ledgerlens.sources.landing import (
    BAD,
    Landed,
    land_raw_csv,
    mark_lines,
    parse_lines,
    read_raw_csv,
)
from ledgerlens.sources.retail_view import COLUMNS, order_lines, returned_orders, table
from ledgerlens.sources.tables import publish, read_report, write_report

Query = Callable[[SparkSession, str], DataFrame]

# Discounts in these tables run from 0.00 to 0.10, so bands, cut and thresholds are scaled down.
SETTINGS = Settings(
    band_edges=(0, 0.02, 0.04, 0.06, 0.08),
    band_labels=("1. none", "2. to 2%", "3. to 4%", "4. to 6%", "5. to 8%", "6. above 8%"),
    cut=0.05,
    thresholds=(0.02, 0.04, 0.06, 0.08),
    categories={
        "economy": "ECONOMY",
        "large": "LARGE",
        "medium": "MEDIUM",
        "promo": "PROMO",
        "small": "SMALL",
        "standard": "STANDARD",
    },
)

GRAIN_COLUMNS = (
    "order_id", "order_date", "ship_date", "customer_id", "ship_mode", "state", "region", "segment",
)
GATE_COLUMNS = tuple(
    c for c in COLUMNS if c not in ("row_id", "sub_category", "ship_mode", "state", "segment")
)


def _facts(spark: SparkSession, folder: str, columns: tuple[str, ...]) -> Facts:
    return line_facts(order_lines(spark, folder, columns))


def _report(name: str) -> Query:
    report = reports.REPORTS[name]
    return lambda spark, folder: report.build(_facts(spark, folder, report.columns), SETTINGS)


SHARED_COLUMNS = (
    "order_id", "category", "sub_category", "segment", "state", "region", "order_date", "discount",
    "sales", "profit",
)


def _all_reports(spark: SparkSession, folder: str, exact: bool = False) -> dict[str, DataFrame]:
    """The eight reports from one shared pass over the lines."""
    return build_reports(cubes(_facts(spark, folder, SHARED_COLUMNS)), SETTINGS, exact=exact)


def gate_rules(expected_rows: int) -> GateRules:
    return GateRules(
        expected_rows=expected_rows,
        key="row_id",
        required_keys=("order_id", "customer_id", "product_id"),
        required_measures=("sales", "quantity", "discount", "profit"),
        order_date="order_date",
        ship_date="ship_date",
        first_day=dt.date(1995, 1, 1),
        last_day=dt.date(2000, 12, 31),
        ranges={
            "discount": (0, 0.08, True),
            "quantity": (0, None, False),
            "sales": (0, None, False),
        },
        domains={
            "category": ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"),
            "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
        },
        grain_key="order_id",
        grain_columns=GRAIN_COLUMNS[1:],
    )


# A fixed number, unlike the tables' at any scale, so that the row count is compared as well.
EXPECTED_ROWS = 50_000


def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    """All gates; some rules are tighter than the data so that failures are compared too.

    Some values are blanked and some keys repeated, so that every gate finds offenders.
    """
    lines = order_lines(spark, folder, GATE_COLUMNS).withColumns(
        {
            "product_id": F.when(F.col("product_id") % 97 != 0, F.col("product_id")),
            "quantity": F.when(F.col("quantity") != 13, F.col("quantity")),
        }
    )
    shared = F.when(F.col("order_id") % 89 == 0, F.col("order_id").cast("string"))
    keys = order_lines(spark, folder, ("order_id", "row_id")).select(
        F.coalesce(shared, "row_id").alias("row_id")
    )
    grain = order_lines(spark, folder, GRAIN_COLUMNS)
    return run_gates(lines, gate_rules(EXPECTED_ROWS), key_rows=keys, grain_rows=grain)


def product_profit_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The profit ranking for an open-ended dimension, sorted in ranges side by side."""
    facts = _facts(spark, folder, ("product_id", "sales", "profit"))
    return reports.profit_rank(facts, "product_id", ranges=shuffle_tasks(spark))


def category_margin(spark: SparkSession, folder: str) -> DataFrame:
    return findings.group_margin(_facts(spark, folder, ("category", "sales", "profit")), "category")


def measure_domain_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return findings.domain_gaps(_facts(spark, folder, ("discount",)), "discount")


def cut_totals(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder, ("discount", "sales", "profit"))
    return findings.cut_totals(facts, SETTINGS.cut)


def loss_state_totals(spark: SparkSession, folder: str) -> DataFrame:
    return findings.loss_totals(_report("07_state_loss_split")(spark, folder), "state", 2)


def growth_first_last(spark: SparkSession, folder: str) -> DataFrame:
    return findings.growth_first_last(_report("04_yearly_trend")(spark, folder))


def threshold_stability(spark: SparkSession, folder: str) -> DataFrame:
    """A finer sweep whose in-between thresholds change nothing."""
    facts = _facts(spark, folder, ("discount", "sales", "profit"))
    sweep = reports.threshold_sweep(facts, (0.02, 0.03, 0.035, 0.04, 0.045, 0.05), numbered=True)
    return findings.sweep_stability(sweep)


def conservation(spark: SparkSession, folder: str) -> DataFrame:
    return findings.conservation(_all_reports(spark, folder, exact=True))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return run_summary(_all_reports(spark, folder))


def returned_order_margin(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder, ("order_id", "sales", "profit"))
    return findings.returned_margin(facts, returned_orders(spark, folder))


def discount_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_discount(
        _report("02_discount_impact")(spark, folder),
        SETTINGS.band_edges, SETTINGS.band_labels, SETTINGS.cut,
    )


def subcategory_feed(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _report("03_profit_by_subcategory")(spark, folder)
    return feed_subcategory(ranked, "category", "sub_category")


def growth_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_growth(_report("04_yearly_trend")(spark, folder))


CSV_CONTRACT = (
    ("Order ID", "order_id", "bigint"),
    ("Customer ID", "customer_id", "bigint"),
    ("Order Date", "order_date", "date"),
    ("Ship Mode", "ship_mode", "string"),
    ("Order-Total", "order_total", "decimal(18,2)"),
    ("Note", "note", "string"),
)


CSV_HEADER = [source for source, _, _ in CSV_CONTRACT]


def _delivery_lines(spark: SparkSession, folder: str, gap: str) -> DataFrame:
    """Every order as a CSV record, mixed with the lines of two foreign sheets and blank ones.

    The ship mode is quoted and holds a comma, doubled quotes and the `gap`; the last field is
    empty.
    """
    order_csv = F.concat_ws(
        ",",
        "o_orderkey",
        "o_custkey",
        F.date_format("o_orderdate", "M/d/yyyy"),
        F.concat(F.lit('"'), "o_orderpriority", F.lit(f',{gap}""'), "o_orderstatus", F.lit('"""')),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.lit(""),
    )
    lines = table(spark, folder, "orders").select(order_csv.alias("value"))
    people = table(spark, folder, "customer").select(F.concat_ws(",", "c_name", "c_nationkey"))
    returns = returned_orders(spark, folder).select(F.concat_ws(",", F.lit("Yes"), "order_id"))
    blank = table(spark, folder, "nation").select(F.repeat(F.lit(" "), "n_nationkey"))
    return lines.union(people).union(returns).union(blank)


def _delivery(spark: SparkSession, folder: str) -> Landed:
    return parse_lines(_delivery_lines(spark, folder, " "), CSV_HEADER)


def _delivery_files(spark: SparkSession, folder: str) -> Landed:
    """The same as text files with a header each, and with line breaks inside the ship mode."""
    body = _delivery_lines(spark, folder, "\n")
    return read_raw_csv(spark, _written(spark, "delivery", [",".join(CSV_HEADER)], body))


MESSY_CONTRACT = (("Order ID", "order_id", "bigint"), ("Size", "size_text", "string"), ("Note", "note", "string"))
MESSY_HEADER = [source for source, _, _ in MESSY_CONTRACT]


def _written(spark: SparkSession, name: str, heads: list[str], body: DataFrame) -> str:
    """Files of the lines in `body`, each beginning with the lines in `heads`."""
    files = shuffle_tasks(spark)
    placed = body.select(
        F.pmod(F.xxhash64("value"), F.lit(files)).alias("file"), F.lit(len(heads)).alias("place"), "value"
    )
    for place, line in enumerate(heads):
        head = spark.range(files).select(
            F.col("id").alias("file"), F.lit(place).alias("place"), F.lit(line).alias("value")
        )
        placed = placed.unionByName(head)
    placed = placed.repartition("file").sortWithinPartitions("file", "place")
    target = new_folder(spark, name)
    placed.drop("place").write.partitionBy("file").text(target)
    return f"{target}/file=*"


LINES_PER_FILE = 250_000
# From this size of the lines table on, its delivery is written in as many parts, one after another.
PARTS, PARTS_FROM = 2, 128 * 1024 * 1024


def _written_in_place(spark: SparkSession, name: str, head: str, bodies: list[DataFrame]) -> str:
    """Compressed files of the lines in `bodies`, each beginning with the line `head`.

    Lines are written by the tasks that make them, neither shuffled nor sorted. A compressed file is
    read by one task, so a task's lines go to files of LINES_PER_FILE: the writer begins another one
    where the next head is due. One more file holds the head alone, for bodies without lines.
    Bodies are written one after another; what one shuffled to be made is gone before the next.
    """
    target = new_folder(spark, name)
    packed = {"compression": "gzip"}
    within_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = F.when(F.col("place") == 0, F.array(F.lit(head), "value")).otherwise(F.array("value"))
    with shuffles_released(spark):
        for body in bodies:
            placed = body.select("value", (within_task % LINES_PER_FILE).alias("place"))
            headed = placed.select(F.explode(lines).alias("value"))
            writer = headed.write.mode("append").options(**packed)
            writer.option("maxRecordsPerFile", LINES_PER_FILE + 1).text(target)
        alone = spark.createDataFrame([(head,)], "value string").coalesce(1)
        alone.write.mode("append").options(**packed).text(target)
    return target


def csv_messy_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as spreadsheets leave them: CR LF line ends, also inside fields, inch marks in plain
    fields, a blank first line and one closed field of several megabytes."""
    note = F.concat(F.lit('"x\r\n""'), "o_orderstatus", F.lit('"",\n"\r'))
    pipe = F.concat("o_orderpriority", F.lit(' 5" pipe'))
    lines = table(spark, folder, "orders").select(
        F.concat_ws(",", "o_orderkey", pipe, note).alias("value")
    )
    region = table(spark, folder, "region").filter("r_regionkey = 0")
    long = F.repeat(F.concat("r_name", F.lit(", line\r\n ")), F.lit(300_000))
    lines = lines.union(region.select(F.concat(F.lit("-1,"), "r_name", F.lit(',"'), long, F.lit('"\r'))))
    path = _written(spark, "messy", ["\r", ",".join(MESSY_HEADER) + "\r"], lines)
    staged = to_staging(read_raw_csv(spark, path).kept, MESSY_CONTRACT)
    return staged.select(
        "order_id", "size_text", F.length("note").cast("long").alias("note_chars"),
        F.substring("note", 1, 20).alias("note_head"),
    )


def _dropped(spark: SparkSession, *databases: str) -> None:
    for name in databases:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def raw_landing(spark: SparkSession, folder: str) -> DataFrame:
    """A delivery landed file by file: first one file, then all, then all again, which parses nothing.
    Rows of both views beside the counts that the manifest holds."""
    database = f"raw_{uuid.uuid4().hex}"
    body = _delivery_lines(spark, folder, "\n")
    path = _written(spark, "delivery", [",".join(CSV_HEADER)], body)
    land_raw_csv(spark, path.replace("file=*", "file=0"), f"{database}.orders")
    land_raw_csv(spark, path, f"{database}.orders")
    kept, rejected = land_raw_csv(spark, path, f"{database}.orders")
    rows = spark.table(f"{database}.orders").select(
        F.lit("kept").alias("layer"),
        F.lit(kept).cast("long").alias("counted"),
        F.concat_ws("|", *[F.col(f"`{n}`") for n in CSV_HEADER]).alias("line"),
    )
    others = spark.table(f"{database}.orders_rejected").select(
        F.lit("rejected").alias("layer"), F.lit(rejected).cast("long").alias("counted"), "line"
    )
    landed = durable(rows.unionByName(others), "landed")
    _dropped(spark, database)
    return landed


def staging_publish(spark: SparkSession, folder: str) -> DataFrame:
    """What readers see after a good load and a bad one: the good one."""
    database = f"staging_{uuid.uuid4().hex}"
    table_name = f"{database}.lines"
    lines = order_lines(spark, folder, ("order_id", "product_id", "discount", "sales"))

    def gates(df: DataFrame) -> DataFrame:
        bad = F.count_if(F.col("discount") > 0.1).alias("failed")
        return df.agg(bad).select(
            F.lit("value_range").alias("check_name"), "failed", (F.col("failed") == 0).alias("ok")
        )

    publish(lines, table_name, gates)
    try:
        publish(lines.withColumn("discount", F.col("discount") + 1), table_name, gates)
    except GateFailure:
        pass  # as it should
    seen = durable(spark.table(table_name), "published")
    _dropped(spark, database)
    return seen


def pipeline_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run, from CSV files to reports: sizes of the reports, rows of the layers.

    Ship dates are moved behind the order dates, one for each order, so that the gates let the
    lines through. A large delivery is written in parts, so that half of the lines at most lie in
    shuffles beside it.
    """
    lines = order_lines(spark, folder)
    kinds = dict(lines.dtypes)
    contract = [(c, c, kinds[c]) for c in lines.columns]
    parts = PARTS if plan_bytes(table(spark, folder, "lineitem")) >= PARTS_FROM else 1

    def body(part: int) -> DataFrame:
        own, number = lines, F.monotonically_increasing_id().cast("string")
        if parts > 1:
            own = lines.filter(F.pmod(F.xxhash64("order_id"), F.lit(parts)) == part)
            number = F.concat_ws("-", F.lit(part), number)
        own = own.withColumns(
            {
                "row_id": number,
                "ship_date": F.date_add("order_date", (F.col("order_id") % 7).cast("int")),
            }
        )
        return own.select(F.concat_ws(",", *[
            F.date_format(c, US_DATE) if kinds[c] == "date" else F.col(c).cast("string")
            for c in lines.columns
        ]).alias("value"))

    foreign = table(spark, folder, "region").select(F.concat_ws(",", "r_name", "r_regionkey"))
    bodies = [body(0).union(foreign), *map(body, range(1, parts))]
    path = _written_in_place(spark, "lines", ",".join(lines.columns), bodies)
    rules = replace(
        gate_rules(table(spark, folder, "lineitem").count()),
        first_day=dt.date(1990, 1, 1),
        last_day=dt.date(2010, 12, 31),
        ranges={"discount": (0, 0.1, True), "quantity": (0, None, False)},
        domains={"category": tuple(SETTINGS.categories.values())},
    )
    source = f"lines_{uuid.uuid4().hex}"
    run = run_pipeline(
        spark, path, new_folder(spark, "reports"), source, contract, US_DATE, rules, SETTINGS,
        line_breaks=False,
    )
    summary = durable(
        run.summary.select(
            "*",
            F.lit(run.raw_rows).cast("long").alias("raw_rows"),
            F.lit(run.rejected_rows).cast("long").alias("rejected_rows"),
            F.lit(run.staging_rows).cast("long").alias("staging_rows"),
        ),
        "summary",
    )
    for view in (f"raw.{source}", f"raw.{source}_rejected", f"raw.{source}_landed", f"staging.stg_{source}"):
        spark.sql(f"DROP VIEW IF EXISTS {view}")
    for database, name in (("raw", f"{source}_landed_*"), ("staging", f"stg_{source}_*")):
        for t in spark.catalog.listTables(database, name):
            spark.sql(f"DROP TABLE IF EXISTS {database}.{t.name}")
    return summary


def csv_contract(spark: SparkSession, folder: str) -> DataFrame:
    """The typed staging rows that come out of the delivery."""
    return to_staging(_delivery(spark, folder).kept, CSV_CONTRACT)


def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The lines set aside, whole."""
    return _delivery(spark, folder).rejected


def csv_file_contract(spark: SparkSession, folder: str) -> DataFrame:
    """The typed rows of the delivery read from files."""
    return to_staging(_delivery_files(spark, folder).kept, CSV_CONTRACT)


def csv_file_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the files set aside, whole."""
    return _delivery_files(spark, folder).rejected


def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows kept and set aside by the load."""
    marked = mark_lines(_delivery_lines(spark, folder, " "), CSV_HEADER)
    good = F.col(BAD).isNull()
    layers = [
        F.struct(F.lit(layer).alias("layer"), F.count_if(condition).alias("n_rows"))
        for layer, condition in (("kept", good), ("rejected", ~good))
    ]
    return marked.agg(F.array(*layers).alias("layers")).select(F.inline("layers"))


def report_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as CSV and read back with its declared types."""
    name = "03_profit_by_subcategory"
    report = _report(name)(spark, folder)
    target = new_folder(spark, name)
    write_report(report, target, reports.REPORTS[name].order)
    return read_report(spark, target, report.schema)


QUERIES: dict[str, Query] = {
    "staging_orders": order_lines,
    "overview": _report("01_overview"),
    "discount_impact": _report("02_discount_impact"),
    "subcategory_profit": _report("03_profit_by_subcategory"),
    "yearly_trend": _report("04_yearly_trend"),
    "region_performance": _report("05_region_performance"),
    "segment_by_category": _report("06_segment_by_category"),
    "state_loss_split": _report("07_state_loss_split"),
    "threshold_sensitivity": _report("08_threshold_sensitivity"),
    "quality_gates": quality_gates,
    "product_profit_rank": product_profit_rank,
    "category_margin": category_margin,
    "measure_domain_gaps": measure_domain_gaps,
    "cut_totals": cut_totals,
    "loss_state_totals": loss_state_totals,
    "growth_first_last": growth_first_last,
    "threshold_stability": threshold_stability,
    "conservation": conservation,
    "run_summary": summary,
    "feed_discount": discount_feed,
    "feed_subcategory": subcategory_feed,
    "feed_growth": growth_feed,
    "returned_order_margin": returned_order_margin,
    "csv_contract": csv_contract,
    "csv_quarantine": csv_quarantine,
    "csv_file_contract": csv_file_contract,
    "csv_file_quarantine": csv_file_quarantine,
    "csv_messy_files": csv_messy_files,
    "raw_landing": raw_landing,
    "staging_publish": staging_publish,
    "pipeline_reports": pipeline_reports,
    "load_counts": load_counts,
    "report_csv_roundtrip": report_csv_roundtrip,
}
