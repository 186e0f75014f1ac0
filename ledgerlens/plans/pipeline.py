"""Land, gate, report, feed: the whole run, and the report runner on its own."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.facts import Cubes, Facts, cubes, line_facts
from ledgerlens.operators.gates import GateRules, require
from ledgerlens.plans.feeds import feed_discount, feed_growth, feed_subcategory
from ledgerlens.plans.journal import PUBLISHED, REPORTED, Journal, fingerprint
from ledgerlens.plans.reports import REPORTS, Report
from ledgerlens.plans.settings import RETAIL, RETAIL_GATES, Settings
from ledgerlens.session import configure, plan_bytes, shuffles_released, side_by_side, size_shuffles
from ledgerlens.sources.contract import RETAIL_CONTRACT, US_DATE, Contract, to_staging
from ledgerlens.sources.landing import delivered, land_raw_csv
from ledgerlens.sources.tables import (
    current_run,
    new_run,
    publish,
    publish_run,
    read_report,
    shown,
    write_report,
)

GATE_SCHEMA = "check_name string, description string, failed bigint, ok boolean"


def build_reports(
    facts: Facts | Cubes,
    settings: Settings,
    registry: Mapping[str, Report] = REPORTS,
    exact: bool = False,
) -> dict[str, DataFrame]:
    """Every registered report, in name order; `exact` adds unrounded sums to those that conserve."""
    if not registry:
        raise ValueError("no reports registered")
    return {
        name: report.build(
            facts.serving(report.columns), settings, **({"exact": True} if exact and report.conserves else {})
        )
        for name, report in sorted(registry.items())
    }


def run_summary(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each report."""
    sizes = [
        df.agg(
            F.lit(name).alias("report"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_cols"),
        )
        for name, df in reports.items()
    ]
    return reduce(DataFrame.unionByName, sizes).orderBy("report")


def run_reports(
    spark: SparkSession,
    facts: Facts | Cubes,
    settings: Settings,
    folder: str,
    gate_result: DataFrame | None,
    registry: Mapping[str, Report] = REPORTS,
) -> dict[str, DataFrame]:
    """Write every report under `folder` and return the written ones, read back with their types.

    All reports go into a folder of this run, which readers of `folder` (`read_reports`) see once all of
    them are written; until then, and after a stop, they see the run before. The gate result must
    be given; None says the caller chose to report without gates.
    """
    if gate_result is not None:
        require(gate_result)
    run = new_run()

    def write(name: str, df: DataFrame) -> tuple[str, DataFrame]:
        write_report(df, f"{folder}/{run}/{name}", registry[name].order)
        return name, read_report(spark, f"{folder}/{run}/{name}", df.schema)

    reports = build_reports(facts, settings, registry)
    written = dict(side_by_side([partial(write, name, df) for name, df in reports.items()]))
    publish_run(spark, folder, run)
    return written


def read_reports(
    spark: SparkSession, folder: str, schemas: Mapping[str, StructType]
) -> dict[str, DataFrame]:
    """The reports of the last run that was written whole."""
    current = current_run(spark, folder)
    return {name: read_report(spark, f"{current}/{name}", schema) for name, schema in schemas.items()}


@dataclass(frozen=True)
class Run:
    raw_rows: int
    rejected_rows: int
    staging_rows: int
    gates: DataFrame
    summary: DataFrame
    feeds: Mapping[str, DataFrame]


def run_pipeline(
    spark: SparkSession,
    csv_path: str,
    report_folder: str,
    source: str = "orders",
    contract: Contract = RETAIL_CONTRACT,
    date_format: str = US_DATE,
    rules: GateRules = RETAIL_GATES,
    settings: Settings = RETAIL,
    line_breaks: bool = True,
) -> Run:
    """CSV -> raw -> new staging version -> gates -> staging -> reports -> feeds.

    A gate that fails raises GateFailure before staging is replaced or any report is written.
    The reports share one pass over staging.

    A journal beside the staging table notes finished stages. Called again with the same delivery and
    settings after a stop, the run goes on where it stopped: files that were landed are not parsed
    again, and a version that was published, and is still the one shown, goes straight to the reports
    with the gate results it had.
    """
    configure(spark)
    raw_table, staging_table = f"raw.{source}", f"staging.stg_{source}"
    with shuffles_released(spark):
        journal = Journal(spark, f"{staging_table}_runs")
        delivery = fingerprint(
            delivered(spark, csv_path), tuple(contract), date_format, rules, settings, line_breaks
        )
        done = journal.unfinished(delivery)
        if done and shown(spark, staging_table) == done["version"]:
            gates = spark.createDataFrame([tuple(r) for r in done["gates"]], GATE_SCHEMA)
            raw_rows, rejected_rows, staging_rows = done["rows"]
        else:
            size_shuffles(spark, plan_bytes(spark.read.text(csv_path)))
            raw_rows, rejected_rows = land_raw_csv(spark, csv_path, raw_table, line_breaks)
            raw = spark.table(raw_table)
            size_shuffles(spark, plan_bytes(raw))
            staged = to_staging(raw, contract, date_format)
            staging_rows, gates = publish(staged, staging_table, rules)
            journal.note(
                delivery,
                new_run(),
                PUBLISHED,
                version=shown(spark, staging_table),
                rows=(raw_rows, rejected_rows, staging_rows),
                gates=[tuple(r) for r in gates.collect()],
            )

        facts = cubes(line_facts(spark.table(staging_table)))
        reports = run_reports(spark, facts, settings, report_folder, gates)
        journal.note(delivery, current_run(spark, report_folder), REPORTED)
    # What the caller gets is planned outside, as it may be asked for more than once.
    feeds = {
        "discount": feed_discount(
            reports["02_discount_impact"], settings.band_edges, settings.band_labels, settings.cut
        ),
        "subcategory": feed_subcategory(
            reports["03_profit_by_subcategory"], "category", "sub_category"
        ),
        "growth": feed_growth(reports["04_yearly_trend"]),
    }
    return Run(raw_rows, rejected_rows, staging_rows, gates, run_summary(reports), feeds)

