"""Tables and report files: write versions, publish them behind the gates, write and re-read reports.

A published table is a view on a version of its own; readers see one version whole. Loads may run side
by side and may stop anywhere:

* A load notes the version shown when it begins (its base) and writes its rows into a new version, which
  holds a *lease* from its first moment. Whoever cleans up leaves leased versions alone.
* To be published it *claims* the place behind its base: a table whose name follows from the base, so
  that of two loads only one can create it. With the claim in hand it checks that the base is still
  shown, switches the view in one statement and gives the claim up. So a load that began before the
  version now shown cannot replace it: it fails with `Superseded`, and its rows stay unseen.
* Leases and claims run out, so what a lost driver leaves behind holds nobody up for good.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import plain_text
from ledgerlens.operators.gates import GateFailure, GateRules, line_counts, require, run_gates
from ledgerlens.session import open_files

VERSION, LEASE = "ledgerlens.version", "ledgerlens.lease"
CODEC = "zstd"  # of a version's files; they lie beside the delivery and the version before
FILES_OPEN = 2  # by a task that writes a partitioned version: landed rows are kept ones or rejected
LEASE_SECONDS = 24 * 3600  # for writing and gating a version
CLAIM_SECONDS = 300  # for switching a view


class Superseded(RuntimeError):
    """Another load was published after this one had begun."""


@dataclass(frozen=True)
class Load:
    """A load in flight: the view it is for, its own version, the version shown when it began."""

    table: str
    version: str
    base: str | None


def materialise(df: DataFrame, table: str) -> int:
    """Replace `database.table` with these rows; returns their number, counted while writing."""
    _ensure_database(df.sparkSession, table)
    written = Observation(f"load of {table}")
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").format("parquet").saveAsTable(table)
    return written.get["rows"]


def _ensure_database(spark: SparkSession, table: str) -> None:
    database, _, _ = table.rpartition(".")
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def shown(spark: SparkSession, table: str) -> str | None:
    """The version that a published table shows; None where nothing was published yet."""
    if not spark.catalog.tableExists(table):
        return None
    return _properties(spark, table).get(VERSION)


def begin(spark: SparkSession, table: str) -> Load:
    """A new load for `table`. Versions sort in the order their loads began."""
    _ensure_database(spark, table)
    return Load(table, f"{table}__v{time.time_ns():020d}", shown(spark, table))


def write_version(
    df: DataFrame, load: Load, by: str | None = None, counts: Sequence[Column] = ()
) -> dict[str, int]:
    """Write the load's version, leased; returns `rows` and the given aggregates, taken on the way."""
    written = Observation(f"load of {load.version}")
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"), *counts)
    until = str(int(time.time()) + LEASE_SECONDS)
    writer = counted.writeTo(load.version).using("parquet").option("compression", CODEC)
    writer = writer.tableProperty(LEASE, until)
    with open_files(df.sparkSession, FILES_OPEN):
        (writer.partitionedBy(F.col(by)) if by else writer).create()
    return written.get


def release(spark: SparkSession, load: Load) -> None:
    """Give up the lease: the next published load may drop the version."""
    spark.sql(f"ALTER TABLE {load.version} SET TBLPROPERTIES ('{LEASE}' = '0')")


def _leased(spark: SparkSession, table: str) -> bool:
    try:
        return int(_properties(spark, table).get(LEASE, "0")) > time.time()
    except AnalysisException:  # dropped meanwhile
        return False


def _claim(spark: SparkSession, load: Load) -> str:
    """The name of a table that only this load could create, or Superseded."""
    behind = load.base.rpartition("__v")[2] if load.base else "first"
    attempt = 0
    while True:
        name = f"{load.table}__claim_{behind}_{attempt}"
        until = int(time.time()) + CLAIM_SECONDS
        try:
            spark.sql(
                f"CREATE TABLE {name} (holder STRING) USING parquet"
                f" TBLPROPERTIES ('{LEASE}' = '{until}', '{VERSION}' = '{load.version}')"
            )
            return name
        except AnalysisException as e:
            if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
        if _leased(spark, name):
            raise Superseded(f"{load.table}: another load is taking the place behind {load.base}")
        attempt += 1  # its holder was lost


def switch(
    spark: SparkSession,
    load: Load,
    select: str | None = None,
    properties: Mapping[str, str] | None = None,
    keep: Iterable[str] = (),
) -> None:
    """Let the view show the load's version, and drop versions that nobody needs any more.

    `select` is the view's text where it is not the whole version. The version shown before, those
    in `keep` and those of loads in flight stay.
    """
    claim = _claim(spark, load)
    attempt = int(claim.rpartition("_")[2])
    try:
        taken_over = spark.catalog.tableExists(f"{claim.rpartition('_')[0]}_{attempt + 1}")
        if taken_over or shown(spark, load.table) != load.base:
            raise Superseded(f"{load.table}: {load.base} is no longer the version shown")
        kept = {load.version, load.base, *keep}
        if load.base is None and spark.catalog.tableExists(load.table):
            first = f"{load.table}__v{0:020d}"  # a plain table from elsewhere becomes the first version
            spark.sql(f"ALTER TABLE {load.table} RENAME TO {first}")
            kept.add(first)
        told = {VERSION: load.version, **(properties or {})}
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in told.items())
        spark.sql(
            f"CREATE OR REPLACE VIEW {load.table} TBLPROPERTIES ({listed}) AS"
            f" {select or f'SELECT * FROM {load.version}'}"
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {claim}")
    database, _, name = load.table.rpartition(".")
    prefix = f"{database}." if database else ""
    for pattern in (f"{name}__v*", f"{name}__claim_*", f"{name}_manifest__v*"):
        for t in spark.catalog.listTables(database or None, pattern):
            if f"{prefix}{t.name}" not in kept and not _leased(spark, f"{prefix}{t.name}"):
                spark.sql(f"DROP TABLE IF EXISTS {prefix}{t.name}")


def publish(
    df: DataFrame, table: str, gates: GateRules | Callable[[DataFrame], DataFrame]
) -> tuple[int, DataFrame]:
    """Write a new version, gate it, and only then let the view `table` show it.

    Under GateRules the line rules are counted by the write itself, so that the version is read for
    uniqueness and order grain only; a callable makes gate results from the version. A failing load
    raises GateFailure, which names the version: it stays for inspection until the next good load, and
    readers keep the last good one. A load that began before the version now shown raises
    Superseded. Returns the number of rows and the gate results.
    """
    spark = df.sparkSession
    load = begin(spark, table)
    ruled = isinstance(gates, GateRules)
    counts = write_version(df, load, counts=line_counts(gates) if ruled else ())
    version = spark.table(load.version)
    found = run_gates(version, gates, counted=counts) if ruled else gates(version)
    # One row per gate, so that a good run does not read the version again to show them.
    results = spark.createDataFrame(found.collect(), found.schema)
    try:
        require(results)
        switch(spark, load)
    except (GateFailure, Superseded) as failure:
        failure.version = load.version
        release(spark, load)
        raise
    release(spark, load)
    return counts["rows"], results


def write_report(df: DataFrame, folder: str, order: Sequence[str] = ()) -> None:
    """CSV files with a header, in report order from file to file; a small report is one file.

    A leading minus in `order` means descending. Sort ranges are written side by side, and adaptive
    execution joins small ones, so a report of any size is written by as many tasks as it needs.
    """
    if order:
        placed = df.orderBy(
            *[
                F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
                for c in order
            ]
        )
    else:
        placed = df.hint("rebalance")
    written = placed.withColumns(
        {name: plain_text(F.col(name)) for name, kind in df.dtypes if kind == "double"}
    )
    written.write.mode("overwrite").options(header="true", escape='"').csv(folder)


def read_report(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A written report with its declared types."""
    try:
        return spark.read.options(header="true", escape='"').schema(schema).csv(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no report at {folder}; run the reports first") from e
        raise


def new_run() -> str:
    """A name for a run's folder of reports; names sort in the order the runs began."""
    return f"run-{time.time_ns():020d}"


def publish_run(spark: SparkSession, folder: str, run: str) -> None:
    """Let readers of `folder` find this run's reports, after all of them were written.

    The pointer is a file added beside those of earlier runs; it appears whole or not at all, and the
    run that began last counts.
    """
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{folder}/published")


def current_run(spark: SparkSession, folder: str) -> str:
    """The folder of the reports that readers are to see."""
    try:
        found = spark.read.schema("run string").parquet(f"{folder}/published").agg(F.max("run")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no report at {folder}; run the reports first") from e
        raise
    return f"{folder}/{found}"
