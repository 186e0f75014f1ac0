import dataclasses
import gzip
import re
import time
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA
from feed import good_lines, text, write
from ledgerlens.operators.facts import line_facts
from ledgerlens.operators.gates import GateFailure, run_gates
from ledgerlens.plans import pipeline, registered
from ledgerlens.plans.pipeline import read_reports, run_pipeline, run_reports
from ledgerlens.plans.reports import REPORTS
from ledgerlens.plans.settings import RETAIL, RETAIL_GATES
from ledgerlens.session import RELEASE
from ledgerlens.sources import landing, tables
from ledgerlens.sources.landing import land_raw_csv
from ledgerlens.sources.tables import (
    Superseded,
    begin,
    current_run,
    materialise,
    publish,
    read_report,
    shown,
    switch,
    write_version,
)
from lines import make
from pyspark.sql import functions as F

RULES = dataclasses.replace(RETAIL_GATES, expected_rows=8)


def test_whole_run_and_rerun(spark, tmp_path):
    path = write(tmp_path, text(*good_lines()))
    for _ in range(2):  # a second run replaces everything
        run = run_pipeline(spark, path, str(tmp_path / "reports"), rules=RULES)
        assert (run.raw_rows, run.rejected_rows, run.staging_rows) == (8, 5, 8)
        assert all(r.ok for r in run.gates.collect())
        sizes = {r.report: (r.n_rows, r.n_cols) for r in run.summary.collect()}
        assert list(sizes) == sorted(REPORTS)
        assert sizes["01_overview"] == (1, 9) and sizes["08_threshold_sensitivity"] == (6, 5)
        assert spark.table("staging.stg_orders").count() == 8
        assert spark.table("raw.orders_rejected").count() == 5
    assert len(spark.catalog.listTables("staging", "stg_orders__v*")) <= 2  # and the one before
    bands = run.feeds["discount"].collect()
    assert [(b.sign, b.label, b.split_at) for b in bands] == [
        ("profit", "30.0%", 0.5), ("loss", "-20.1%", 0.5),
    ]
    assert run.feeds["subcategory"].count() == 3
    growth = run.feeds["growth"].first()
    assert (growth.order_year, growth.label) == ("2015", "4.91%")


def shuffle_files(spark):
    """Numbers of the shuffles that have files on disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return set(re.findall(r"shuffle_(\d+)_", folders.getAllFiles().mkString(" ")))


def test_no_shuffle_outlives_its_query(spark, tmp_path):
    path = write(tmp_path, text(*good_lines()))
    before = shuffle_files(spark)
    run = run_pipeline(spark, path, str(tmp_path / "reports"), "released", rules=RULES)
    for _ in range(100):  # files are deleted behind the query's back
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(RELEASE, None) != "true"
    assert run.summary.collect() == run.summary.collect()  # what is returned may be asked again


def test_versions_are_packed_and_not_sorted_by_layer(spark, tmp_path, monkeypatch):
    """Kept and rejected rows go to two open files of a task."""
    seen, plain = [], tables.open_files

    def watched(session, number):
        seen.append(number)
        return plain(session, number)

    monkeypatch.setattr(tables, "open_files", watched)
    path = write(tmp_path, text(*good_lines()))
    assert land_raw_csv(spark, path, "raw.packed") == (8, 5)
    rows = spark.table("raw.packed_landed")
    files = [unquote(urlparse(f).path) for f in rows.inputFiles()]
    assert seen == [2] and {f.split("is_rejected=")[1].split("/")[0] for f in files} == {"true", "false"}
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        assert {group.column(i).compression for i in range(group.num_columns)} == {"ZSTD"}
    assert rows.count() == 13 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


@pytest.mark.parametrize("n", [0, 1, 3, 4, 20])
def test_a_delivery_is_written_where_it_is_made(spark, monkeypatch, n):
    """Every file begins with the head and is bounded, no line is lost, and nothing is shuffled."""
    monkeypatch.setattr(registered, "LINES_PER_FILE", 3)
    before = shuffle_files(spark)
    body = spark.range(0, n, 1, 2).select(F.concat_ws(",", "id", F.lit("x")).alias("value"))
    folder = registered._written_in_place(spark, "placed", "id,x", [body.filter("id < 7"), body.filter("id >= 7")])
    files = [gzip.open(p, "rt").read().splitlines() for p in Path(urlparse(folder).path).glob("part-*.gz")]
    files = [f for f in files if f]
    assert all(f[0] == "id,x" and "id,x" not in f[1:] and len(f) <= 4 for f in files)
    assert sorted(x for f in files for x in f[1:]) == sorted(f"{i},x" for i in range(n))
    assert not shuffle_files(spark) - before
    kept, rejected = land_raw_csv(spark, folder, f"raw.placed_{n}", line_breaks=False)
    assert (kept, rejected) == (n, 0) and spark.table(f"raw.placed_{n}").columns == ["id", "x"]


def test_parts_of_a_large_delivery_hold_every_line_once(spark, monkeypatch):
    """The same run in one part and in two; orders are split, lines are not shuffled for both."""
    seen, plain = [], registered._written_in_place

    def watched(session, name, head, bodies):
        plans = [b._jdf.queryExecution().optimizedPlan().toString() for b in bodies]
        seen.append([(b.count(), p.count("xxhash64(l_orderkey"), p.count("xxhash64(o_orderkey")) for b, p in zip(bodies, plans)])
        return plain(session, name, head, bodies)

    monkeypatch.setattr(registered, "_written_in_place", watched)
    folder = f"{TESTDATA}/sf0.001"
    whole = registered.pipeline_reports(spark, folder).collect()
    monkeypatch.setattr(registered, "PARTS_FROM", 0)
    assert registered.pipeline_reports(spark, folder).collect() == whole
    (one,), two = seen
    assert one[1:] == (0, 0) and len(two) == 2 and sum(n for n, *_ in two) == one[0]
    assert all(n > one[0] / 4 and left == right == 1 for n, left, right in two)


def test_report_files_hold_plain_csv_in_report_order(spark, tmp_path):
    path = write(tmp_path, text(*good_lines()))
    run_pipeline(spark, path, str(tmp_path / "reports"), rules=RULES)
    folder = Path(current_run(spark, str(tmp_path / "reports")))
    parts = list((folder / "04_yearly_trend").glob("part-*.csv"))
    assert len(parts) == 1
    assert parts[0].read_text(encoding="utf-8").splitlines()[:3] == [
        "order_year,orders,sales,profit,margin_pct,prev_year_sales,sales_yoy_pct,margin_yoy_pp",
        "2015,2,201.0,10.0,4.91,,,",
        "2016,2,201.0,10.0,4.91,201.0,0.0,0.0",
    ]


def test_failing_load_keeps_the_last_good_table(spark, tmp_path):
    good = write(tmp_path, text(*good_lines()))
    run_pipeline(spark, good, str(tmp_path / "reports"), rules=RULES)
    lines = good_lines()
    lines[0]["Discount"] = "0.95"
    bad = write(tmp_path, text(*lines), "bad.csv")
    with pytest.raises(GateFailure, match="value_range: 1 failed") as failure:
        run_pipeline(spark, bad, str(tmp_path / "other"), rules=RULES)
    assert not (tmp_path / "other").exists()  # no report from a bad load
    assert spark.table("staging.stg_orders").agg({"discount": "max"}).first()[0] == 0.45
    version = failure.value.version
    assert spark.table(version).agg({"discount": "max"}).first()[0] == 0.95
    run_pipeline(spark, good, str(tmp_path / "reports"), rules=RULES)
    assert not spark.catalog.tableExists(version)


def test_two_sources_do_not_meet(spark, tmp_path):
    for source, n in (("east", 8), ("west", 4)):
        path = write(tmp_path, text(*good_lines()[:n]), f"{source}.csv")
        rules = dataclasses.replace(RULES, expected_rows=n)
        run_pipeline(spark, path, str(tmp_path / source), source=source, rules=rules)
    assert spark.table("staging.stg_east").count() == 8
    assert spark.table("staging.stg_west").count() == 4


class Stop(Exception):
    pass


def test_a_stop_at_any_step_leaves_the_last_good_table(spark, tmp_path, monkeypatch):
    """Every statement of a load that changes anything fails once; readers see old rows or all new ones."""
    load = lambda n: (
        land_raw_csv(spark, write(tmp_path, text(*good_lines()[:n]), f"{n}.csv"), "raw.stops"),
        publish(spark.range(n).toDF("x"), "staging.stops", lambda df: spark.createDataFrame(
            [("g", 0, True)], "check_name string, failed long, ok boolean")),
    )
    load(3)
    kind = type(spark)
    plain, calls, stop_at = kind.sql, [0], [10**9]

    def sql(self, *a, **k):
        calls[0] += not a[0].startswith("SHOW")
        if calls[0] == stop_at[0] and not a[0].startswith("SHOW"):
            raise Stop
        return plain(self, *a, **k)

    monkeypatch.setattr(kind, "sql", sql)
    load(3)
    steps = calls[0]
    for step in range(1, steps + 1):
        calls[0], stop_at[0] = 0, step
        with pytest.raises(Stop):
            load(5)
        stop_at[0] = 10**9
        assert spark.table("raw.stops").count() in (3, 5)
        assert spark.table("raw.stops_rejected").count() == 5
        assert spark.table("staging.stops").count() in (3, 5)
        load(3)
    bad = write(tmp_path, "no,such,header\n1,2\n" + '"open', "bad.csv")
    with pytest.raises(ValueError, match="never closed"):
        land_raw_csv(spark, bad, "raw.stops")
    assert spark.table("raw.stops").count() == 3

def test_reports_refuse_a_failed_gate(spark, tmp_path):
    lines = make(spark, {})
    red = run_gates(lines, RULES)  # one row, eight expected
    with pytest.raises(GateFailure):
        run_reports(spark, line_facts(lines), RETAIL, str(tmp_path / "r"), red)
    only = {"01_overview": REPORTS["01_overview"]}
    written = run_reports(spark, line_facts(lines), RETAIL, str(tmp_path / "r"), None, only)
    assert written["01_overview"].first().total_rows == 1


def test_missing_report(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the reports"):
        read_report(spark, str(tmp_path / "none"), "a int")


def test_materialise_counts_and_replaces(spark):
    assert materialise(spark.range(7), "scratch.numbers") == 7
    assert materialise(spark.range(3), "scratch.numbers") == 3
    assert spark.table("scratch.numbers").count() == 3


def green(df):
    return df.sparkSession.createDataFrame([("g", 0, True)], "check_name string, failed long, ok boolean")


def test_of_two_writers_the_stale_one_does_not_win(spark):
    """B publishes while A is in its gates: A's version survives B's cleaning, but is not shown."""
    table = "staging.writers"
    publish(spark.range(1).toDF("x"), table, green)

    def gates_of_a(version):
        publish(spark.range(2).toDF("x"), table, green)  # B, from begin to end
        publish(spark.range(3).toDF("x"), table, green)  # and a third, which cleans up once more
        assert version.count() == 7  # A's rows are still there
        return green(version)

    with pytest.raises(Superseded) as failure:
        publish(spark.range(7).toDF("x"), table, gates_of_a)
    assert spark.table(table).count() == 3
    assert spark.catalog.tableExists(failure.value.version)  # until the next load
    publish(spark.range(4).toDF("x"), table, green)
    assert spark.table(table).count() == 4 and not spark.catalog.tableExists(failure.value.version)
    assert spark.catalog.listTables("staging", "writers__claim*") == []


def test_only_one_load_takes_the_place_behind_a_version(spark, monkeypatch):
    """Both have seen the same base; the second to claim it fails, also while the first is switching."""
    table = "staging.race"
    publish(spark.range(1).toDF("x"), table, green)
    a, b = begin(spark, table), begin(spark, table)
    assert a.base == b.base == shown(spark, table)
    for n, load in ((5, a), (6, b)):
        write_version(spark.range(n).toDF("x"), load)
    claim = tables._claim(spark, a)
    with pytest.raises(Superseded):
        switch(spark, b)
    assert spark.table(table).count() == 1
    # A is lost with its claim. When that has run out the next load takes over.
    spark.sql(f"ALTER TABLE {claim} SET TBLPROPERTIES ('{tables.LEASE}' = '1')")
    switch(spark, b)
    assert spark.table(table).count() == 6
    with pytest.raises(Superseded):
        switch(spark, a)
    assert spark.table(table).count() == 6


def test_a_lease_that_ran_out_is_cleaned(spark):
    table = "staging.lost"
    publish(spark.range(1).toDF("x"), table, green)
    load = begin(spark, table)
    write_version(spark.range(2).toDF("x"), load)
    publish(spark.range(3).toDF("x"), table, green)
    assert spark.catalog.tableExists(load.version)
    spark.sql(f"ALTER TABLE {load.version} SET TBLPROPERTIES ('{tables.LEASE}' = '1')")
    publish(spark.range(4).toDF("x"), table, green)
    assert not spark.catalog.tableExists(load.version)


def test_line_rules_are_counted_by_the_write(spark, tmp_path):
    """The version is scanned for uniqueness and grain only, and only the columns of these.

    Uniqueness takes a pass for hashes, which both its branches share at run time, and one for the keys
    of repeated hashes, which falls away where there are none.
    """
    lines = make(spark, {}, {"product_id": "P-2"}, {"order_id": "B", "quantity": 0})
    rules = dataclasses.replace(RETAIL_GATES, expected_rows=3)
    with pytest.raises(GateFailure, match="value_range: 1 failed"):
        publish(lines, "staging.observed", rules)
    rows, results = publish(lines.filter("quantity > 0"), "staging.observed", dataclasses.replace(rules, expected_rows=2))
    assert rows == 2 and all(r.ok for r in results.collect())
    version = spark.table(shown(spark, "staging.observed"))
    known = run_gates(version, rules, counted={"rows": 2, **{n: 0 for n in (
        "no_null_keys", "no_null_measures", "date_sanity", "value_range", "enum_domain")}})
    plan = known._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 4 and not any("discount" in x.split("ReadSchema")[1] for x in scans)


def parsed_files(monkeypatch):
    """The files that are parsed from now on."""
    seen, plain = [], landing._read

    def read(spark, path, *more):
        seen.append(sorted(Path(p).name for p in path))
        return plain(spark, path, *more)

    monkeypatch.setattr(landing, "_read", read)
    return seen


def test_one_file_more_is_parsed_alone(spark, tmp_path, monkeypatch):
    seen, folder = parsed_files(monkeypatch), tmp_path / "in"
    folder.mkdir()
    names = lambda: sorted(r["Order ID"] for r in spark.table("raw.grown").collect())
    write(folder, text({"Order ID": "A"}, {"Order ID": "B"}), "a.csv")
    write(folder, text({"Order ID": "C"}, tail="x,y\n"), "b.csv")
    assert land_raw_csv(spark, str(folder), "raw.grown") == (3, 6)
    assert land_raw_csv(spark, str(folder), "raw.grown") == (3, 6)  # the same again: nothing parsed
    assert seen == [["a.csv", "b.csv"]]
    write(folder, text({"Order ID": "D"}, tail=""), "c.csv")
    assert land_raw_csv(spark, str(folder), "raw.grown") == (4, 6)
    assert seen[1:] == [["c.csv"]] and names() == ["A", "B", "C", "D"]
    write(folder, text({"Order ID": "B2"}, tail=""), "a.csv")  # changed: its old rows go
    assert land_raw_csv(spark, str(folder), "raw.grown") == (3, 1)
    assert seen[2:] == [["a.csv"]] and names() == ["B2", "C", "D"]
    assert [r.line for r in spark.table("raw.grown_rejected").collect()] == ["x,y"]
    (folder / "b.csv").unlink()  # no longer delivered
    assert land_raw_csv(spark, str(folder), "raw.grown") == (2, 0)
    assert len(seen) == 3 and names() == ["B2", "D"]


def test_many_batches_are_copied_into_one(spark, tmp_path, monkeypatch):
    seen, folder = parsed_files(monkeypatch), tmp_path / "in"
    folder.mkdir()
    monkeypatch.setattr(landing, "MOST_BATCHES", 2)
    for k in range(5):
        write(folder, text({"Order ID": f"O{k}"}), f"{k}.csv")
        assert land_raw_csv(spark, str(folder), "raw.many") == (k + 1, 5 * (k + 1))
    assert seen == [[f"{k}.csv"] for k in range(5)]
    assert sorted(r["Order ID"] for r in spark.table("raw.many").collect()) == [f"O{k}" for k in range(5)]


def test_a_new_file_with_another_header_changes_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, text({}), "a.csv")
    land_raw_csv(spark, str(folder), "raw.headers")
    write(folder, text({}).replace("Row ID,Order ID", "Order ID,Row ID"), "b.csv")
    with pytest.raises(Exception, match="CSV header does not conform"):
        land_raw_csv(spark, str(folder), "raw.headers")
    assert spark.table("raw.headers").count() == 1


def test_readers_see_one_whole_run_of_reports(spark, tmp_path, monkeypatch):
    """Writing stops at a report; readers see the run before, whole, until all are written."""
    folder = str(tmp_path / "reports")
    before, after = line_facts(make(spark, {"sales": 10.0})), line_facts(make(spark, {"sales": 77.0}))
    written = run_reports(spark, before, RETAIL, folder, None)
    schemas = {name: df.schema for name, df in written.items()}
    plain = pipeline.write_report
    for stop in sorted(REPORTS)[::3]:

        def write_or_stop(df, target, order, stop=stop):
            if target.endswith(stop):
                raise Stop
            plain(df, target, order)

        monkeypatch.setattr(pipeline, "write_report", write_or_stop)
        with pytest.raises(Stop):
            run_reports(spark, after, RETAIL, folder, None)
        seen = read_reports(spark, folder, schemas)
        assert seen["01_overview"].first().total_sales == seen["02_discount_impact"].first().sales == 10.0
    monkeypatch.setattr(pipeline, "write_report", plain)
    run_reports(spark, after, RETAIL, folder, None)
    seen = read_reports(spark, folder, schemas)
    assert all(seen[name].count() >= 1 for name in set(REPORTS) - {"07_state_loss_split"})
    assert seen["01_overview"].first().total_sales == seen["05_region_performance"].first().sales == 77.0


@pytest.mark.parametrize("stage", ["land_raw_csv", "publish", "cubes", "run_reports", None])
def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, stage):
    """A stop in each stage; the run that follows does the rest, and nothing twice."""
    source, done = f"stopped_{stage}".lower(), []
    folder = tmp_path / "in"
    folder.mkdir()
    path = write(folder, text(*good_lines()))
    run = lambda: run_pipeline(spark, path, str(tmp_path / "reports"), source=source, rules=RULES)
    steps = {name: getattr(pipeline, name) for name in ("land_raw_csv", "publish", "cubes", "run_reports")}

    def noting(name, stops):
        def step(*a, **k):
            if name == stops:
                raise Stop
            done.append(name)
            return steps[name](*a, **k)

        return step

    for name in steps:
        monkeypatch.setattr(pipeline, name, noting(name, stage))
    if stage:
        with pytest.raises(Stop):
            run()
    for name in steps:
        monkeypatch.setattr(pipeline, name, noting(name, None))
    done.clear()
    result = run()
    assert (result.raw_rows, result.rejected_rows, result.staging_rows) == (8, 5, 8)
    assert all(r.ok for r in result.gates.collect()) and result.gates.count() == 8
    published = stage in ("cubes", "run_reports")
    assert done == ([] if published else ["land_raw_csv", "publish"]) + ["cubes", "run_reports"]
    assert read_report(spark, current_run(spark, str(tmp_path / "reports")) + "/01_overview", "n double").count() == 1
    if stage is None:
        done.clear()
        run()  # a finished run is no stopped one
        assert done == list(steps)
