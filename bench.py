"""Time every registered query and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_RUNS (default 2) the timed runs after one warm-up; the best run counts. Queries of the text
operators (op*, pipeline) run once, without warm-up. The SQL of each query is timed as well, in
a DuckDB inside this process, on the same files and in the same run; `above_2x` names the queries
that take more than twice its time. Both sides include reading the files; the csv_*, raw_landing
and pipeline_reports queries also write their delivery, which the SQL does not.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
TABLES = (
    "region", "nation", "customer", "part", "orders", "lineitem", "documents", "conversations",
)


def best(action, runs: int) -> float:
    times = []
    for _ in range(runs):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(min(times), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    entry = importlib.import_module("__spark_entry__")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(query):
        query(spark, folder).write.format("noop").mode("overwrite").save()

    timings = {}
    for name in ("overview", "segment_by_category", "csv_contract") * 2:  # warm the JVM up
        run(entry.queries()[name])
    for name, query in entry.queries().items():
        if name.startswith("op") or name == "pipeline":
            timings[name] = best(lambda: run(query), 1)
        else:
            run(query)
            timings[name] = best(lambda: run(query), runs)
    result = {
        "metric": "total query time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    spark.stop()

    try:
        import duckdb
    except ImportError:
        duckdb = None
    if duckdb:
        con = duckdb.connect(config={"threads": int(cpus)})
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        other = {
            name: best(lambda: con.execute(sql).fetchall(), runs + 1)
            for name, sql in entry.oracle_sql().items()
        }
        result["duckdb"] = other
        result["duckdb_total"] = round(sum(other.values()), 3)
        result["duckdb_version"] = duckdb.__version__
        result["above_2x"] = {
            n: round(timings[n] / t, 1) for n, t in other.items() if t and timings[n] > 2 * t
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
