"""Hot keys, joins too large to broadcast, and the plans that must come out."""

import os

import pytest
from compare import TABLES, differences, duck
from conftest import TESTDATA
from ledgerlens import session
from ledgerlens.operators.facts import line_facts
from ledgerlens.operators.gates import run_gates
from ledgerlens.plans import reports
from ledgerlens.plans.registered import QUERIES, gate_rules
from ledgerlens.sources.retail_view import order_lines
from oracles import ORACLES
from pyspark.sql import functions as F

# As on a cluster: many scan tasks, nothing fits a broadcast, skew counts from a few kilobytes on.
LARGE = {
    "spark.sql.files.maxPartitionBytes": "64KB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def large(spark):
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of all lines in one order, another third on one part, a third of orders one buyer's."""
    folder = tmp_path_factory.mktemp("hot")
    con = duck(f"{TESTDATA}/sf0.01")
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN l_suppkey % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey)
        FROM lineitem) TO '{folder}/lineitem.parquet' (ROW_GROUP_SIZE 5000)""")
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey)
        FROM orders) TO '{folder}/orders.parquet' (ROW_GROUP_SIZE 3000)""")
    for name in TABLES:
        if name not in ("lineitem", "orders"):
            os.symlink(f"{TESTDATA}/sf0.01/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder), duck(str(folder))


def final_plan(df):
    """The plan as it ran. The plan object only changes when the query runs through it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("csv")))
def test_hot_keys_without_broadcast(large, hot, name):
    folder, con = hot
    assert differences(QUERIES[name](large, folder), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["discount_impact", "overview", "region_performance"])
def test_hot_keys_are_split(large, hot, name):
    plan = final_plan(QUERIES[name](large, hot[0]))
    assert "skew=true" in plan and "BroadcastHashJoin" not in plan


def test_hot_order_is_split_below_the_per_order_aggregate(large, hot):
    """The gates group by the join key; the hot order must still be split, not kept whole."""
    folder, _ = hot
    gates = run_gates(order_lines(large, folder), gate_rules(60000))
    plan = final_plan(gates)
    assert plan.count("skew=true") >= 2


def test_gates_sort_no_lines(spark):
    """Hash aggregates only, and no shuffle of lines for the line rules."""
    plan = final_plan(QUERIES["quality_gates"](spark, f"{TESTDATA}/sf0.01"))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_broadcast_and_columns_pruned(spark):
    plan = initial_plan(QUERIES["discount_impact"](spark, f"{TESTDATA}/sf0.01"))
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    lineitem = next(x for x in plan.splitlines() if "FileScan" in x and "l_orderkey" in x)
    schema = lineitem.split("ReadSchema: ")[1]
    assert {c.split(":")[0].removeprefix("struct<") for c in schema.strip("> ").split(",")} == {
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount",
    }


@pytest.mark.parametrize("name", ["region_performance", "state_loss_split", "quality_gates"])
def test_a_small_customer_table_is_not_shuffled(spark, name):
    assert "SortMergeJoin" not in initial_plan(QUERIES[name](spark, f"{TESTDATA}/sf0.01"))


def test_unused_tables_are_not_read(spark):
    plan = initial_plan(QUERIES["measure_domain_gaps"](spark, f"{TESTDATA}/sf0.01"))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_no_join_multiplies_rows(spark):
    for name in sorted(QUERIES):
        plan = initial_plan(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_sums_are_partial_before_the_shuffle(spark):
    plan = initial_plan(QUERIES["category_margin"](spark, f"{TESTDATA}/sf0.01"))
    assert "partial_sum" in plan


def test_filters_reach_the_files(spark):
    plan = initial_plan(QUERIES["returned_order_margin"](spark, f"{TESTDATA}/sf0.01"))
    assert "EqualTo(l_returnflag,R)" in plan


def test_single_task_windows_see_groups_only(spark):
    """The one-partition shuffles sit above the aggregate, never on the lines."""
    facts = line_facts(order_lines(spark, f"{TESTDATA}/sf0.01"))
    plan = initial_plan(reports.profit_rank(facts, "category", "sub_category"))
    above, _, below = plan.partition("Exchange SinglePartition")
    assert "HashAggregate" in below and "Exchange SinglePartition" not in below
    spread = initial_plan(QUERIES["product_profit_rank"](spark, f"{TESTDATA}/sf0.01"))
    single = [x for x in spread.splitlines() if "SinglePartition" in x]
    assert len(single) <= 1  # over one row per range


def test_shuffles_grow_with_the_input(spark):
    key = session.START_TASKS
    before = spark.conf.get(key, None)
    try:
        session.size_shuffles(spark, 10)
        assert spark.conf.get(key, None) is None
        session.size_shuffles(spark, 10 * 1024**4)
        assert int(spark.conf.get(key)) == 40960
        session.size_shuffles(spark, 10**15)
        assert int(spark.conf.get(key)) == -(-(10**15) // session.BYTES_PER_SHUFFLE_TASK)
        QUERIES["measure_domain_gaps"](spark, f"{TESTDATA}/sf0.001")  # a small query starts small
        assert session.shuffle_tasks(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_broadcast_only_below_the_limit(large):
    side = large.range(10).withColumn("x", F.col("id"))
    assert session.broadcast_if_small(side, side) is side


def test_sizes_come_from_public_places(spark):
    files = [os.path.getsize(f"{TESTDATA}/sf0.01/{t}.parquet") for t in ("orders", "lineitem")]
    for size, name in zip(files, ("orders", "lineitem")):
        got = session.plan_bytes(spark.read.parquet(f"{TESTDATA}/sf0.01/{name}.parquet"))
        assert abs(got / size - 1) < 0.1
    sizes = [session._bytes(x) for x in ("10485760b", "256k", "10MB", "-1", "1g")]
    assert sizes == [10485760, 262144, 10485760, -1, 1 << 30]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured.removeprefix("file:") in session.shared_folder(spark)
