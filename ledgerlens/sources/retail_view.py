"""Order lines in staging shape, derived from the star-schema test tables.

The tables hold no cost, so a cost rate is derived from part and nation, giving products and
states that earn and ones that lose. All amounts are exact decimals.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import broadcast_if_small, configure, plan_bytes, size_shuffles

# Declared, so that opening a table needs no job to look at file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}

COLUMNS = (
    "row_id", "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "segment",
    "state", "region", "product_id", "category", "sub_category", "sales", "quantity", "discount",
    "profit",
)

FROM_PART = {"category", "sub_category", "profit"}
FROM_CUSTOMER = {"segment", "state", "region", "profit"}
FROM_ORDERS = {"order_date", "ship_mode", "customer_id"} | FROM_CUSTOMER

RATE = "decimal(5,4)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def order_lines(
    spark: SparkSession, folder: str, columns: Sequence[str] = COLUMNS
) -> DataFrame:
    """The requested staging columns, one row per line; tables nobody asked for are not joined.

    Joins are left joins on unique keys, so no line is lost or doubled, and leaving one out
    changes nothing else. Order: lines meet the parts, orders meet their buyers, and only then
    the two big sides meet, so lines are shuffled at most twice. Hot products, customers or
    orders are split by adaptive execution (see `session.configure`).
    """
    configure(spark)
    wanted = set(columns)
    lines = table(spark, folder, "lineitem")
    size_shuffles(spark, plan_bytes(lines))
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    part_cost = nation_cost = F.lit(None)

    if wanted & FROM_PART:
        # The rate is worked out once per part and once per customer, not once per line.
        base = F.lit(Decimal("0.86")) + F.lit(Decimal("0.0012")) * F.col("p_size")
        brand_step = F.substring("p_brand", 7, 9).cast("int") % 5
        parts = table(spark, folder, "part").select(
            "p_partkey",
            "p_type",
            "p_brand",
            (base + F.lit(Decimal("0.01")) * brand_step).cast(RATE).alias("part_cost"),
        )
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        part_cost = F.col("part_cost")

    if wanted & FROM_ORDERS:
        orders = table(spark, folder, "orders").select(
            "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_date"),
            "o_orderpriority",
        )
        buyers = orders
        if wanted & FROM_CUSTOMER:
            buyers = broadcast_if_small(_with_customers(spark, folder, orders, wanted), orders)
            nation_cost = F.col("nation_cost")
        lines = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"), "left")

    earned = F.lit(1) - discount  # of each unit of list price
    made = {
        "row_id": lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "order_id": lambda: F.col("l_orderkey"),
        "order_date": lambda: F.col("o_date"),
        "ship_date": lambda: F.col("l_shipdate").cast("date"),
        "ship_mode": lambda: F.col("o_orderpriority"),
        "customer_id": lambda: F.col("o_custkey"),
        "segment": lambda: F.col("c_mktsegment"),
        "state": lambda: F.col("n_name"),
        "region": lambda: F.col("r_name"),
        "product_id": lambda: F.col("l_partkey"),
        "category": lambda: F.col("p_type"),
        "sub_category": lambda: F.col("p_brand"),
        "quantity": lambda: F.col("l_quantity").cast("int"),
        "discount": lambda: discount,
        "sales": lambda: price * earned,
        # At most 18 digits on the way, which Spark keeps in a long.
        "profit": lambda: price * (earned - part_cost - nation_cost).cast(RATE),
    }
    return lines.select(*[made[c]().alias(c) for c in columns])


def _with_customers(
    spark: SparkSession, folder: str, orders: DataFrame, wanted: set[str]
) -> DataFrame:
    """Orders beside their customers, and only then the two tiny tables, each joined by itself:
    Catalyst's estimate of a single table is right, that of a join is not."""
    step = (F.col("c_nationkey") % 10).cast("int")
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        "c_mktsegment",
        "c_nationkey",
        (F.lit(Decimal("0.006")) * step).cast(RATE).alias("nation_cost"),
    )
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    if wanted & {"state", "region"}:
        nations = table(spark, folder, "nation")
        buyers = buyers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if "region" in wanted:
            regions = table(spark, folder, "region")
            buyers = buyers.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return buyers


def returned_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a returned line, one row each."""
    lines = table(spark, folder, "lineitem")
    return lines.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("order_id")
    ).distinct()
