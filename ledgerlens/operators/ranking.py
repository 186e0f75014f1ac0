"""Rank, running total and next value over a whole table of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import durable


def rank_and_run(
    groups: DataFrame, by: str, ties: Sequence[str], rank: str, running: str,
    ranges: int | None = None,
) -> DataFrame:
    """Rank groups by `by` ascending (NULLs last, ties share a rank) and run its total.

    A window without partitions puts all groups into one task. That is right for a dimension of
    a few thousand members (sub-categories, states). For an open-ended one (products, customers)
    give `ranges`: the groups are then sorted in that many ranges side by side, and each range
    starts from the totals of the ones before it. Both ways give the same rows.
    """
    order = [F.col(by).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    if ranges is None:
        whole = Window.orderBy(*order)
        return groups.withColumns(
            {
                rank: F.rank().over(Window.orderBy(order[0])).cast("long"),
                running: F.sum(by).over(whole.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )

    placed = _in_ranges(groups, order, ranges)
    inside = Window.partitionBy("_range")
    local = placed.withColumns(
        {
            "_rank": F.rank().over(inside.orderBy(order[0])).cast("long"),
            "_run": F.sum(by).over(
                inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    # One row per range: what it holds and how it begins and ends. Plain sums over the written
    # ranges, so that the windows above run once, for the result only.
    value = F.struct(F.col(by).isNull().alias("none"), F.col(by).alias("v"))
    edges = (
        placed.groupBy("_range", by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(by).alias("total"))
        .withColumn("value", value)
        .groupBy("_range")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("value").alias("first"),
            F.max("value").alias("last"),
            F.max_by("n", "value").alias("n_last"),
        )
        .withColumn("last_rank", F.col("n") - F.col("n_last") + 1)
    )
    in_order = Window.orderBy("_range")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns(
        {
            "_rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "_run_before": F.sum("total").over(before),
        }
    ).withColumn(
        # Where the run of equal values at the end of this range began, maybe ranges ago.
        "last_start",
        F.min(F.col("_rows_before") + F.col("last_rank")).over(Window.partitionBy("last")),
    )
    edges = edges.select(
        "_range",
        "_rows_before",
        "_run_before",
        F.col("first").alias("_first"),
        F.when(
            F.lag("last").over(in_order) == F.col("first"), F.lag("last_start").over(in_order)
        ).alias("_tie_start"),
    )
    joined = local.join(F.broadcast(edges), "_range")  # at most `ranges` rows
    continues = F.col("_tie_start").isNotNull() & (value == F.col("_first"))
    run_so_far = F.when(
        F.col("_run").isNotNull() | F.col("_run_before").isNotNull(),
        F.coalesce(F.col("_run"), F.lit(0)) + F.coalesce(F.col("_run_before"), F.lit(0)),
    )
    return joined.select(
        *groups.columns,
        F.when(continues, F.col("_tie_start"))
        .otherwise(F.col("_rows_before") + F.col("_rank"))
        .cast("long")
        .alias(rank),
        run_so_far.alias(running),
    )


def next_value(values: DataFrame, by: str, following: str, ranges: int | None = None) -> DataFrame:
    """Beside each distinct value, the next larger one; `ranges` as in `rank_and_run`."""
    order = F.col(by).asc_nulls_last()
    if ranges is None:
        return values.withColumn(following, F.lead(by).over(Window.orderBy(order)))
    placed = _in_ranges(values, [order], ranges)
    starts = placed.groupBy("_range").agg(F.min(by).alias("start"))
    starts = starts.select(
        "_range", F.lead("start").over(Window.orderBy("_range")).alias("_next_start")
    )
    inside = Window.partitionBy("_range").orderBy(order)
    return placed.join(F.broadcast(starts), "_range").select(  # at most `ranges` rows
        *values.columns,
        F.coalesce(F.lead(by).over(inside), F.col("_next_start")).alias(following),
    )


def _in_ranges(df: DataFrame, order: Sequence[Column], ranges: int) -> DataFrame:
    """Sort-order ranges with their number; kept, as the sampled bounds differ from run to run."""
    placed = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    return durable(placed, "ranges")
