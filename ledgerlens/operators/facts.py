"""Order lines as additive facts, so that one report definition serves lines and small cubes.

Every measure a report needs is a sum over lines (or a first/last date). Sums of sums are the
same sums, so a report can run on the lines directly, or on *cubes*: the lines summed once over
a few sets of dimensions. Distinct orders do not add up, but the set of them does: one more grouping set
of the same pass keeps each order once for every member it has, and any union of such sets gives
exact counts again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.session import durable

SUMS = ("lines", "loss_lines", "sales", "profit", "discount_sales")
DATES = {"first_date": F.min, "last_date": F.max}

# Few and narrow on purpose: a task keeps one running sum per member of each set, so sets of
# small domains shrink to almost nothing before the shuffle. One set over all dimensions would
# hardly shrink at all.
CUBES = (
    ("state", "region", "discount"),
    ("category", "sub_category", "segment"),
    ("order_year",),
)
DIMENSIONS = tuple(d for cube in CUBES for d in cube)

# The groupings for which a report counts distinct orders, and the set that serves them all.
ORDER_GROUPINGS = ((), ("order_year",), ("region",))
ORDER_SET = ("order_id", "order_year", "region")


@dataclass(frozen=True)
class Facts:
    """`frame` holds dimensions and measures; `order_counts` only exists beside a cube."""

    frame: DataFrame
    order_counts: DataFrame | None = None

    def serving(self, columns: Iterable[str]) -> Facts:
        return self

    def totals(
        self, *keys: str, orders: bool = False, extra: Iterable[Column] = ()
    ) -> DataFrame:
        """Measures per key; `extra` are further sums, `orders` adds distinct orders."""
        sums = [F.sum(m).alias(m) for m in SUMS[2:] if m in self.frame.columns]
        counts = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in SUMS[:2]]
        dates = [f(d).alias(d) for d, f in DATES.items() if d in self.frame.columns]
        aggregates = [*counts, *sums, *dates, *extra]
        if not orders:
            return self.frame.groupBy(*keys).agg(*aggregates)
        if self.order_counts is None:
            # Spark de-duplicates (key, order) on the map side and shuffles on both, so neither
            # a hot key nor a hot order piles up in one task.
            distinct = F.count_distinct("order_id").alias("orders")
            return self.frame.groupBy(*keys).agg(*aggregates, distinct)
        sums_only = self.frame.groupBy(*keys).agg(*aggregates)
        counted = self.order_counts.filter(F.col("grouping") == "/".join(keys)).select(
            *keys, "orders"
        )
        # Both sides hold one row per key; stacking them and summing again matches NULL keys too.
        both = sums_only.unionByName(counted, allowMissingColumns=True)
        merged = [DATES.get(c, F.sum)(c).alias(c) for c in both.columns if c not in keys]
        return both.groupBy(*keys).agg(*merged)


def line_facts(orders: DataFrame) -> Facts:
    """One fact per order line; columns the caller left out are simply absent."""
    columns = set(orders.columns)
    types = {f.name: f.dataType for f in orders.schema.fields}
    added: dict[str, Column] = {"lines": F.lit(1).cast("long")}
    if "order_date" in columns:
        added |= {
            "order_year": F.year("order_date").cast("long"),
            "first_date": F.col("order_date"),
            "last_date": F.col("order_date"),
        }
    for measure in ("sales", "profit"):
        if measure in columns:
            added[measure] = exact(F.col(measure), types[measure])
    added["loss_lines"] = (
        F.coalesce((F.col("profit") < 0).cast("long"), F.lit(0).cast("long"))
        if "profit" in columns
        else F.lit(0).cast("long")
    )
    if {"sales", "discount"} <= columns:
        added["discount_sales"] = exact(F.col("discount"), types["discount"]) * exact(
            F.col("sales"), types["sales"]
        )
    return Facts(orders.withColumns(added))


@dataclass(frozen=True)
class Cubes:
    """The lines summed over each set of CUBES, and the distinct orders of ORDER_GROUPINGS."""

    sums: DataFrame
    order_counts: DataFrame

    def serving(self, columns: Iterable[str]) -> Facts:
        """The cube that answers a report on these staging columns."""
        wanted = {"order_year" if c == "order_date" else c for c in columns} & set(DIMENSIONS)
        for number, cube in enumerate(CUBES):
            if wanted <= set(cube):
                frame = self.sums.filter(F.col("cube") == number)
                others = [d for d in DIMENSIONS if d not in cube]
                return Facts(frame.drop("cube", *others), self.order_counts)
        raise ValueError(f"no cube holds {sorted(wanted)} together")


def grouped_once(lines: Facts) -> DataFrame:
    """The lines grouped over every set of CUBES and over ORDER_SET, in one pass and one shuffle.

    `cube` numbers the sets, the order set last. Sums are made before the shuffle; an order's lines
    of one task are one row there. The order set makes no sums, so its rows are narrow in the shuffle.
    """
    names = (*DIMENSIONS, "order_id")
    sets = (*CUBES, ORDER_SET)
    # Spark numbers a grouping set by the dimensions it leaves out, one bit each.
    ids = [int("".join("0" if d in cube else "1" for d in names), 2) for cube in sets]
    number = F.lit(None).cast("int")
    for i, own in enumerate(ids):
        number = F.when(F.grouping_id() == own, i).otherwise(number)
    summed = F.grouping_id() != ids[-1]
    return lines.frame.groupingSets([list(c) for c in sets], *names).agg(
        number.alias("cube"),
        *[F.sum(F.when(summed, F.col(m))).alias(m) for m in SUMS],
        *[f(F.when(summed, F.col(d))).alias(d) for d, f in DATES.items()],
    )


def count_orders(orders: DataFrame) -> DataFrame:
    """(grouping, order_year, region, orders) from distinct rows of ORDER_SET.

    The rows move once, by order. A row counts for one member of each grouping, so an order's copies
    are told apart where they are; they are summed before anything else is shuffled. Neither a
    sort nor a window is needed, and a hot member is as many rows as tasks.
    """
    copies = F.array(
        *[
            F.struct(
                F.lit("/".join(g)).alias("grouping"),
                *[
                    (F.col(c) if c in g else F.lit(None).cast(t)).alias(c)
                    for c, t in (("order_year", "long"), ("region", "string"))
                ],
            )
            for g in ORDER_GROUPINGS
        ]
    )
    placed = orders.filter("order_id IS NOT NULL").select(*ORDER_SET).repartition("order_id")
    members = placed.select("order_id", F.inline(copies)).distinct()
    return members.groupBy("grouping", "order_year", "region").agg(F.count(F.lit(1)).alias("orders"))


def cubes(lines: Facts) -> Cubes:
    """Read the lines once for all reports: sums of every cube, and distinct orders."""
    if "order_id" not in lines.frame.columns:
        raise ValueError("cubes count orders, so the lines need an order_id")
    # One folder for each set, so that reading a cube touches no order.
    grouped = durable(grouped_once(lines), "cubes", by="cube")
    orders = durable(count_orders(grouped.filter(F.col("cube") == len(CUBES))), "orders")
    return Cubes(grouped.filter(F.col("cube") < len(CUBES)).drop("order_id"), orders)
