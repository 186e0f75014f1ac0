"""Data-quality gates: each yields a count of offending records, zero passes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import durable


class GateFailure(RuntimeError):
    """Raised when a load may not be published; carries the result rows."""

    version: str | None = None  # the table that failed, when a load was to be published

    def __init__(self, failures: list[tuple[str, int]]) -> None:
        self.failures = failures
        super().__init__("; ".join(f"{name}: {n} failed" for name, n in failures))


@dataclass(frozen=True)
class GateRules:
    """What a good load looks like. `ranges` maps a column to (lowest, highest, lowest allowed?)."""

    expected_rows: int
    key: str
    required_keys: Sequence[str]
    required_measures: Sequence[str]
    order_date: str
    ship_date: str
    first_day: dt.date
    last_day: dt.date
    ranges: Mapping[str, tuple[float | None, float | None, bool]]
    domains: Mapping[str, Sequence[str]]
    grain_key: str
    grain_columns: Sequence[str]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def _outside(column: str, low: float | None, high: float | None, low_allowed: bool) -> list[Column]:
    c, found = F.col(column), []
    if low is not None:
        found.append(c < low if low_allowed else c <= low)
    if high is not None:
        found.append(c > high)
    return found


def _row_rules(rules: GateRules) -> list[tuple[str, str, Column]]:
    """(name, what must hold, condition of an offending line); an unknown condition is no offence."""
    in_time = F.col(rules.order_date)
    return [
        (
            "no_null_keys",
            ", ".join(rules.required_keys) + " are present",
            _any([F.col(c).isNull() for c in rules.required_keys]),
        ),
        (
            "no_null_measures",
            ", ".join(rules.required_measures) + " are present",
            _any([F.col(c).isNull() for c in rules.required_measures]),
        ),
        (
            "date_sanity",
            f"{rules.ship_date} not before {rules.order_date}, "
            f"which lies in {rules.first_day} .. {rules.last_day}",
            _any(
                [
                    F.col(rules.ship_date) < in_time,
                    in_time < F.lit(rules.first_day),
                    in_time > F.lit(rules.last_day),
                ]
            ),
        ),
        (
            "value_range",
            ", ".join(rules.ranges) + " are in range",
            _any([c for name, bounds in rules.ranges.items() for c in _outside(name, *bounds)]),
        ),
        (
            "enum_domain",
            ", ".join(rules.domains) + " hold listed values",
            _any([~F.col(c).isin(*allowed) for c, allowed in rules.domains.items()]),
        ),
    ]


def _mixed_orders(orders: DataFrame, rules: GateRules) -> DataFrame:
    """One row: how many orders hold two values of a column that should be one per order.

    min <> max finds a second value in constant state; like COUNT(DISTINCT) it ignores NULL. Values
    are compared by 64-bit hash, because buffers of longs can be updated in place: the aggregate
    stays a hash aggregate on both sides of the shuffle, and wide lines are never sorted.
    """
    coded = orders.select(
        rules.grain_key,
        *[
            F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"_{i}")
            for i, c in enumerate(rules.grain_columns)
        ],
    )
    mixed = _any([F.min(f"_{i}") != F.max(f"_{i}") for i in range(len(rules.grain_columns))])
    per_order = coded.groupBy(rules.grain_key).agg(F.coalesce(mixed, F.lit(False)).alias("mixed"))
    return per_order.agg(F.count_if("mixed").alias("mixed"))


def line_counts(rules: GateRules) -> list[Column]:
    """Aggregates that count the offending lines of each line rule, by its name."""
    return [F.count_if(condition).alias(name) for name, _, condition in _row_rules(rules)]


def _surplus_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key or lack one.

    Hashes first, then the keys themselves where hashes repeat: a hash that occurs once proves its key
    unique, so only eight bytes of such a key are shuffled, and only keys that share a hash are compared
    by their text. Each text goes once for every task that holds it. Repeated hashes are found before
    the second step is planned; where they are few, no key is shuffled to find theirs.
    """
    hashed = rows.select(key, F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("_hash"))
    per_hash = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    repeated = durable(per_hash.filter("_n > 1 OR _hash IS NULL"), "repeated")
    not_alone = repeated.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("surplus"))
    shared = repeated.filter("_hash IS NOT NULL").select("_hash")
    distinct = hashed.join(shared, "_hash", "left_semi").select(key).distinct()
    found = distinct.agg((-F.count(F.lit(1))).alias("surplus"))
    return not_alone.union(found).agg(F.sum("surplus").alias("surplus"))


def run_gates(
    orders: DataFrame,
    rules: GateRules,
    key_rows: DataFrame | None = None,
    grain_rows: DataFrame | None = None,
    counted: Mapping[str, int] | None = None,
) -> DataFrame:
    """Result rows (check_name, description, failed, ok).

    Three passes instead of one per gate. All line rules are counted side by side without a shuffle;
    the order grain takes one aggregate per order; uniqueness needs every key once. `key_rows` and
    `grain_rows` may supply narrower frames with the same rows for the last two. `counted` holds the
    number of `rows` and the `line_counts` where they are known already, from the write: one pass less.
    """
    row_rules = _row_rules(rules)
    if counted is None:
        counts = orders.agg(F.count(F.lit(1)).alias("rows"), *line_counts(rules))
    else:
        names = ["rows", *(name for name, _, _ in row_rules)]
        counts = orders.sparkSession.createDataFrame(
            [tuple(counted[n] for n in names)], ", ".join(f"{n} long" for n in names)
        )
    missing_rows = F.abs(F.col("rows") - F.lit(rules.expected_rows))

    def entry(position: int, name: str, text: str, failed: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("check_name"),
            F.lit(text).alias("description"),
            failed.cast("long").alias("failed"),
        )

    entries = [
        entry(1, "row_count", f"{rules.expected_rows} rows expected", missing_rows),
        *[entry(3 + i, name, text, F.col(name)) for i, (name, text, _) in enumerate(row_rules)],
    ]
    line_gates = counts.select(F.inline(F.array(*entries)))
    grain = entry(
        3 + len(row_rules),
        "order_grain_consistency",
        f"one value per {rules.grain_key} of " + ", ".join(rules.grain_columns),
        F.col("mixed"),
    )
    mixed = _mixed_orders(orders if grain_rows is None else grain_rows, rules)
    surplus = _surplus_keys(orders if key_rows is None else key_rows, rules.key)
    unique = entry(2, "pk_unique", f"{rules.key} is present and unique", F.col("surplus"))
    fused = line_gates.unionByName(mixed.select(F.inline(F.array(grain))))
    rows = fused.unionByName(surplus.select(F.inline(F.array(unique))))
    return rows.orderBy("position").select(
        "check_name", "description", "failed", (F.col("failed") == 0).alias("ok")
    )


def require(results: DataFrame) -> None:
    """Raise GateFailure unless every gate passed. One row per gate comes to the driver."""
    bad = [(r.check_name, r.failed) for r in results.filter(~F.col("ok")).collect()]
    if bad:
        raise GateFailure(bad)
