"""Hand-set bands over a measure."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: float | str | Decimal) -> Column:
    """A bound as written: 0.2 means 0.2 against decimals and against doubles."""
    return F.lit(Decimal(str(value)))


def band(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the band a value falls in.

    The first edge is a value of its own (no discount), the others are inclusive upper bounds,
    the last label is open-ended. As in an ordered CASE, a NULL matches no bound and gets the
    last label.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("one label per edge and one for the open end")
    chain = F.when(column == literal(edges[0]), F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        chain = chain.when(column <= literal(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))
