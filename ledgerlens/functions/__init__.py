"""Column helpers; every one returns a plain Spark expression."""

from ledgerlens.functions.bands import band, literal
from ledgerlens.functions.labels import percent_text, plain_text, thousands_text
from ledgerlens.functions.numbers import exact, pct, ratio, round_n

__all__ = [
    "band",
    "exact",
    "literal",
    "pct",
    "percent_text",
    "plain_text",
    "ratio",
    "round_n",
    "thousands_text",
]
