"""Parameters of the reports: band edges, cut, thresholds, pivot columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from ledgerlens.operators.gates import GateRules


@dataclass(frozen=True)
class Settings:
    band_edges: Sequence[float]
    band_labels: Sequence[str]
    cut: float
    thresholds: Sequence[float]
    categories: Mapping[str, str]  # column prefix -> category value


# Bands, cut, thresholds and categories of the retail order-line feed.
RETAIL = Settings(
    band_edges=(0, 0.10, 0.20, 0.30, 0.40),
    band_labels=("1. 无折扣", "2. 10%", "3. 15%/20%", "4. 30%", "5. 32%/40%", "6. 45% 以上"),
    cut=0.20,
    thresholds=(0.10, 0.15, 0.20, 0.25, 0.30, 0.35),
    categories={"furniture": "Furniture", "office": "Office Supplies", "tech": "Technology"},
)

# What a good load of that feed looks like.
RETAIL_GATES = GateRules(
    expected_rows=9994,
    key="row_id",
    required_keys=("order_id", "customer_id", "product_id"),
    required_measures=("sales", "quantity", "discount", "profit"),
    order_date="order_date",
    ship_date="ship_date",
    first_day=dt.date(2015, 1, 1),
    last_day=dt.date(2018, 12, 31),
    ranges={
        "discount": (0, 0.8, True),
        "quantity": (0, None, False),
        "sales": (0, None, False),
    },
    domains={
        "category": ("Furniture", "Office Supplies", "Technology"),
        "region": ("Central", "East", "South", "West"),
    },
    grain_key="order_id",
    grain_columns=(
        "order_date", "ship_date", "customer_id", "ship_mode", "state", "region", "segment",
    ),
)
