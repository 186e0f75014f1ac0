"""Declared columns of an order-line feed, and the typed staging layer made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Contract = Sequence[tuple[str, str, str]]

# Source header, staging name and type of the retail order-line feed.
RETAIL_CONTRACT: Contract = (
    ("Row ID", "row_id", "int"),
    ("Order ID", "order_id", "string"),
    ("Order Date", "order_date", "date"),
    ("Ship Date", "ship_date", "date"),
    ("Ship Mode", "ship_mode", "string"),
    ("Customer ID", "customer_id", "string"),
    ("Customer Name", "customer_name", "string"),
    ("Segment", "segment", "string"),
    ("Country", "country", "string"),
    ("City", "city", "string"),
    ("State", "state", "string"),
    ("Postal Code", "postal_code", "string"),
    ("Region", "region", "string"),
    ("Product ID", "product_id", "string"),
    ("Category", "category", "string"),
    ("Sub-Category", "sub_category", "string"),
    ("Product Name", "product_name", "string"),
    ("Sales", "sales", "double"),
    ("Quantity", "quantity", "int"),
    ("Discount", "discount", "double"),
    ("Profit", "profit", "double"),
)

# Month first, without padding: 11/8/2017 is the 8th of November.
US_DATE = "M/d/yyyy"


def to_staging(raw: DataFrame, contract: Contract, date_format: str = US_DATE) -> DataFrame:
    """Rename and cast by contract.

    Types are declared, never inferred. Under Spark's ANSI mode a missing column, a value that
    does not fit its type or a date in another format fails the load.
    """

    def typed(source: str, data_type: str) -> Column:
        column = F.col(f"`{source}`")
        return F.to_date(column, date_format) if data_type == "date" else column.cast(data_type)

    return raw.select(*[typed(source, kind).alias(name) for source, name, kind in contract])
