"""Hand-made order lines in staging shape."""

import datetime as dt

SCHEMA = (
    "row_id int, order_id string, order_date date, ship_date date, ship_mode string, "
    "customer_id string, segment string, state string, region string, product_id string, "
    "category string, sub_category string, sales double, quantity int, discount double, "
    "profit double"
)

BASE = {
    "row_id": 1,
    "order_id": "A-1",
    "order_date": dt.date(2016, 3, 1),
    "ship_date": dt.date(2016, 3, 4),
    "ship_mode": "Second Class",
    "customer_id": "C-1",
    "segment": "Consumer",
    "state": "Texas",
    "region": "Central",
    "product_id": "P-1",
    "category": "Furniture",
    "sub_category": "Tables",
    "sales": 100.0,
    "quantity": 2,
    "discount": 0.0,
    "profit": 10.0,
}


def make(spark, *changes):
    rows = [tuple({**BASE, "row_id": i + 1, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)
