from decimal import Decimal

import pytest
from ledgerlens.functions import band, pct, percent_text, plain_text, ratio, round_n, thousands_text
from pyspark.sql import functions as F

EDGES = (0, 0.10, 0.20)
LABELS = ("none", "to 10%", "to 20%", "more")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value, digits, expected",
    [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (-0.3, 0, 0.0)],
)
def test_round_n(spark, value, digits, expected):
    got = one(spark, round_n(F.lit(value), digits))
    assert got == expected and str(got) == str(expected)  # 0.0, never -0.0


def test_ratio_of_zero_is_null(spark):
    assert one(spark, pct(F.lit(5), F.lit(0), 2)) is None
    assert one(spark, ratio(F.lit(None).cast("double"), F.lit(2.0))) is None
    assert one(spark, pct(F.lit(1), F.lit(3), 2)) == 33.33


@pytest.mark.parametrize(
    "value, label",
    [
        (0.0, "none"),
        (0.1, "to 10%"),
        (0.2, "to 20%"),
        (0.2000001, "more"),
        (-0.5, "to 10%"),
        (None, "more"),
    ],
)
@pytest.mark.parametrize("kind", ["double", "decimal(9,7)"])
def test_band(spark, value, label, kind):
    assert one(spark, band(F.lit(value).cast(kind), EDGES, LABELS)) == label


def test_band_needs_matching_labels():
    with pytest.raises(ValueError):
        band(None, EDGES, LABELS[:-1])


@pytest.mark.parametrize("value", [11.25, 11.35, -0.04, 1234.56, -77.4, 0.05])
def test_percent_text_is_python_formatting(spark, value):
    assert one(spark, percent_text(F.lit(value), 1)) == f"{value:.1f}%"
    assert one(spark, percent_text(F.lit(value), 2)) == f"{value:.2f}%"


@pytest.mark.parametrize("value", [-17725.0, 0.0, 55618.0, 1234567.0])
def test_thousands_text_is_python_formatting(spark, value):
    assert one(spark, thousands_text(F.lit(value))) == f"{value:,.0f}"


@pytest.mark.parametrize("value", [0.0, -10.05, 2297201.0, 12345678.0, -9.87654321025e9, 1e12, None])
def test_plain_text_is_python_text(spark, value):
    want = None if value is None else repr(value)
    assert one(spark, plain_text(F.lit(value).cast("double"))) == want


def test_exact_sums_do_not_depend_on_order(spark):
    from ledgerlens.functions import exact

    values = [0.1, 1e9, -1e9, 0.2] * 500
    frames = [spark.createDataFrame([(v,) for v in vs], "x double") for vs in (values, values[::-1])]
    sums = [f.agg(F.sum(exact(F.col("x"), f.schema["x"].dataType))).first()[0] for f in frames]
    assert sums[0] == sums[1] == Decimal("150.000000")
