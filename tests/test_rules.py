"""Row rules on hand-made edge rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strata.functions import bands, exprs, retail, weather
from tests.conftest import rows

DAY = dt.date(2024, 1, 10)


def one(spark, schema, row, *columns):
    return rows(spark.createDataFrame([row], schema).select(*columns))[0]


@pytest.mark.parametrize(
    "ship, days, status",
    [
        (None, None, "Not Shipped"),
        (dt.date(2024, 1, 9), None, "Not Shipped"),  # before the order: treated as not shipped
        (DAY, 0, "Fast"),
        (dt.date(2024, 1, 13), 3, "Fast"),
        (dt.date(2024, 1, 14), 4, "Standard"),
        (dt.date(2024, 1, 17), 7, "Standard"),
        (dt.date(2024, 1, 18), 8, "Slow"),
    ],
)
def test_delivery(spark, ship, days, status):
    d = retail.delivery_days()
    got = one(spark, "order_date date, ship_date date", (DAY, ship), d, retail.delivery_status(d))
    assert got == (days, status)


def test_margin_is_zero_without_sales_and_class_uses_the_ratio(spark):
    schema = "sales decimal(12,2), profit decimal(12,2)"
    assert one(spark, schema, (D("0.00"), D("5.00")), retail.margin_pct(), retail.profitability()) == (0.0, "Low Margin")
    for profit, label in (("30.00", "High Margin"), ("29.99", "Medium Margin"), ("9.99", "Low Margin"), ("-0.01", "Loss")):
        assert one(spark, schema, (D("100.00"), D(profit)), retail.profitability()) == (label,)


def test_calendar(spark):
    sunday = dt.date(2024, 2, 4)
    parts = retail.date_parts("d", day=True)
    assert one(spark, "d date", (sunday,), *parts.values()) == (2024, 2, 1, 7, 4)
    months = exprs.month_index("b") - exprs.month_index("a")
    assert one(spark, "a date, b date", (dt.date(2024, 1, 31), dt.date(2024, 2, 1)), months) == (1,)
    since = retail.years_between(F.lit(dt.date(2024, 2, 28)), "d")
    assert one(spark, "d date", (dt.date(2020, 2, 29),), since) == (3,)
    assert one(spark, "d date", (dt.date(2020, 2, 28),), since) == (4,)


def test_tiers_at_their_limits(spark):
    schema = "total decimal(12,2), orders bigint"
    cases = {(5000, 10): "VIP", (5000, 9): "Frequent", (1000, 4): "High Value", (999, 4): "Regular"}
    for (total, orders), label in cases.items():
        assert one(spark, schema, (D(total), orders), retail.customer_tier("total", "orders")) == (label,)
    segments = {(10001, 1): "VIP", (10000, 11): "Frequent", (10000, 10): "Regular"}
    for (total, orders), label in segments.items():
        assert one(spark, schema, (D(total), orders), retail.customer_segment("total", "orders")) == (label,)


def test_product_tier_and_volume(spark):
    schema = "revenue decimal(12,2), orders bigint, margin double, qty bigint"
    cases = [
        ((D(10000), 50, 0.0, 100), "Star", "High Volume"),
        ((D(10000), 49, 0.0, 99), "High Performer", "Medium Volume"),
        ((D(1), 20, 0.9, 50), "Popular", "Medium Volume"),
        ((D(1), 1, 0.3, 49), "High Margin", "Low Volume"),
        ((D(1), 1, 0.29, 0), "Standard", "Low Volume"),
    ]
    for row, tier, volume in cases:
        got = one(spark, schema, row, retail.product_tier("revenue", "orders", "margin"), retail.volume_category("qty"))
        assert got == (tier, volume)


def test_comfort_bands(spark):
    schema = "t decimal(5,2), h decimal(5,2), w decimal(5,2)"
    index = weather.comfort_index("t", "h", "w")
    cases = [
        ((D(21), D(45), D(1)), 100, "Excellent"),
        ((D(21), D(45), D(5)), 70, "Good"),
        ((D(16), D(45), D(5)), 60, "Good"),
        ((D(14), D(45), D(1)), 26, "Poor"),
        ((D(-10), D(90), D(9)), 0, "Very Poor"),
    ]
    for row, score, label in cases:
        got = one(spark, schema, row, index.cast("double"), weather.comfort_category(index))
        assert got == (score, label)


def test_felt_temperature_outside_its_range_is_the_temperature(spark):
    schema = "t decimal(5,2), h decimal(5,2), w decimal(5,2)"
    columns = weather.heat_index("t", "h").cast("double"), weather.wind_chill("t", "w")
    assert one(spark, schema, (D(20), D(80), D(9)), *columns) == (20.0, 20.0)
    heat, _ = one(spark, schema, (D(30), D(50), D(0)), *columns)
    assert heat == 37.5
    _, chill = one(spark, schema, (D(-5), D(50), D(5)), *columns)
    assert chill == pytest.approx(13.12 - 0.6215 * 5 - 11.37 * 18**0.16 - 0.3965 * 5 * 18**0.16)


def test_missing_values_raise_no_alert(spark):
    flags = bands.alert_flag("x", ">", 5), weather.severity("x")
    assert one(spark, "x double", (None,), *flags) == (0, "Normal")
    assert one(spark, "x double", (-5.5,), *flags) == (0, "Extreme")


def test_ratio_of_zero_is_missing(spark):
    assert one(spark, "a bigint, b bigint", (1, 0), exprs.ratio("a", "b")) == (None,)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 150), min_size=1, max_size=30))
def test_bands_match_a_plain_loop(spark, xs):
    steps = ((80, "a"), (40, "b"), (0, "c"))
    want = sorted((x, next((label for limit, label in steps if x >= limit), "z")) for x in xs)
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    assert sorted(rows(df.select("x", bands.at_least("x", steps, "z")))) == want
