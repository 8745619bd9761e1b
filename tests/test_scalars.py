"""Scalar expressions (SCL-*) on edge cases."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pumpwatch.functions import scalars as sc


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first().y


def test_price_text(spark):
    f = lambda v: one(spark, sc.parse_price_text(F.col("x")), v)
    assert f("199.9¢") == Decimal("199.90")
    assert f(" 1 999.994 ¢") == Decimal("1999.99")
    assert f("2.345") == Decimal("2.35")            # HALF_UP to 2 places
    assert f("nan") is None and f("inf") is None and f("") is None and f("N/D") is None


def test_datetime_formats(spark):
    f = lambda v: one(spark, sc.parse_datetime(F.col("x")), v)
    assert f("2024-03-01T10:15") == dt.datetime(2024, 3, 1, 10, 15)
    assert f("2024-03-01T10:15:30") == dt.datetime(2024, 3, 1, 10, 15, 30)
    assert f("2024-03-01") == dt.datetime(2024, 3, 1)
    assert f("01/03/2024") is None and f("") is None


def test_iso_with_offset_is_utc(spark):
    assert one(spark, sc.parse_iso_timestamp(F.col("x")), "2026-01-01T00:00:00+02:00") == \
        dt.datetime(2025, 12, 31, 22, 0)


def test_next_boundary(spark):
    f = lambda v: one(spark, sc.next_boundary(F.col("x"), 15), v, "x timestamp")
    assert f(dt.datetime(2024, 1, 1, 10, 7, 42)) == dt.datetime(2024, 1, 1, 10, 15)
    assert f(dt.datetime(2024, 1, 1, 10, 15, 42)) == dt.datetime(2024, 1, 1, 10, 15)  # on a boundary
    assert f(dt.datetime(2024, 1, 1, 10, 59, 1)) == dt.datetime(2024, 1, 1, 11, 0)


def test_text_formatting(spark):
    assert one(spark, sc.cents(F.col("x")), None, "x double") == "—"
    assert one(spark, sc.cents(F.col("x"), signed=True), 1.5, "x double") == "+1.5¢"
    assert one(spark, sc.fit_left(F.col("x"), 5), "abcdefgh") == "abcd "
    assert one(spark, sc.pad_right_aligned(F.col("x"), 3), "12345") == "12345"
    assert one(spark, sc.csv_field(F.col("x")), ' a "b"\nc ') == '"a ""b"" c"'
    assert one(spark, sc.region_label(F.col("x")), "") == "N/A"
    assert one(spark, sc.coordinates_text(F.col("x"), F.col("x")), 45.123456, "x double") == \
        "45.1235, 45.1235"
