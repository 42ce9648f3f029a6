"""Column functions on inline edge rows (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tally.functions import is_blank, parse_day_first, parse_money, py_strip, py_title


def one_col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_money_parse(spark):
    got = one_col(spark, ["1,234.50", "x", "", None, "12345678901.00", "-3.5"], parse_money)
    assert got == [Decimal("1234.50"), None, None, None, Decimal("12345678901.00"), Decimal("-3.50")]


def test_day_first_dates(spark):
    vals = ["05/12/2025", "5/1/2025", "2025-12-31", "junk", "31/02/2025", "12/31/2025", "5/12/25", "", None]
    got = one_col(spark, vals, parse_day_first)
    assert got[:3] == [dt.date(2025, 12, 5), dt.date(2025, 1, 5), dt.date(2025, 12, 31)]
    assert got[3:] == [None] * 6


def test_python_title_case(spark):
    got = one_col(spark, ["bkk", "bkk-2a o'neil", "  padded  ", "MIDDLE EAST", None], py_title)
    assert got == ["Bkk", "Bkk-2A O'Neil", "  Padded  ", "Middle East", None]
    assert got == ["bkk".title(), "bkk-2a o'neil".title(), "  padded  ".title(), "MIDDLE EAST".title(), None]


def test_python_strip_and_blank(spark):
    vals = [" 7 ", "\t7\n", " 7　", "7"]
    assert one_col(spark, vals, py_strip) == [v.strip() for v in vals]
    assert one_col(spark, [None, "", "  ", "\t", " a "], is_blank) == [True, True, True, True, False]
