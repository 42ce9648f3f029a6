"""Ledger lists (L1-L7): optional inclusive date range and exact location,
newest first, match counts, and the display projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import as_date
from .periods import month_partition_filter

INCOME_DISPLAY = ("doc_no", "doc_date", "customer", "location", "amount", "vat", "grand_total", "status")
EXPENSE_DISPLAY = ("doc_no", "doc_date", "supplier", "type", "location", "amount", "vat", "grand_total", "status")


def ledger_filter(df: DataFrame, start: str | dt.date | None = None, end: str | dt.date | None = None,
                  location: str | None = None) -> DataFrame:
    """AND of the given filters; lists take ``location`` literally (no ``All``)."""
    s, e = as_date(start), as_date(end)
    df = month_partition_filter(df, s, e)
    if s is not None:
        df = df.filter(F.col("doc_date") >= F.lit(s))
    if e is not None:
        df = df.filter(F.col("doc_date") <= F.lit(e))
    if location:
        df = df.filter(F.col("location") == F.lit(location))
    return df


def ledger_list(df: DataFrame, start=None, end=None, location=None) -> DataFrame:
    """L1-L3: filtered rows, newest first (row_id breaks ties). The sort is a
    range-partitioned distributed sort; nothing is gathered on the driver. The
    month column of snapshots serves the filter and is not part of a list."""
    return ledger_filter(df, start, end, location).drop("doc_month").orderBy(F.col("doc_date").desc(), F.col("row_id"))


def list_total(df: DataFrame, ledger: str, start=None, end=None, location=None) -> DataFrame:
    """L4: match count with the filters echoed (one row)."""
    def echo(v):
        return F.lit(None if v is None else str(v)).cast("string")
    return ledger_filter(df, start, end, location).agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(ledger).alias("ledger"), echo(start).alias("start_date"), echo(end).alias("end_date"),
        echo(location).alias("location"), "total")


def display(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The table columns; money as double with null → 0."""
    out = []
    for c in columns:
        if c in ("amount", "vat", "grand_total"):
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
