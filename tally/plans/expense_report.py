"""Expense report aggregates (E1-E5): monthly trend by type, the fixed-order
type series, category mix per type, and the type summary with a TOTAL row.

Each is one hash aggregate over the (optionally filtered) expense ledger,
combined map-side; category names are joined onto aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..operators.categories import resolve
from ..operators.filters import ledger_filter

TOTAL_LABEL = "TOTAL"
CURRENCY_SIGN = "฿"


def expense_trend(expenses: DataFrame, start=None, end=None, location=None) -> DataFrame:
    """Month (``yyyy-MM``) × type → sum(grand_total); present groups only."""
    df = ledger_filter(expenses, start, end, location)
    return (df.groupBy(F.date_format("doc_date", "yyyy-MM").alias("month"), "type")
              .agg(F.sum("grand_total").cast("double").alias("grand_total")))


def expense_trend_wide(expenses: DataFrame, start=None, end=None, location=None) -> DataFrame:
    """One column per type in fixed order (pivot values given, so no
    extra job and a fixed column order); null where a type has no row."""
    df = ledger_filter(expenses, start, end, location)
    wide = (df.groupBy(F.date_format("doc_date", "yyyy-MM").alias("month"))
              .pivot("type", list(S.EXPENSE_TYPES)).agg(F.sum("grand_total")))
    return wide.select("month", *[F.col(t).cast("double").alias(t) for t in S.EXPENSE_TYPES])


def expense_category_mix(expenses: DataFrame, dim: DataFrame, by: str = "category",
                         start=None, end=None, location=None) -> DataFrame:
    """Within each type, sum(grand_total) per category, largest first.

    ``by="category"`` groups by the resolved parent category (the default);
    ``by="subcategory_free"`` groups by that free-text column as the
    dashboard literally does. The null group is dropped either way.
    """
    df = ledger_filter(expenses, start, end, location)
    if by == "subcategory_free":
        agg = (df.filter(F.col("subcategory_free").isNotNull())
                 .groupBy("type", F.col("subcategory_free").alias("category"))
                 .agg(F.sum("grand_total").alias("amount")))
    else:
        per_key = df.groupBy("type", "category_key").agg(F.sum("grand_total").alias("amount"))
        agg = (resolve(per_key, dim).filter(F.col("category").isNotNull())
               .groupBy("type", "category").agg(F.sum("amount").alias("amount")))
    rank = Window.partitionBy("type").orderBy(F.col("amount").desc(), F.col("category"))
    return agg.select("type", "category", F.col("amount").cast("double").alias("grand_total"),
                      F.row_number().over(rank).alias("rank"))


def expense_type_summary(expenses: DataFrame, start=None, end=None, location=None) -> DataFrame:
    """Per type sum and count, plus a TOTAL row over all rows, also
    where there is none. Amount also rendered as currency text.

    One global aggregate: a conditional sum and count for each of the fixed
    types and one over all rows, read off as rows. No row is expanded for the
    total and no type is aggregated twice; types without rows are left out."""
    df = ledger_filter(expenses, start, end, location)
    entries = ["named_struct('type', '{0}', 'rows', count_if(type = '{0}'), 'count', count(CASE WHEN type = '{0}' THEN doc_no END), "
               "'amount', sum(CASE WHEN type = '{0}' THEN grand_total END))".format(t) for t in S.EXPENSE_TYPES]
    entries.append(f"named_struct('type', '{TOTAL_LABEL}', 'rows', 1L, 'count', count(doc_no), 'amount', sum(grand_total))")
    rows = (df.agg(F.expr(f"array({', '.join(entries)})").alias("rows"))
            .selectExpr("inline(rows)").filter("rows > 0"))
    amount = F.coalesce(F.col("amount"), F.lit(0).cast(S.MONEY))
    return rows.select("type", amount.cast("double").alias("total_amount"),
                       F.concat(F.lit(CURRENCY_SIGN), F.format_number(amount, 2)).alias("total_amount_text"),
                       F.col("count"))
