"""Profit & Loss (measure ``amount``, without VAT).

Plan: income scan → filter → one aggregate per customer; expense scan →
filter (COGS, OPEX) → one aggregate per (type, category key) → dimension
join on aggregated rows. Totals and metrics are computed from those
aggregated rows; everything after the two aggregates is report-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..operators.breakdown import breakdown, period_table, unpivot
from ..operators.periods import period_sums, range_filter, to_long, zero_rows
from ..params import ReportParams

PNL_SECTIONS = {"COGS": "cogs", "OPEX": "operating_expenses"}
METRICS = ("gross_profit", "ebit", "income_tax", "net_earnings")


def revenue_lines(income: DataFrame, params: ReportParams) -> DataFrame:
    """Revenue by customer × period, zero-filled."""
    rows = range_filter(income, params).select("customer", "doc_date", "amount")
    sums = period_sums(rows, ["customer"], "amount", params)
    return sums.selectExpr("'revenue' AS section", "customer AS item", "CAST(NULL AS STRING) AS subitem",
                           "'customer' AS kind", "posexplode(amounts) AS (period_idx, amount)")


def add_metrics(table: DataFrame) -> DataFrame:
    """P10-P13 on the per-period table (revenue, cogs, operating_expenses),
    exact decimals."""
    gross = "(revenue - cogs)"
    ebit = f"({gross} - operating_expenses)"
    tax = f"greatest(CAST(0 AS DECIMAL(3,2)), {ebit} * CAST({S.TAX_RATE} AS DECIMAL(3,2)))"
    return table.selectExpr("*", f"{gross} AS gross_profit", f"{ebit} AS ebit", f"{tax} AS income_tax",
                            f"{ebit} - {tax} AS net_earnings")


def pnl_parts(spark: SparkSession, income: DataFrame, expenses: DataFrame, dim: DataFrame,
              params: ReportParams) -> dict[str, DataFrame]:
    rev = revenue_lines(income, params)
    br = breakdown(expenses, dim, "amount", PNL_SECTIONS, params)
    sections = ["revenue", *PNL_SECTIONS.values()]
    table = add_metrics(period_table([rev, br.matched], zero_rows(spark, sections, params), sections))
    return {"revenue": rev, "expenses": br.lines,
            "totals": unpivot(table, sections, "total", "decimal(38,2)"),
            "metrics": unpivot(table, list(METRICS), "metric", "decimal(38,4)")}


def pnl_report(spark: SparkSession, income: DataFrame, expenses: DataFrame, dim: DataFrame,
               params: ReportParams) -> DataFrame:
    """The whole statement as long rows
    (section, item, subitem, kind, period_idx, period, amount)."""
    parts = pnl_parts(spark, income, expenses, dim, params)
    out = None
    for p in parts.values():
        p = to_long(p, params)
        out = p if out is None else out.unionByName(p)
    return out
