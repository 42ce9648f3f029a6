"""Cashflow statement (measure ``grand_total``, with VAT).

Same shape as the P&L plan: one aggregate per ledger, dimension join on
aggregated rows, then report-sized arithmetic. The running balance is a
window over the per-period table (at most 13 rows, one per period), never
over ledger rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.breakdown import breakdown, period_table, unpivot
from ..operators.periods import period_sums, range_filter, to_long, zero_rows
from ..params import ReportParams

CF_SECTIONS = {"COGS": "cogs", "OPEX": "opex", "CAPEX": "capex"}
BALANCE_TYPE = "decimal(24,2)"
CF_METRICS = ("fundings", "other_income", "total_inflows", "total_outflows", "net_cashflow",
              "opening_balance", "closing_balance")


def sales_inflows(income: DataFrame, params: ReportParams) -> DataFrame:
    """sales income per period; a global aggregate, so every period is
    present (0) even when no income row falls in the range."""
    rows = range_filter(income, params).select("doc_date", "grand_total")
    sums = period_sums(rows, [], "grand_total", params)
    return sums.selectExpr("'sales_income' AS section", "posexplode(amounts) AS (period_idx, amount)")


def balances(wide: DataFrame, params: ReportParams, opening: Decimal) -> DataFrame:
    """closing = opening + running net; opening(n) = closing(n-1).

    ``wide`` has one row per period (≤ 13), so the un-partitioned window
    sits on report-sized data only.
    """
    seed = F.lit(str(opening)).cast(BALANCE_TYPE)
    run = Window.orderBy("period_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = (seed + F.sum("net_cashflow").over(run)).cast(BALANCE_TYPE)
    return wide.select("*", closing.alias("closing_balance"),
                       (closing - F.col("net_cashflow")).cast(BALANCE_TYPE).alias("opening_balance"))


def cashflow_parts(spark: SparkSession, income: DataFrame, expenses: DataFrame, dim: DataFrame,
                   params: ReportParams, opening: Decimal = Decimal("0")) -> dict[str, DataFrame]:
    sales = sales_inflows(income, params)
    br = breakdown(expenses, dim, "grand_total", CF_SECTIONS, params)
    sections = ["sales_income", *CF_SECTIONS.values()]
    wide = period_table([sales, br.matched], zero_rows(spark, sections, params), sections)
    zero = "CAST(0 AS DECIMAL(12,2))"
    inflows = f"(sales_income + {zero} + {zero})"
    outflows = "(cogs + opex + capex)"
    wide = wide.selectExpr("*", f"{zero} AS fundings", f"{zero} AS other_income", f"{inflows} AS total_inflows",
                           f"{outflows} AS total_outflows", f"{inflows} - {outflows} AS net_cashflow")
    wide = balances(wide, params, opening)
    return {"outflow_lines": br.lines,
            "totals": unpivot(wide, sections, "total", "decimal(38,2)"),
            "metrics": unpivot(wide, list(CF_METRICS), "metric", "decimal(38,2)"),
            "wide": wide}


def cashflow_report(spark: SparkSession, income: DataFrame, expenses: DataFrame, dim: DataFrame,
                    params: ReportParams, opening: Decimal = Decimal("0")) -> DataFrame:
    """the whole statement as long rows."""
    parts = cashflow_parts(spark, income, expenses, dim, params, opening)
    out = None
    for key in ("outflow_lines", "totals", "metrics"):
        p = to_long(parts[key], params)
        out = p if out is None else out.unionByName(p)
    return out
