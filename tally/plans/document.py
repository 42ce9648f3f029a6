"""Reports as nested documents.

A document has one member per row: ``path`` (dotted, from the root), ``key``
(the name under that path, null for single members) and ``json``. Customers and
categories are rows, so the document's size is spread over tasks however many
there are; the largest single member is one category with its subcategories.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ReportParams

#: Where the lines of a report stand in its document, as
#: (section, kind) -> path; expense categories stand under ``<path>``.
PNL_PATHS = {
    ("revenue", "customer"): "revenue.revenue_by_customer",
    ("revenue", "total"): "revenue.total_net_revenue",
    ("cogs", "category"): "cogs.expenses_by_category",
    ("cogs", "total"): "cogs.total",
    ("gross_profit", "metric"): "gross_profit",
    ("operating_expenses", "category"): "operating_expenses.expenses_by_category",
    ("operating_expenses", "total"): "operating_expenses.total",
    ("ebit", "metric"): "ebit",
    ("income_tax", "metric"): "income_tax",
    ("net_earnings", "metric"): "net_earnings",
}
CASHFLOW_PATHS = {
    ("sales_income", "total"): "cash_inflows.sales_income",
    ("fundings", "metric"): "cash_inflows.fundings",
    ("other_income", "metric"): "cash_inflows.other_income",
    ("total_inflows", "metric"): "cash_inflows.total_inflows",
    ("cogs", "category"): "cash_outflows.cogs.expenses_by_category",
    ("cogs", "total"): "cash_outflows.cogs.total",
    ("opex", "category"): "cash_outflows.opex.expenses_by_category",
    ("opex", "total"): "cash_outflows.opex.total",
    ("capex", "category"): "cash_outflows.capex.expenses_by_category",
    ("capex", "total"): "cash_outflows.capex.total",
    ("total_outflows", "metric"): "cash_outflows.total_outflows",
    ("net_cashflow", "metric"): "net_cashflow",
    ("opening_balance", "metric"): "opening_balance",
    ("closing_balance", "metric"): "closing_balance",
}


def report_info(params: ReportParams) -> dict:
    """The report's metadata: range, format, location (``All``) and periods."""
    return {"start_date": params.start.isoformat(), "end_date": params.end.isoformat(), "format": params.fmt,
            "location": params.location_label, "periods": params.period_labels()}


def document(long: DataFrame, params: ReportParams, paths: dict[tuple[str, str], str]) -> DataFrame:
    """``long`` report lines → document members, the metadata first among them."""
    def values(periods):
        return F.map_from_entries(F.transform(periods, lambda p: F.struct(p["period"], p["v"])))

    lines = (long.withColumn("part", F.expr("CASE WHEN kind IN ('sub', 'direct') THEN 'category' ELSE kind END"))
             .groupBy("section", "part", "kind", "item", "subitem")
             .agg(F.sort_array(F.collect_list(F.struct("period_idx", "period", F.col("amount").cast("decimal(24,2)").alias("v"))))
                  .alias("periods")))
    spark = long.sparkSession
    where = spark.createDataFrame([(*k, p) for k, p in paths.items()], "section string, part string, path string")
    # ``where`` has one row per path of the document.
    placed = lines.join(F.broadcast(where), ["section", "part"])
    single = placed.filter("part <> 'category'").select(
        "path", F.when(F.col("part") == "customer", F.col("item")).alias("key"),
        F.to_json(values(F.col("periods"))).alias("json"))
    category = (placed.filter("part = 'category'").groupBy("path", F.col("item").alias("key"))
                .agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "sub", F.struct("subitem", "periods")))).alias("subs"),
                     F.max(F.when(F.col("kind") == "direct", F.col("periods"))).alias("direct")))
    named = F.map_from_entries(F.transform("subs", lambda e: F.struct(e["subitem"], values(e["periods"]))))
    category = category.select("path", "key", F.to_json(F.struct(
        named.alias("subcategories"), F.when(F.col("direct").isNotNull(), values(F.col("direct"))).alias("direct"))).alias("json"))
    info = spark.createDataFrame([("report_info", None, json.dumps(report_info(params), separators=(",", ":")))],
                                 "path string, key string, json string")
    return info.unionByName(single).unionByName(category)
