"""Shared expense breakdown for P&L (measure ``amount``) and cashflow
(measure ``grand_total``): one aggregate over every requested type, then the
category names joined onto the aggregated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ReportParams
from .categories import resolve
from .periods import period_sums, range_predicate


@dataclass
class Breakdown:
    lines: DataFrame    # section, item, subitem, kind ('sub' | 'direct'), period_idx, amount
    matched: DataFrame  # section, period_idx, amount: every row that joined the dimension


def breakdown(expenses: DataFrame, dim: DataFrame, measure: str, sections: dict[str, str],
              params: ReportParams) -> Breakdown:
    """``sections`` maps an expense type to its section name, e.g.
    ``{"COGS": "cogs", "OPEX": "operating_expenses"}``; other types are
    filtered out at the scan."""
    types = list(sections)
    rows = expenses.filter(range_predicate(expenses, params) & F.col("type").isin(*types)) \
                   .select("type", "category_key", "doc_date", measure)
    sums = period_sums(rows, ["type", "category_key"], measure, params)
    resolved = resolve(sums, dim)
    section = "CASE type " + " ".join(f"WHEN '{t}' THEN '{name}'" for t, name in sections.items()) + " END"
    long = resolved.selectExpr(f"{section} AS section", "category", "subcategory", "kind",
                               "posexplode(amounts) AS (period_idx, amount)")
    lines = long.filter(F.col("category").isNotNull()).select(
        "section", F.col("category").alias("item"), F.col("subcategory").alias("subitem"), "kind",
        "period_idx", "amount")
    matched = long.select("section", "period_idx", "amount")
    return Breakdown(lines, matched)


def section_totals(parts: list[DataFrame], zeros: DataFrame) -> DataFrame:
    """Sum (section, period_idx, amount) parts; ``zeros`` makes every
    section × period present. Inputs are already aggregated rows."""
    u = zeros
    for p in parts:
        u = u.unionByName(p.select("section", "period_idx", "amount"))
    return u.groupBy("section", "period_idx").agg(F.sum("amount").alias("amount"))


def period_table(parts: list[DataFrame], zeros: DataFrame, sections: list[str]) -> DataFrame:
    """One row per period with one total column per section, in a single
    aggregate over the (already aggregated) parts; ``zeros`` makes every
    period present. Section totals and report metrics are both read off
    this table, so they share one exchange."""
    u = zeros
    for p in parts:
        u = u.unionByName(p.select("section", "period_idx", "amount"))
    return u.groupBy("period_idx").agg(*[
        F.expr(f"sum(CASE WHEN section = '{s}' THEN amount END)").alias(s) for s in sections])


def unpivot(table: DataFrame, columns: list[str], kind: str, cast: str) -> DataFrame:
    """(period_idx, c1, c2, …) → long rows (section, item, subitem, kind, period_idx, amount)."""
    entries = ", ".join(f"named_struct('section', '{c}', 'amount', CAST(`{c}` AS {cast}))" for c in columns)
    return (table.selectExpr("period_idx", f"explode(array({entries})) AS m")
            .selectExpr("m.section AS section", "CAST(NULL AS STRING) AS item", "CAST(NULL AS STRING) AS subitem",
                        f"'{kind}' AS kind", "period_idx", "m.amount AS amount"))
