"""Statements as data (T1-T3): ordered rows with their roles and one column
per period, built from the long report in one aggregate (a conditional sum
per period label: fixed column order, no extra job). Category subheaders are
emitted by the lines themselves; the few section headers come from a
parameter-sized frame, never from ledger rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ReportParams

ROLE_COLUMNS = ("is_header", "is_subheader", "is_subitem", "is_total", "is_final")

# Statement lines: (order key, label, roles) for fixed rows; a row may have
# several roles. Order keys leave room for the per-item lines, which sort inside
# their section.
PNL_FIXED = {
    ("revenue", None, "total"): (1, 9, "Total Revenue", "is_total"),
    ("cogs", None, "total"): (2, 9, "Total COGS", "is_total"),
    ("gross_profit", None, "metric"): (3, 0, "GROSS PROFIT", "is_total"),
    ("operating_expenses", None, "total"): (4, 9, "Total OPEX", "is_total"),
    ("ebit", None, "metric"): (5, 0, "EBIT", "is_total"),
    ("income_tax", None, "metric"): (5, 1, "Income Tax (15%)", "is_subitem"),
    ("net_earnings", None, "metric"): (5, 2, "NET EARNINGS", "is_total is_final"),
}
PNL_HEADERS = [(1, 0, "REVENUE", "is_header"), (2, 0, "COST OF GOODS SOLD", "is_header"),
               (4, 0, "OPERATING EXPENSES", "is_header")]
PNL_SECTION_NO = {"revenue": 1, "cogs": 2, "operating_expenses": 4}

CF_FIXED = {
    ("opening_balance", None, "metric"): (0, 0, "OPENING BALANCE", "is_header"),
    ("sales_income", None, "total"): (1, 1, "  Sales Income", "is_subitem"),
    ("fundings", None, "metric"): (1, 2, "  Fundings", "is_subitem"),
    ("other_income", None, "metric"): (1, 3, "  Other Income", "is_subitem"),
    ("total_inflows", None, "metric"): (1, 9, "Total Inflows", "is_total"),
    ("cogs", None, "total"): (2, 9, "  Total COGS", "is_subitem"),
    ("opex", None, "total"): (3, 9, "  Total OPEX", "is_subitem"),
    ("capex", None, "total"): (4, 9, "  Total CAPEX", "is_subitem"),
    ("total_outflows", None, "metric"): (5, 0, "Total Outflows", "is_total"),
    ("net_cashflow", None, "metric"): (6, 0, "NET CASHFLOW", "is_total"),
    ("closing_balance", None, "metric"): (6, 1, "CLOSING BALANCE", "is_total is_final"),
}
CF_HEADERS = [(1, 0, "CASH INFLOWS", "is_header"), (2, -1, "CASH OUTFLOWS", "is_header"),
              (2, 0, "  Cost of Goods Sold", "is_subheader"), (3, 0, "  Operating Expenses", "is_subheader"),
              (4, 0, "  Capital Expenses", "is_subheader")]
CF_SECTION_NO = {"cogs": 2, "opex": 3, "capex": 4}


def _sql_value(v) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _fixed_sql(table: dict, idx: int) -> str:
    """CASE over (section, kind) for one field of the fixed lines."""
    return "CASE " + " ".join(
        f"WHEN section = '{section}' AND kind = '{kind}' THEN {_sql_value(v[idx])}"
        for (section, _, kind), v in table.items()) + " END"


def _line_rows(fixed: dict, section_no: dict[str, int], item_indent: str, sub_indent: str,
               with_subheaders: bool) -> str:
    """SQL of the array of statement lines that a long row becomes (section_no, block, sort
    keys, label, role); with ``with_subheaders`` each category line also
    yields its category's subheader row (amount null), so subheaders come
    out of the same aggregate as the lines instead of a second pass.
    Written as SQL expression text (one JVM parse each)."""
    sec_no = "CASE " + " ".join(f"WHEN section = '{s}' THEN {n}" for s, n in section_no.items()) + " END"
    is_item = "kind IN ('customer', 'sub', 'direct')"
    in_group = "kind IN ('sub', 'direct')"
    label_item = (f"CASE WHEN kind = 'customer' THEN concat('{item_indent}', item) "
                  f"WHEN kind = 'sub' THEN concat('{sub_indent}', subitem) ELSE '{sub_indent}Direct' END")
    section_no_c = f"CASE WHEN {is_item} THEN {sec_no} ELSE {_fixed_sql(fixed, 0)} END"
    block = f"CASE WHEN {is_item} THEN 5 ELSE {_fixed_sql(fixed, 1)} END"
    group_key = f"CASE WHEN {in_group} THEN item END"
    line = (f"named_struct('section_no', {section_no_c}, 'block', {block}, 'group_key', {group_key}, "
            f"'direct_last', CASE WHEN kind = 'direct' THEN 1 ELSE 0 END, "
            f"'sort_name', coalesce(subitem, item), "
            f"'item_label', CASE WHEN {is_item} THEN {label_item} ELSE {_fixed_sql(fixed, 2)} END, "
            f"'role', CASE WHEN {is_item} THEN 'is_subitem' ELSE {_fixed_sql(fixed, 3)} END, "
            f"'period', period, 'amount', amount)")
    entries = [line]
    if with_subheaders:
        entries.append(
            f"CASE WHEN {in_group} THEN named_struct('section_no', {section_no_c}, 'block', {block}, "
            f"'group_key', {group_key}, 'direct_last', -1, 'sort_name', '', "
            f"'item_label', concat('  ', item), 'role', 'is_subheader', "
            f"'period', CAST(NULL AS STRING), 'amount', CAST(NULL AS DOUBLE)) END")
    return f"array_compact(array({', '.join(entries)}))"


def _statement(long: DataFrame, params: ReportParams, fixed, headers, section_no, item_indent, sub_indent,
               subheaders: bool) -> DataFrame:
    """The whole step is one SQL query over the report: the report's plan is
    large, and each DataFrame call on top of it would have it checked again."""
    lines = _line_rows(fixed, section_no, item_indent, sub_indent, subheaders)
    periods = params.period_labels()
    keys = "section_no, block, group_key, direct_last, sort_name, item_label, role"
    # One aggregate: a conditional sum per period label (fixed, ≤ 13 columns).
    sums = ", ".join(f"sum(CASE WHEN period = '{p}' THEN amount END) AS `{p}`" for p in periods)
    blank = ", ".join("CAST(NULL AS DOUBLE)" for _ in periods)
    heads = ", ".join(f"({s}, {b}, CAST(NULL AS STRING), 0, '', {_sql_value(label)}, '{role}')" for s, b, label, role in headers)
    roles = ", ".join(f"array_contains(split(role, ' '), '{r}') AS {r}" for r in ROLE_COLUMNS)
    return long.sparkSession.sql(f"""
        WITH line AS (SELECT inline({lines}) FROM {{long}}),
        every AS (
          SELECT {keys}, {sums} FROM line WHERE section_no IS NOT NULL GROUP BY {keys}
          UNION ALL SELECT {keys}, {blank} FROM VALUES {heads} AS head({keys}))
        SELECT CAST(section_no AS INT) AS section_no, CAST(block AS INT) AS block, group_key,
               CAST(direct_last AS INT) AS direct_last, sort_name, item_label AS item, {roles},
               {', '.join(f'`{p}`' for p in periods)}
        FROM every""", long=long)


def statement_order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("section_no", "block", "group_key", "direct_last", "sort_name")]


def pnl_statement_wide(long: DataFrame, params: ReportParams) -> DataFrame:
    """P&L lines in statement order with roles and one column per period."""
    return _statement(long, params, PNL_FIXED, PNL_HEADERS, PNL_SECTION_NO, "  ", "    ", True)


def cashflow_statement_wide(long: DataFrame, params: ReportParams) -> DataFrame:
    """Cashflow lines in statement order (direct lines always shown)."""
    return _statement(long, params, CF_FIXED, CF_HEADERS, CF_SECTION_NO, "  ", "    ", False)


def as_text(wide: DataFrame, params: ReportParams) -> DataFrame:
    """Numbers as ``1,234,567.50``; blanks stay blank (empty text)."""
    periods = params.period_labels()
    out = [F.col(c) for c in wide.columns if c not in periods]
    for p in periods:
        out.append(F.coalesce(F.format_number(F.col(f"`{p}`"), 2), F.lit("")).alias(p))
    return wide.select(*out)
