"""DuckDB oracle SQL: the same derived ledgers and the same report semantics,
written as plain brute-force SQL (spines by cross join, zero fill by left
join) so it checks the Spark plans rather than repeating them.
"""

from __future__ import annotations

from .. import schemas as S
from ..params import ReportParams
from ..sources import fixtures as FX

SEP = "chr(31)"


def title_sql(x: str) -> str:
    """Python str.title() in DuckDB (runs of cased letters)."""
    return ("array_to_string(list_transform(regexp_extract_all(" + x +
            ", '([\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+)'), "
            "lambda r: upper(r[1]) || lower(r[2:])), '')")


def strip_sql(x: str) -> str:
    ws = ("[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
          "\\x{202f}\\x{205f}\\x{3000}]")
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def _case(col: str, mapping: dict[str, str]) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _money(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DECIMAL(12,2))"


def income_cte() -> str:
    return f"""
income_base AS (
  SELECT o.o_orderkey AS _key,
         CAST(o.o_orderkey AS VARCHAR) AS row_id,
         'INV-' || CAST(o.o_orderkey AS VARCHAR) AS doc_no,
         CAST(o.o_orderdate AS DATE) AS doc_date,
         c.c_name AS customer,
         'THB' AS currency,
         {_money(f"CAST(o.o_totalprice AS DECIMAL(12,2)) * CAST({FX.INCOME_FACTOR} AS DECIMAL(3,2))")} AS amount,
         {_case('o.o_orderstatus', FX.INCOME_STATUS)} AS status,
         {title_sql('r.r_name')} AS location,
         r.r_name AS r_name
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
income_vat AS (
  SELECT *, {_money(f"amount * CAST({FX.INCOME_VAT_RATE} AS DECIMAL(3,2))")} AS vat FROM income_base
),
income_full AS (
  SELECT *, {_money('amount + vat')} AS grand_total FROM income_vat
),
income AS (
  SELECT row_id, doc_no, doc_date, customer, currency, amount, vat, grand_total, status, location,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS created_at,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS updated_at,
         CAST(NULL AS VARCHAR) AS created_by, CAST(NULL AS VARCHAR) AS notes
  FROM income_full
)"""


def _sub_sql() -> str:
    return "CASE WHEN p.p_type = 'PROMO' OR p.p_size % 7 = 0 THEN NULL ELSE p.p_type || '/' || p.p_brand END"


def expense_cte(recurring: tuple[str, ...] = FX.TEST_RECURRING) -> str:
    rec = ", ".join(f"'{r}'" for r in recurring)
    return f"""
expense_base AS (
  SELECT l.l_orderkey AS _key, l.l_linenumber, l.l_shipdate, l.l_partkey, l.l_suppkey,
         l.l_extendedprice, l.l_quantity, r.r_name, p.p_size,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS row_id,
         'BILL-' || CAST(l.l_orderkey AS VARCHAR) AS doc_no,
         CAST(l.l_shipdate AS DATE) AS doc_date,
         CAST(l.l_shipdate AS DATE) + INTERVAL 30 DAY AS overdue_ts,
         s.s_name AS supplier,
         'THB' AS currency,
         {_money("CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))")} AS amount,
         CAST(l.l_tax AS DECIMAL(4,2)) AS tax_rate,
         {_case('l.l_linestatus', FX.EXPENSE_STATUS)} AS status,
         {_case('l.l_returnflag', FX.EXPENSE_TYPE)} AS type,
         {title_sql('r.r_name')} AS location,
         p.p_type AS category,
         {_sub_sql()} AS subcategory,
         concat_ws({SEP}, p.p_type, {_sub_sql()}) AS category_key,
         p.p_type IN ({rec}) AS is_recurring,
         CASE WHEN p.p_type IN ({rec}) THEN 'monthly' END AS recurrence_period
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
expense_vat AS (
  SELECT *, CAST(overdue_ts AS DATE) AS overdue_date, {_money('amount * tax_rate')} AS vat FROM expense_base
),
expense_lines AS (
  SELECT *, {_money('amount + vat')} AS grand_total FROM expense_vat
),
expenses AS (
  SELECT row_id, doc_no, doc_date, overdue_date, supplier, currency, amount, vat, grand_total, status,
         type, location, category_key, CAST(NULL AS VARCHAR) AS subcategory_free, is_recurring,
         recurrence_period, CAST(NULL AS DATE) AS forecasted_until,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS created_at,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS updated_at,
         CAST(NULL AS VARCHAR) AS created_by, CAST(NULL AS VARCHAR) AS notes
  FROM expense_lines
),
dim AS (
  SELECT DISTINCT p_type AS category_key, p_type AS name, CAST(NULL AS VARCHAR) AS parent_key
  FROM part
  UNION ALL
  SELECT DISTINCT concat_ws({SEP}, p.p_type, {_sub_sql()}) AS category_key, {_sub_sql()} AS name,
         p.p_type AS parent_key
  FROM part p WHERE {_sub_sql()} IS NOT NULL
)"""


def ledger_ctes() -> str:
    return "WITH " + income_cte() + "," + expense_cte()


# ---------------------------------------------------------------------------
# Report helpers
# ---------------------------------------------------------------------------

def periods_values(params: ReportParams) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(params.period_labels()))
    return f"periods AS (SELECT CAST(i AS INTEGER) AS period_idx, label AS period FROM (VALUES {rows}) v(i, label))"


def idx_sql(params: ReportParams, col: str = "doc_date") -> str:
    if params.fmt == "yearly":
        return "0"
    return f"((year({col}) - {params.start.year}) * 12 + month({col}) - {params.start.month})"


def range_where(params: ReportParams, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    w = f"{a}doc_date BETWEEN DATE '{params.start.isoformat()}' AND DATE '{params.end.isoformat()}'"
    loc = params.location_filter
    if loc is not None:
        w += f" AND {a}location = '{loc}'"
    return w


def revenue_ctes(params: ReportParams, measure: str = "amount") -> str:
    return f"""
rev_sums AS (
  SELECT customer, {idx_sql(params)} AS period_idx, SUM({measure}) AS amount
  FROM income WHERE {range_where(params)} GROUP BY 1, 2
),
rev_keys AS (SELECT DISTINCT customer FROM rev_sums),
rev_lines AS (
  SELECT 'revenue' AS section, k.customer AS item, CAST(NULL AS VARCHAR) AS subitem, 'customer' AS kind,
         pp.period_idx, COALESCE(s.amount, 0) AS amount
  FROM rev_keys k CROSS JOIN periods pp
  LEFT JOIN rev_sums s ON s.customer = k.customer AND s.period_idx = pp.period_idx
)"""


def breakdown_ctes(params: ReportParams, measure: str, sections: dict[str, str]) -> str:
    types = ", ".join(f"'{t}'" for t in sections)
    sec = "CASE r.type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in sections.items()) + " END"
    return f"""
exp_sums AS (
  SELECT type, category_key, {idx_sql(params)} AS period_idx, SUM({measure}) AS amount
  FROM expenses WHERE {range_where(params)} AND type IN ({types}) GROUP BY 1, 2, 3
),
exp_keys AS (SELECT DISTINCT type, category_key FROM exp_sums),
exp_res AS (
  SELECT k.type, k.category_key, d.name AS own_name, d.parent_key, pd.name AS parent_name
  FROM exp_keys k JOIN dim d ON k.category_key = d.category_key
  LEFT JOIN dim pd ON d.parent_key = pd.category_key
),
exp_long AS (
  SELECT {sec} AS section,
         CASE WHEN r.parent_key IS NOT NULL THEN r.parent_name ELSE r.own_name END AS item,
         CASE WHEN r.parent_key IS NOT NULL THEN r.own_name END AS subitem,
         CASE WHEN r.parent_key IS NOT NULL THEN 'sub' ELSE 'direct' END AS kind,
         pp.period_idx, COALESCE(s.amount, 0) AS amount
  FROM exp_res r CROSS JOIN periods pp
  LEFT JOIN exp_sums s ON s.type = r.type AND s.category_key = r.category_key AND s.period_idx = pp.period_idx
),
exp_lines AS (SELECT * FROM exp_long WHERE item IS NOT NULL)"""


def totals_cte(sections: list[str], parts: list[str]) -> str:
    secs = ", ".join(f"('{s}')" for s in sections)
    union = " UNION ALL ".join(f"SELECT section, period_idx, amount FROM {p}" for p in parts)
    return f"""
totals AS (
  SELECT s.section, pp.period_idx, COALESCE(SUM(x.amount), 0) AS amount
  FROM (VALUES {secs}) s(section) CROSS JOIN periods pp
  LEFT JOIN ({union}) x ON x.section = s.section AND x.period_idx = pp.period_idx
  GROUP BY s.section, pp.period_idx
)"""


def long_select(src: str, kind_sql: str | None = None, item_null: bool = False) -> str:
    item = "CAST(NULL AS VARCHAR)" if item_null else "item"
    sub = "CAST(NULL AS VARCHAR)" if item_null else "subitem"
    kind = kind_sql or "kind"
    return (f"SELECT section, {item} AS item, {sub} AS subitem, {kind} AS kind, "
            f"CAST(x.period_idx AS INTEGER) AS period_idx, pp.period, CAST(x.amount AS DOUBLE) AS amount "
            f"FROM {src} x JOIN periods pp ON pp.period_idx = x.period_idx")


def pnl_ctes(params: ReportParams) -> str:
    sections = {"COGS": "cogs", "OPEX": "operating_expenses"}
    return ledger_ctes() + "," + periods_values(params) + "," + revenue_ctes(params) + "," + \
        breakdown_ctes(params, "amount", sections) + "," + \
        totals_cte(["revenue", "cogs", "operating_expenses"], ["rev_lines", "exp_long"]) + """,
wide AS (
  SELECT period_idx,
         SUM(CASE WHEN section = 'revenue' THEN amount END) AS rev,
         SUM(CASE WHEN section = 'cogs' THEN amount END) AS cogs,
         SUM(CASE WHEN section = 'operating_expenses' THEN amount END) AS opex
  FROM totals GROUP BY period_idx
),
m1 AS (SELECT period_idx, rev - cogs AS gross_profit, rev - cogs - opex AS ebit FROM wide),
m2 AS (SELECT *, GREATEST(CAST(0 AS DECIMAL(3,2)), ebit * CAST(0.15 AS DECIMAL(3,2))) AS income_tax FROM m1),
metrics AS (
  SELECT 'gross_profit' AS section, period_idx, CAST(gross_profit AS DOUBLE) AS amount FROM m2
  UNION ALL SELECT 'ebit', period_idx, CAST(ebit AS DOUBLE) FROM m2
  UNION ALL SELECT 'income_tax', period_idx, CAST(income_tax AS DOUBLE) FROM m2
  UNION ALL SELECT 'net_earnings', period_idx, CAST(ebit - income_tax AS DOUBLE) FROM m2
)
"""


PNL_PART_SELECTS = {
    "revenue": lambda: long_select("rev_lines"),
    "expenses": lambda: long_select("exp_lines"),
    "totals": lambda: long_select("totals", "'total'", True),
    "metrics": lambda: long_select("metrics", "'metric'", True),
}


def pnl_sql(params: ReportParams, parts: tuple[str, ...] = ("revenue", "expenses", "totals", "metrics"),
            where: str | None = None) -> str:
    body = "\nUNION ALL ".join(PNL_PART_SELECTS[p]() for p in parts)
    if where:
        body = f"SELECT * FROM ({body}) q WHERE {where}"
    return pnl_ctes(params) + body


def cashflow_ctes(params: ReportParams, opening: str) -> str:
    sections = {"COGS": "cogs", "OPEX": "opex", "CAPEX": "capex"}
    return ledger_ctes() + "," + periods_values(params) + f""",
sales_sums AS (
  SELECT {idx_sql(params)} AS period_idx, SUM(grand_total) AS amount
  FROM income WHERE {range_where(params)} GROUP BY 1
),
sales AS (
  SELECT 'sales_income' AS section, pp.period_idx, COALESCE(s.amount, 0) AS amount
  FROM periods pp LEFT JOIN sales_sums s ON s.period_idx = pp.period_idx
),""" + breakdown_ctes(params, "grand_total", sections) + "," + \
        totals_cte(["sales_income", "cogs", "opex", "capex"], ["sales", "exp_long"]) + f""",
wide AS (
  SELECT period_idx,
         SUM(CASE WHEN section = 'sales_income' THEN amount END) AS sales_income,
         SUM(CASE WHEN section = 'cogs' THEN amount END) AS cogs,
         SUM(CASE WHEN section = 'opex' THEN amount END) AS opex,
         SUM(CASE WHEN section = 'capex' THEN amount END) AS capex
  FROM totals GROUP BY period_idx
),
w2 AS (
  SELECT *, CAST(0 AS DECIMAL(12,2)) AS fundings, CAST(0 AS DECIMAL(12,2)) AS other_income,
         sales_income AS total_inflows, cogs + opex + capex AS total_outflows,
         sales_income - (cogs + opex + capex) AS net_cashflow
  FROM wide
),
w3 AS (
  SELECT *, CAST({opening} AS DECIMAL(24,2))
            + SUM(net_cashflow) OVER (ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS closing_balance
  FROM w2
),
metrics AS (
  SELECT 'fundings' AS section, period_idx, CAST(fundings AS DOUBLE) AS amount FROM w3
  UNION ALL SELECT 'other_income', period_idx, CAST(other_income AS DOUBLE) FROM w3
  UNION ALL SELECT 'total_inflows', period_idx, CAST(total_inflows AS DOUBLE) FROM w3
  UNION ALL SELECT 'total_outflows', period_idx, CAST(total_outflows AS DOUBLE) FROM w3
  UNION ALL SELECT 'net_cashflow', period_idx, CAST(net_cashflow AS DOUBLE) FROM w3
  UNION ALL SELECT 'opening_balance', period_idx, CAST(closing_balance - net_cashflow AS DOUBLE) FROM w3
  UNION ALL SELECT 'closing_balance', period_idx, CAST(closing_balance AS DOUBLE) FROM w3
)"""


def cashflow_sql(params: ReportParams, opening: str = "0",
                 parts: tuple[str, ...] = ("lines", "totals", "metrics"), where: str | None = None) -> str:
    sel = {"lines": lambda: long_select("exp_lines"),
           "totals": lambda: long_select("totals", "'total'", True),
           "metrics": lambda: long_select("metrics", "'metric'", True)}
    body = "\nUNION ALL ".join(sel[p]() for p in parts)
    if where:
        body = f"SELECT * FROM ({body}) q WHERE {where}"
    return cashflow_ctes(params, opening) + "\n" + body


def ledger_sql(select: str) -> str:
    """Any select over the derived ``income`` / ``expenses`` / ``dim``."""
    return ledger_ctes() + "\n" + select


# ---------------------------------------------------------------------------
# Raw batches, cleaning and sync
# ---------------------------------------------------------------------------

def _fmt(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def _date_text(x: str) -> str:
    return (f"CASE _key % 6 WHEN 0 THEN strftime({x}, '%d/%m/%Y') WHEN 1 THEN strftime({x}, '%-d-%-m-%Y') "
            f"WHEN 2 THEN strftime({x}, '%d.%m.%Y') WHEN 3 THEN strftime({x}, '%Y-%m-%d') "
            f"WHEN 4 THEN strftime({x}, '%d/%m/%Y') || ' 10:05' ELSE ' ' || strftime({x}, '%-d %b %Y') || ' ' END")


_ROW_ID_TEXT = ("CASE WHEN _key % 97 = 0 THEN '' WHEN _key % 23 = 0 THEN '  ' || row_id || chr(9) ELSE row_id END")
_LOCATION_TEXT = "CASE WHEN _key % 31 = 0 THEN lower(r_name) || '-2a o''neil' ELSE r_name END"


def raw_ctes(dirty: bool = False) -> str:
    """raw_income, raw_expenses (text), inc_snap, exp_snap (typed priors)."""
    status_e = "CASE WHEN _key % 3 = 0 THEN upper(status) ELSE status END"
    type_e = "type"
    loc_e = _LOCATION_TEXT
    amt_e = f"CASE WHEN _key % 47 = 0 THEN {_fmt('amount')} || '04' ELSE {_fmt('amount')} END"
    amt_i, pos_e, broken = amt_e, "CASE WHEN _key % 59 = 0 THEN _key * 1000 ELSE _pos END", "false"
    vat_t = f"CASE WHEN _key % 13 = 0 THEN '' WHEN _key % 29 = 0 THEN 'n/a' ELSE {_fmt('vat')} END"
    gt_t = f"CASE WHEN _key % 17 = 0 THEN '' WHEN _key % 37 = 0 THEN 'see note' ELSE {_fmt('grand_total')} END"
    if dirty:
        status_e = f"CASE WHEN _key % 101 = 0 THEN 'bogus' ELSE {status_e} END"
        type_e = "CASE WHEN _key % 103 = 0 THEN lower(type) ELSE type END"
        loc_e = f"CASE WHEN _key % 107 = 0 THEN NULL ELSE {loc_e} END"
        amt_e = (f"CASE WHEN _key % 109 = 0 THEN '12,345,678,901.00' WHEN _key % 127 = 0 THEN '12345678901234567890.00' "
                 f"WHEN _key % 131 = 0 THEN repeat('9', 40) ELSE {amt_e} END")
        pos_e, broken = f"CASE WHEN _key % 113 <> 0 THEN {pos_e} END", "_key % 137 = 0"
    return f""",
raw_income AS (
  SELECT _key AS _pos,
         {_ROW_ID_TEXT} AS row_id,
         CASE WHEN _key % 11 = 0 THEN NULL ELSE doc_no END AS doc_no,
         {_date_text('doc_date')} AS doc_date, customer, currency,
         {amt_i} AS amount, {vat_t} AS vat, {gt_t} AS grand_total,
         CASE WHEN _key % 3 = 0 THEN lower(status) ELSE status END AS status,
         {_LOCATION_TEXT} AS location, false AS _broken
  FROM income_full
),
expense_pos AS (
  SELECT *, _key * 1000 + ROW_NUMBER() OVER (PARTITION BY _key ORDER BY l_linenumber, l_shipdate, l_partkey,
                                             l_suppkey, l_extendedprice, l_quantity) AS _pos
  FROM expense_lines
),
raw_expenses_text AS (
  SELECT {pos_e} AS _pos, {_ROW_ID_TEXT} AS row_id,
         CASE WHEN _key % 11 = 0 THEN NULL ELSE doc_no END AS doc_no,
         CASE WHEN _key % 19 = 0 THEN '' WHEN _key % 41 = 0 THEN '31/02/1997' ELSE {_date_text('doc_date')} END AS doc_date,
         {_date_text('overdue_date')} AS overdue_date, supplier, currency,
         {amt_e} AS amount, {vat_t} AS vat, {gt_t} AS grand_total,
         {status_e} AS status, {type_e} AS type, {loc_e} AS location,
         CASE WHEN _key % 43 = 0 THEN '' WHEN _key % 53 = 0 THEN ' ' || category || ' ' ELSE category END AS category,
         CASE WHEN p_size % 7 = 0 THEN ' NaN ' ELSE subcategory END AS subcategory,
         {broken} AS _broken
  FROM expense_pos
),
raw_expenses AS (
  SELECT {', '.join(f"CASE WHEN NOT _broken THEN {c} END AS {c}" for c in ("_pos", *S.EXPENSE_RAW_COLUMNS))}, _broken
  FROM raw_expenses_text
),
inc_snap AS (
  SELECT row_id, doc_no, doc_date, customer, currency,
         CASE WHEN CAST(row_id AS BIGINT) % 7 = 0 THEN {_money('amount + 1')} ELSE amount END AS amount,
         vat, grand_total, status, location, created_at, updated_at, created_by, notes
  FROM income WHERE CAST(row_id AS BIGINT) % 5 <> 0
),
exp_last AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY _pos DESC) AS _rn FROM expense_pos)
  WHERE _rn = 1
),
exp_snap AS (
  SELECT row_id, doc_no, doc_date, overdue_date, supplier, currency,
         CASE WHEN _key % 7 = 0 THEN {_money('amount + 1')} ELSE amount END AS amount,
         vat, grand_total, status, type, location, category_key,
         CAST(NULL AS VARCHAR) AS subcategory_free, is_recurring, recurrence_period,
         CAST(NULL AS DATE) AS forecasted_until,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS created_at,
         CAST('{FX.SNAPSHOT_CREATED}' AS TIMESTAMP) AS updated_at,
         CAST(NULL AS VARCHAR) AS created_by, CAST(NULL AS VARCHAR) AS notes
  FROM exp_last WHERE _key % 5 <> 0
)"""


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {strip_sql(x)} = '')"


def _parse_money(x: str) -> str:
    bare = f"replace({x}, ',', '')"
    return (f"CASE WHEN TRY_CAST({bare} AS DECIMAL(38,2)) IS NULL "
            f"AND regexp_full_match({bare}, '[+-]?[0-9]+([.][0-9]*)?') THEN CAST(1e20 AS DECIMAL(38,2)) "
            f"ELSE TRY_CAST({bare} AS DECIMAL(38,2)) END")


def _parse_date(x: str) -> str:
    day = f"regexp_replace(trim({x}), ' [0-9]+:[0-9]+$', '')"
    forms = ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d", "%d %b %Y")
    return "CAST(COALESCE(" + ", ".join(f"try_strptime({day}, '{f}')" for f in forms) + ") AS DATE)"


def _status(x: str) -> str:
    return ("CASE upper(" + x + ") WHEN 'PAID' THEN 'Paid' WHEN 'PENDING' THEN 'Pending' "
            "WHEN 'OVERDUE' THEN 'Overdue' WHEN 'CANCELLED' THEN 'Cancelled' END")


def _fits(x: str) -> str:
    return f"({x} IS NULL OR abs({x}) < 10000000000)"


def _digest(columns: tuple[str, ...]) -> str:
    """Order of rows that share a position: the first 60 bits of the MD5 of their cells."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns)
    return f"substr(md5(concat_ws(chr(31), {cells})), 1, 15)"


def clean_ctes(recurring: tuple[str, ...] = FX.TEST_RECURRING, as_of_date: str = FX.SYNC_AS_OF_DATE,
               income_cols: tuple[str, ...] = ("customer", "currency", "location")) -> str:
    rec = ", ".join(f"'{r}'" for r in recurring)
    money_checks = lambda: ", ".join(
        f"CASE WHEN NOT {_fits('_' + c)} THEN '{c}_out_of_range' END" for c in ("amount", "vat", "grand_total"))
    cust = "customer" if "customer" in income_cols else "'Unknown'"
    cur = "currency" if "currency" in income_cols else "'THB'"
    loc = "location" if "location" in income_cols else "'Unknown'"
    sub = strip_sql("subcategory")
    inc = ("doc_no", "doc_date", "customer", "currency", "amount", "vat", "grand_total", "status", "location")
    exp = ("doc_no", "doc_date", "overdue_date", "supplier", "currency", "amount", "vat", "grand_total", "status", "type",
           "location", "category", "subcategory", "category_key", "is_recurring", "recurrence_period")
    return f""",
inc_c0 AS (
  SELECT _pos, {strip_sql('row_id')} AS row_id,
         CASE WHEN {_blank('doc_no')} THEN 'AUTO-' || {strip_sql('row_id')} ELSE doc_no END AS doc_no,
         {_parse_date('doc_date')} AS doc_date, {cust} AS customer, {cur} AS currency,
         COALESCE({_parse_money('amount')}, 0) AS _amount, COALESCE({_parse_money('vat')}, 0) AS _vat,
         {_parse_money('grand_total')} AS _gt,
         {_status('status')} AS status, {title_sql(loc)} AS location, _broken
  FROM raw_income WHERE _broken OR NOT {_blank('row_id')}
),
inc_c1 AS (SELECT *, COALESCE(_gt, _amount + _vat) AS _grand_total FROM inc_c0),
inc_clean AS (
  SELECT _pos, row_id, doc_no, doc_date, customer, currency,
         CASE WHEN {_fits('_amount')} THEN CAST(_amount AS DECIMAL(12,2)) END AS amount,
         CASE WHEN {_fits('_vat')} THEN CAST(_vat AS DECIMAL(12,2)) END AS vat,
         CASE WHEN {_fits('_grand_total')} THEN CAST(_grand_total AS DECIMAL(12,2)) END AS grand_total,
         status, location,
         CASE WHEN _broken THEN 'malformed_row' ELSE concat_ws(',', CASE WHEN _pos IS NULL THEN 'pos_missing' END,
                   CASE WHEN status IS NULL THEN 'status_unknown' END,
                   CASE WHEN location IS NULL THEN 'location_missing' END,
                   CASE WHEN customer IS NULL THEN 'customer_missing' END,
                   CASE WHEN currency IS NULL THEN 'currency_missing' END,
                   CASE WHEN doc_date IS NULL THEN 'doc_date_missing' END,
                   {money_checks()}) END AS reasons
  FROM inc_c1
),
exp_c0 AS (
  SELECT _pos, {strip_sql('row_id')} AS row_id,
         CASE WHEN {_blank('doc_no')} THEN 'AUTO-' || {strip_sql('row_id')} ELSE doc_no END AS doc_no,
         COALESCE({_parse_date('doc_date')}, DATE '{as_of_date}') AS doc_date,
         {_parse_date('overdue_date')} AS overdue_date, supplier, currency,
         COALESCE({_parse_money('amount')}, 0) AS _amount, COALESCE({_parse_money('vat')}, 0) AS _vat,
         {_parse_money('grand_total')} AS _gt,
         {_status('status')} AS status,
         CASE WHEN type IN ('CAPEX', 'OPEX', 'COGS') THEN type END AS type,
         {title_sql('location')} AS location,
         CASE WHEN category IS NULL OR category = '' THEN 'Uncategorized' ELSE {strip_sql('category')} END AS category,
         CASE WHEN subcategory IS NULL OR {sub} = '' OR lower({sub}) = 'nan' THEN NULL ELSE {sub} END AS subcategory,
         COALESCE({strip_sql('category')} IN ({rec}), false) AS is_recurring, _broken
  FROM raw_expenses WHERE _broken OR NOT {_blank('row_id')}
),
exp_c1 AS (
  SELECT *, COALESCE(_gt, _amount + _vat) AS _grand_total, concat_ws({SEP}, category, subcategory) AS category_key,
         CASE WHEN is_recurring THEN 'monthly' END AS recurrence_period
  FROM exp_c0
),
exp_clean AS (
  SELECT _pos, row_id, doc_no, doc_date, overdue_date, supplier, currency,
         CASE WHEN {_fits('_amount')} THEN CAST(_amount AS DECIMAL(12,2)) END AS amount,
         CASE WHEN {_fits('_vat')} THEN CAST(_vat AS DECIMAL(12,2)) END AS vat,
         CASE WHEN {_fits('_grand_total')} THEN CAST(_grand_total AS DECIMAL(12,2)) END AS grand_total,
         status, type, location, category, subcategory, category_key, is_recurring, recurrence_period,
         CASE WHEN _broken THEN 'malformed_row' ELSE concat_ws(',', CASE WHEN _pos IS NULL THEN 'pos_missing' END,
                   CASE WHEN status IS NULL THEN 'status_unknown' END,
                   CASE WHEN type IS NULL THEN 'type_unknown' END,
                   CASE WHEN location IS NULL THEN 'location_missing' END,
                   CASE WHEN supplier IS NULL THEN 'supplier_missing' END,
                   CASE WHEN currency IS NULL THEN 'currency_missing' END,
                   {money_checks()}) END AS reasons
  FROM exp_c1
),
inc_dedup AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY _pos DESC NULLS LAST, {_digest(inc)} DESC) AS _rn,
           COUNT(*) OVER (PARTITION BY row_id) AS _repeats FROM inc_clean WHERE row_id IS NOT NULL) WHERE _rn = 1
),
exp_dedup AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY _pos DESC NULLS LAST, {_digest(exp)} DESC) AS _rn,
           COUNT(*) OVER (PARTITION BY row_id) AS _repeats FROM exp_clean WHERE row_id IS NOT NULL) WHERE _rn = 1
)"""


def _changed(fields: tuple[str, ...]) -> str:
    parts = []
    for c in fields:
        if c in ("amount", "vat", "grand_total"):
            parts.append(f"(CASE WHEN s.{c} IS NULL OR b.{c} IS NULL THEN s.{c} IS DISTINCT FROM b.{c} "
                         f"ELSE abs(s.{c} - b.{c}) > 0.001 END)")
        else:
            parts.append(f"(s.{c} IS DISTINCT FROM b.{c})")
    return " OR ".join(parts)


def merge_cte(name: str, snap: str, batch: str, schema_cols: list[str], batch_cols: set[str],
              compare: tuple[str, ...], as_of: str) -> str:
    take_b = "m.action IN ('insert', 'update')"
    sel = []
    for c in schema_cols:
        if c == "row_id":
            sel.append("m.row_id")
        elif c == "created_at":
            sel.append(f"CASE WHEN m.action = 'insert' THEN TIMESTAMP '{as_of}' ELSE m.s_created_at END AS created_at")
        elif c == "updated_at":
            sel.append(f"CASE WHEN {take_b} THEN TIMESTAMP '{as_of}' ELSE m.s_updated_at END AS updated_at")
        elif c in batch_cols:
            sel.append(f"CASE WHEN {take_b} THEN m.b_{c} ELSE m.s_{c} END AS {c}")
        else:
            sel.append(f"CASE WHEN m.action = 'insert' THEN NULL ELSE m.s_{c} END AS {c}")
    s_cols = ", ".join(f"s.{c} AS s_{c}" for c in schema_cols if c != "row_id")
    b_cols = ", ".join(f"b.{c} AS b_{c}" for c in schema_cols if c in batch_cols and c != "row_id")
    return f""",
{name}_j AS (
  SELECT COALESCE(s.row_id, b.row_id) AS row_id,
         CASE WHEN b.row_id IS NULL THEN 'retain' WHEN s.row_id IS NULL THEN 'insert'
              WHEN {_changed(compare)} THEN 'update' ELSE 'skip' END AS action,
         {s_cols}, {b_cols}
  FROM {snap} s FULL OUTER JOIN {batch} b ON s.row_id = b.row_id
),
{name} AS (SELECT {", ".join(sel)}, m.action FROM {name}_j m)"""


def sync_ctes(as_of: str = FX.SYNC_AS_OF, dirty: bool = False) -> str:
    from .. import schemas as S
    inc_cols = S.column_names(S.INCOME_SCHEMA)
    exp_cols = S.column_names(S.EXPENSE_SCHEMA)
    inc_batch = {"row_id", "doc_no", "doc_date", "customer", "currency", "amount", "vat", "grand_total",
                 "status", "location"}
    exp_batch = {"row_id", "doc_no", "doc_date", "overdue_date", "supplier", "currency", "amount", "vat",
                 "grand_total", "status", "type", "location", "category_key", "is_recurring", "recurrence_period"}
    return ledger_ctes() + raw_ctes(dirty) + clean_ctes() + \
        merge_cte("inc_merged", "inc_snap", "inc_dedup", inc_cols, inc_batch, S.INCOME_COMPARE, as_of) + \
        merge_cte("exp_merged", "exp_snap", "exp_dedup", exp_cols, exp_batch, S.EXPENSE_COMPARE, as_of)


# ---------------------------------------------------------------------------
# Statements
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Expected fixed rows: (section, kind, section number, block, label, total, final, subitem, header).
_PNL_ROWS = """VALUES
  ('revenue', 'total', 1, 9, 'Total Revenue', true, false, false, false),
  ('cogs', 'total', 2, 9, 'Total COGS', true, false, false, false),
  ('gross_profit', 'metric', 3, 0, 'GROSS PROFIT', true, false, false, false),
  ('operating_expenses', 'total', 4, 9, 'Total OPEX', true, false, false, false),
  ('ebit', 'metric', 5, 0, 'EBIT', true, false, false, false),
  ('income_tax', 'metric', 5, 1, 'Income Tax (15%)', false, false, true, false),
  ('net_earnings', 'metric', 5, 2, 'NET EARNINGS', true, true, false, false)"""
_CF_ROWS = """VALUES
  ('opening_balance', 'metric', 0, 0, 'OPENING BALANCE', false, false, false, true),
  ('sales_income', 'total', 1, 1, '  Sales Income', false, false, true, false),
  ('fundings', 'metric', 1, 2, '  Fundings', false, false, true, false),
  ('other_income', 'metric', 1, 3, '  Other Income', false, false, true, false),
  ('total_inflows', 'metric', 1, 9, 'Total Inflows', true, false, false, false),
  ('cogs', 'total', 2, 9, '  Total COGS', false, false, true, false),
  ('opex', 'total', 3, 9, '  Total OPEX', false, false, true, false),
  ('capex', 'total', 4, 9, '  Total CAPEX', false, false, true, false),
  ('total_outflows', 'metric', 5, 0, 'Total Outflows', true, false, false, false),
  ('net_cashflow', 'metric', 6, 0, 'NET CASHFLOW', true, false, false, false),
  ('closing_balance', 'metric', 6, 1, 'CLOSING BALANCE', true, true, false, false)"""
# Expected headings: (section number, block, label, header, subheader).
_PNL_HEADS = """VALUES
  (1, 0, 'REVENUE', true, false),
  (2, 0, 'COST OF GOODS SOLD', true, false),
  (4, 0, 'OPERATING EXPENSES', true, false)"""
_CF_HEADS = """VALUES
  (1, 0, 'CASH INFLOWS', true, false),
  (2, -1, 'CASH OUTFLOWS', true, false),
  (2, 0, '  Cost of Goods Sold', false, true),
  (3, 0, '  Operating Expenses', false, true),
  (4, 0, '  Capital Expenses', false, true)"""
_PNL_SECTIONS = "VALUES ('revenue', 1), ('cogs', 2), ('operating_expenses', 4)"
_CF_SECTIONS = "VALUES ('cogs', 2), ('opex', 3), ('capex', 4)"


def statement_sql(report_ctes: str, report_body: str, params: ReportParams, rows: str, heads: str,
                  sections: str, subheaders: bool, as_text: bool = False) -> str:
    periods = params.period_labels()
    piv = ", ".join(f"SUM(CASE WHEN period = {_q(p)} THEN amount END) AS \"{p}\"" for p in periods)
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS \"{p}\"" for p in periods)
    subs = f"""
  UNION ALL
  SELECT DISTINCT section_no, block, group_key, -1, '', '  ' || group_key, false, true, false, false, false, {nulls}
  FROM st_items WHERE group_key IS NOT NULL""" if subheaders else ""
    if as_text:
        vals = ", ".join(f"COALESCE(format('{{:,.2f}}', \"{p}\"), '') AS \"{p}\"" for p in periods)
    else:
        vals = ", ".join(f"\"{p}\"" for p in periods)
    return report_ctes + f""",
rep AS ({report_body}),
st_rows(section, kind, section_no, block, item, is_total, is_final, is_subitem, is_header) AS ({rows}),
st_heads(section_no, block, item, is_header, is_subheader) AS ({heads}),
st_sections(section, section_no) AS ({sections}),
st_fixed AS (
  SELECT f.section_no, f.block, CAST(NULL AS VARCHAR) AS group_key, 0 AS direct_last,
         COALESCE(r.subitem, r.item) AS sort_name, f.item, f.is_header, false AS is_subheader, f.is_subitem,
         f.is_total, f.is_final, {piv}
  FROM rep r JOIN st_rows f ON r.section = f.section AND r.kind = f.kind
  GROUP BY ALL
),
st_items AS (
  SELECT s.section_no, 5 AS block, CASE WHEN r.kind <> 'customer' THEN r.item END AS group_key,
         CASE WHEN r.kind = 'direct' THEN 1 ELSE 0 END AS direct_last, COALESCE(r.subitem, r.item) AS sort_name,
         CASE r.kind WHEN 'customer' THEN '  ' || r.item WHEN 'sub' THEN '    ' || r.subitem ELSE '    Direct' END AS item,
         false AS is_header, false AS is_subheader, true AS is_subitem, false AS is_total, false AS is_final, {piv}
  FROM rep r JOIN st_sections s ON r.section = s.section
  WHERE r.kind IN ('customer', 'sub', 'direct')
  GROUP BY ALL
),
st_all AS (
  SELECT * FROM st_fixed UNION ALL SELECT * FROM st_items{subs}
  UNION ALL
  SELECT section_no, block, NULL, 0, '', item, is_header, is_subheader, false, false, false, {nulls} FROM st_heads
)
SELECT CAST(section_no AS INTEGER) AS section_no, CAST(block AS INTEGER) AS block, group_key,
       CAST(direct_last AS INTEGER) AS direct_last, sort_name, item, is_header, is_subheader, is_subitem, is_total,
       is_final, {vals}
FROM st_all"""


def pnl_statement_sql(params: ReportParams, as_text: bool = False) -> str:
    body = "\nUNION ALL ".join(PNL_PART_SELECTS[p]() for p in ("revenue", "expenses", "totals", "metrics"))
    return statement_sql(pnl_ctes(params).rstrip().rstrip(","), body, params, _PNL_ROWS, _PNL_HEADS,
                         _PNL_SECTIONS, True, as_text)


def cashflow_statement_sql(params: ReportParams, opening: str) -> str:
    body = "\nUNION ALL ".join([long_select("exp_lines"), long_select("totals", "'total'", True),
                                long_select("metrics", "'metric'", True)])
    return statement_sql(cashflow_ctes(params, opening), body, params, _CF_ROWS, _CF_HEADS, _CF_SECTIONS, False)


def pending_cte() -> str:
    price = "CAST(p_retailprice AS DECIMAL(14,2))"
    return f"""WITH pending AS (
  SELECT 'CAPEX-' || CAST(p_partkey AS VARCHAR) AS ref_code, p_name AS description,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'THB' END AS currency,
         CAST(ROUND({price} * p_size, 2) AS DECIMAL(14,2)) AS estimated_cost,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(ROUND({price} * (p_size % 10), 2) AS DECIMAL(14,2)) END
           AS committed_amount,
         CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'High' END AS priority,
         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'Approved' END AS status,
         p_brand AS location
  FROM part
)"""


# ---------------------------------------------------------------------------
# Nested documents
# ---------------------------------------------------------------------------

# Expected places of report lines: (section, kind, path).
_PNL_PLACES = """VALUES
  ('revenue', 'customer', 'revenue.revenue_by_customer'),
  ('revenue', 'total', 'revenue.total_net_revenue'),
  ('cogs', 'category', 'cogs.expenses_by_category'),
  ('cogs', 'total', 'cogs.total'),
  ('gross_profit', 'metric', 'gross_profit'),
  ('operating_expenses', 'category', 'operating_expenses.expenses_by_category'),
  ('operating_expenses', 'total', 'operating_expenses.total'),
  ('ebit', 'metric', 'ebit'),
  ('income_tax', 'metric', 'income_tax'),
  ('net_earnings', 'metric', 'net_earnings')"""
_CF_PLACES = """VALUES
  ('sales_income', 'total', 'cash_inflows.sales_income'),
  ('fundings', 'metric', 'cash_inflows.fundings'),
  ('other_income', 'metric', 'cash_inflows.other_income'),
  ('total_inflows', 'metric', 'cash_inflows.total_inflows'),
  ('cogs', 'category', 'cash_outflows.cogs.expenses_by_category'),
  ('cogs', 'total', 'cash_outflows.cogs.total'),
  ('opex', 'category', 'cash_outflows.opex.expenses_by_category'),
  ('opex', 'total', 'cash_outflows.opex.total'),
  ('capex', 'category', 'cash_outflows.capex.expenses_by_category'),
  ('capex', 'total', 'cash_outflows.capex.total'),
  ('total_outflows', 'metric', 'cash_outflows.total_outflows'),
  ('net_cashflow', 'metric', 'net_cashflow'),
  ('opening_balance', 'metric', 'opening_balance'),
  ('closing_balance', 'metric', 'closing_balance')"""


def _document_sql(report: str, places: str, info: str) -> str:
    return f"""
WITH rep AS ({report}),
places(section, kind, path) AS ({places}),
line AS (
  SELECT section, CASE WHEN kind IN ('sub', 'direct') THEN 'category' ELSE kind END AS part, kind, item, subitem,
         '{{' || string_agg('"' || period || '":' || CAST(CAST(amount AS DECIMAL(24,2)) AS VARCHAR), ',' ORDER BY period_idx)
           || '}}' AS vals
  FROM rep GROUP BY ALL
)
SELECT 'report_info' AS path, CAST(NULL AS VARCHAR) AS key, {_q(info)} AS json
UNION ALL
SELECT p.path, CASE WHEN l.part = 'customer' THEN l.item END, l.vals
FROM line l JOIN places p ON l.section = p.section AND l.part = p.kind WHERE l.part <> 'category'
UNION ALL
SELECT p.path, l.item,
       '{{"subcategories":{{' || coalesce(string_agg('"' || subitem || '":' || vals, ',' ORDER BY subitem)
         FILTER (WHERE l.kind = 'sub'), '') || '}}'
       || coalesce(',"direct":' || max(vals) FILTER (WHERE l.kind = 'direct'), '') || '}}'
FROM line l JOIN places p ON l.section = p.section AND l.part = p.kind WHERE l.part = 'category'
GROUP BY p.path, l.item"""


def pnl_document_sql(params: ReportParams, info: str) -> str:
    return _document_sql(pnl_sql(params), _PNL_PLACES, info)


def cashflow_document_sql(params: ReportParams, opening: str, info: str) -> str:
    return _document_sql(cashflow_sql(params, opening), _CF_PLACES, info)
