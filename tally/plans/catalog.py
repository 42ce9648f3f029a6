"""Registered queries: name → (spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, derives its ledgers from the given
tables with Spark and returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..params import ReportParams
from ..sources import fixtures as FX
from . import oracle as O
from decimal import Decimal

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.breakdown import breakdown, section_totals
from ..operators.filters import EXPENSE_DISPLAY, INCOME_DISPLAY, display, ledger_list, list_total
from ..operators.periods import to_long, zero_rows
from .document import CASHFLOW_PATHS, PNL_PATHS, document
from .cashflow import CF_SECTIONS, cashflow_parts, cashflow_report
from .expense_report import expense_category_mix, expense_trend, expense_trend_wide, expense_type_summary
from .pnl import PNL_SECTIONS, pnl_parts, pnl_report, revenue_lines
from .statement import as_text, cashflow_statement_wide, pnl_statement_wide
from .sync import merged_ledger, publish_batches, sync_frames
from ..operators.pending import pending_defaults, remaining_to_fund
from ..operators.periods import explode_periods, period_label, period_sums, range_filter
from ..session import shared_path
from ..sources.dealt import Dealt
from ..sources.raw import read_raw_ledger, write_raw_lines
from ..sources.snapshot import SnapshotStore
from ..functions import parse_day_first, parse_money, py_title
from ..operators.categories import resolve
from ..operators.clean import batch_columns, clean_expenses, clean_income, gate_row_id, rejects
from ..operators.sync import action_counts, dedupe_batch, net_position

Builder = Callable[[SparkSession, str], DataFrame]

# Report windows (FIXTURES.md §3).
YEAR = ReportParams.of("1996-01-01", "1996-12-31", "yearly")
YEAR_MONTHLY = ReportParams.of("1996-01-01", "1996-12-31", "monthly")
LIMIT_MONTHLY_ASIA = ReportParams.of("1996-01-01", "1997-01-31", "monthly", "Asia")
CROSS_YEAR = ReportParams.of("1996-11-01", "1997-02-28", "monthly")


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = Query(fn, sql)
        return fn
    return deco


def _pnl(params: ReportParams) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        led = FX.ledgers(spark, sf_dir)
        return pnl_report(spark, led.income, led.expenses, led.categories, params)
    return build


register("pnl_yearly", O.pnl_sql(YEAR))(_pnl(YEAR))
register("pnl_monthly", O.pnl_sql(YEAR_MONTHLY))(_pnl(YEAR_MONTHLY))
register("pnl_monthly_location", O.pnl_sql(LIMIT_MONTHLY_ASIA))(_pnl(LIMIT_MONTHLY_ASIA))


def _cashflow(params: ReportParams, opening: str) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        led = FX.ledgers(spark, sf_dir)
        return cashflow_report(spark, led.income, led.expenses, led.categories, params, Decimal(opening))
    return build


register("cashflow_yearly", O.cashflow_sql(YEAR, "10000"))(_cashflow(YEAR, "10000"))
register("cashflow_monthly", O.cashflow_sql(CROSS_YEAR, "100000"))(_cashflow(CROSS_YEAR, "100000"))


# ---------------------------------------------------------------------------
# P&L and cashflow parts
# ---------------------------------------------------------------------------

def _pnl_part(params: ReportParams, part: str, section: str | None = None) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        led = FX.ledgers(spark, sf_dir)
        if part == "revenue":
            return to_long(revenue_lines(led.income, params), params)
        if part == "revenue_total":
            rev = revenue_lines(led.income, params)
            tot = section_totals([rev], zero_rows(spark, ["revenue"], params))
            none = F.lit(None).cast("string")
            return to_long(tot.select("section", none.alias("item"), none.alias("subitem"),
                                      F.lit("total").alias("kind"), "period_idx", "amount"), params)
        if part == "expenses":
            br = breakdown(led.expenses, led.categories, "amount", PNL_SECTIONS, params)
            return to_long(br.lines, params)
        return to_long(pnl_parts(spark, led.income, led.expenses, led.categories, params)[part], params)
    return build


register("pnl_revenue_by_customer", O.pnl_sql(YEAR_MONTHLY, ("revenue",)))(_pnl_part(YEAR_MONTHLY, "revenue"))
register("pnl_total_revenue", O.pnl_sql(YEAR_MONTHLY, ("totals",), "section = 'revenue'"))(
    _pnl_part(YEAR_MONTHLY, "revenue_total"))
register("pnl_expense_breakdown", O.pnl_sql(YEAR_MONTHLY, ("expenses",)))(_pnl_part(YEAR_MONTHLY, "expenses"))
register("pnl_section_totals", O.pnl_sql(YEAR_MONTHLY, ("totals",)))(_pnl_part(YEAR_MONTHLY, "totals"))
register("pnl_metrics", O.pnl_sql(YEAR_MONTHLY, ("metrics",)))(_pnl_part(YEAR_MONTHLY, "metrics"))


def _cf_part(params: ReportParams, opening: str, parts: tuple[str, ...], sections: tuple[str, ...] | None) -> Builder:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        led = FX.ledgers(spark, sf_dir)
        if parts == ("lines",):
            return to_long(breakdown(led.expenses, led.categories, "grand_total", CF_SECTIONS, params).lines, params)
        got = cashflow_parts(spark, led.income, led.expenses, led.categories, params, Decimal(opening))
        out = None
        for p in parts:
            d = to_long(got[p], params)
            out = d if out is None else out.unionByName(d)
        if sections:
            out = out.filter(F.col("section").isin(*sections))
        return out
    return build


def _in(sections: tuple[str, ...]) -> str:
    return "section IN (" + ", ".join(f"'{s}'" for s in sections) + ")"


_INFLOWS = ("sales_income", "fundings", "other_income", "total_inflows")
_OUTFLOWS = ("cogs", "opex", "capex", "total_outflows")
_BALANCES = ("net_cashflow", "opening_balance", "closing_balance")
register("cf_inflows", O.cashflow_sql(YEAR_MONTHLY, "0", ("totals", "metrics"), _in(_INFLOWS)))(
    _cf_part(YEAR_MONTHLY, "0", ("totals", "metrics"), _INFLOWS))
register("cf_outflow_breakdown", O.cashflow_sql(YEAR_MONTHLY, "0", ("lines",)))(
    _cf_part(YEAR_MONTHLY, "0", ("lines",), None))
register("cf_outflow_totals", O.cashflow_sql(YEAR_MONTHLY, "0", ("totals", "metrics"), _in(_OUTFLOWS)))(
    _cf_part(YEAR_MONTHLY, "0", ("totals", "metrics"), _OUTFLOWS))
register("cf_balances_monthly", O.cashflow_sql(CROSS_YEAR, "100000", ("metrics",), _in(_BALANCES)))(
    _cf_part(CROSS_YEAR, "100000", ("metrics",), _BALANCES))
register("cf_balances_yearly", O.cashflow_sql(YEAR, "10000", ("metrics",), _in(_BALANCES)))(
    _cf_part(YEAR, "10000", ("metrics",), _BALANCES))


# ---------------------------------------------------------------------------
# Ledger lists
# ---------------------------------------------------------------------------

PARTIAL = ("1996-03-10", "1996-05-05")
_INCOME_COLS = ", ".join(S.column_names(S.INCOME_SCHEMA))
_EXPENSE_COLS = ", ".join(S.column_names(S.EXPENSE_SCHEMA))


@register("income_list", O.ledger_sql(f"SELECT {_INCOME_COLS} FROM income"))
def _income_list(spark, sf_dir):
    return ledger_list(FX.income_ledger(spark, sf_dir))


@register("expense_list", O.ledger_sql(
    f"SELECT {_EXPENSE_COLS} FROM expenses WHERE doc_date BETWEEN DATE '{PARTIAL[0]}' AND DATE '{PARTIAL[1]}' "
    "AND location = 'Europe'"))
def _expense_list(spark, sf_dir):
    return ledger_list(FX.expense_ledger(spark, sf_dir), *PARTIAL, "Europe")


@register("list_totals", O.ledger_sql(
    f"SELECT 'income' AS ledger, '{PARTIAL[0]}' AS start_date, '{PARTIAL[1]}' AS end_date, "
    "CAST(NULL AS VARCHAR) AS location, COUNT(*) AS total FROM income "
    f"WHERE doc_date BETWEEN DATE '{PARTIAL[0]}' AND DATE '{PARTIAL[1]}' "
    f"UNION ALL SELECT 'expenses', '{PARTIAL[0]}', '{PARTIAL[1]}', 'Europe', COUNT(*) FROM expenses "
    f"WHERE doc_date BETWEEN DATE '{PARTIAL[0]}' AND DATE '{PARTIAL[1]}' AND location = 'Europe'"))
def _list_totals(spark, sf_dir):
    inc = list_total(FX.income_ledger(spark, sf_dir), "income", *PARTIAL, None)
    exp = list_total(FX.expense_ledger(spark, sf_dir), "expenses", *PARTIAL, "Europe")
    return inc.unionByName(exp)


def _display_sql(table: str, cols: tuple[str, ...]) -> str:
    sel = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS {c}" if c in S.MONEY_FIELDS else c for c in cols)
    return O.ledger_sql(f"SELECT {sel} FROM {table}")


@register("income_display", _display_sql("income", INCOME_DISPLAY))
def _income_display(spark, sf_dir):
    return display(ledger_list(FX.income_ledger(spark, sf_dir)), INCOME_DISPLAY)


@register("expense_display", _display_sql("expenses", EXPENSE_DISPLAY))
def _expense_display(spark, sf_dir):
    return display(ledger_list(FX.expense_ledger(spark, sf_dir)), EXPENSE_DISPLAY)


# ---------------------------------------------------------------------------
# Expense report (E1-E5), over the whole expense ledger
# ---------------------------------------------------------------------------

@register("expense_trend", O.ledger_sql(
    "SELECT strftime(doc_date, '%Y-%m') AS month, type, CAST(SUM(grand_total) AS DOUBLE) AS grand_total "
    "FROM expenses GROUP BY 1, 2"))
def _expense_trend(spark, sf_dir):
    return expense_trend(FX.expense_ledger(spark, sf_dir))


@register("expense_trend_wide", O.ledger_sql(
    "SELECT strftime(doc_date, '%Y-%m') AS month, "
    + ", ".join(f"CAST(SUM(CASE WHEN type = '{t}' THEN grand_total END) AS DOUBLE) AS {t}" for t in S.EXPENSE_TYPES)
    + " FROM expenses GROUP BY 1"))
def _expense_trend_wide(spark, sf_dir):
    return expense_trend_wide(FX.expense_ledger(spark, sf_dir))


@register("expense_category_mix", O.ledger_sql("""
, per_key AS (SELECT type, category_key, SUM(grand_total) AS amount FROM expenses GROUP BY 1, 2)
, named AS (
  SELECT k.type, CASE WHEN d.parent_key IS NOT NULL THEN pd.name ELSE d.name END AS category, k.amount
  FROM per_key k JOIN dim d ON k.category_key = d.category_key
  LEFT JOIN dim pd ON d.parent_key = pd.category_key)
, agg AS (SELECT type, category, SUM(amount) AS amount FROM named WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT type, category, CAST(amount AS DOUBLE) AS grand_total,
       ROW_NUMBER() OVER (PARTITION BY type ORDER BY amount DESC, category) AS rank
FROM agg""".replace("\n, per_key", ", per_key", 1)))
def _expense_category_mix(spark, sf_dir):
    led = FX.ledgers(spark, sf_dir)
    return expense_category_mix(led.expenses, led.categories)


@register("expense_type_summary", O.ledger_sql("""
, agg AS (SELECT type, SUM(grand_total) AS amount, COUNT(doc_no) AS count, GROUPING(type) AS g
          FROM expenses GROUP BY ROLLUP (type))
SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE type END AS type,
       CAST(COALESCE(amount, 0) AS DOUBLE) AS total_amount,
       '฿' || format('{:,.2f}', COALESCE(amount, 0)) AS total_amount_text,
       count
FROM agg"""))
def _expense_type_summary(spark, sf_dir):
    return expense_type_summary(FX.expense_ledger(spark, sf_dir))


# ---------------------------------------------------------------------------
# Cleaning (B1-B14), categories (C1-C4) and sync (U1-U6) on the export fixtures
# ---------------------------------------------------------------------------

def _sync(spark: SparkSession, sf_dir: str, dirty: bool = False):
    """Lazy sync frames over the export fixtures."""
    lines = FX.expense_batch_lines(spark, sf_dir)
    return sync_frames(
        FX.raw_income_batch(spark, sf_dir), FX.raw_expense_batch(spark, sf_dir, dirty, lines),
        FX.income_snapshot(spark, sf_dir), FX.expense_snapshot(spark, sf_dir, lines),
        FX.parent_dimension(spark, sf_dir), FX.SYNC_AS_OF, FX.SYNC_AS_OF_DATE, FX.TEST_RECURRING)


def _dealt_expenses(spark: SparkSession, sf_dir: str, dealt: Dealt) -> tuple[DataFrame, DataFrame]:
    """The dealt source of the expense lines, and their cleaned batch dealt by row_id."""
    src = FX.dealt_expense_source(spark, sf_dir, dealt)
    raw = FX.raw_expense_batch(spark, sf_dir, lines=FX.expense_batch_lines(spark, sf_dir, src))
    clean = batch_columns(clean_expenses(raw, FX.SYNC_AS_OF_DATE, FX.TEST_RECURRING))
    return src, dealt.write(clean, "row_id", "expenses")


def _merged_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_sync(...).expenses`` over dealt tables."""
    dealt = Dealt(spark, sf_dir, "lineitem")
    src, clean = _dealt_expenses(spark, sf_dir, dealt)
    snapshot = dealt.write(FX.dealt_expense_snapshot(spark, sf_dir, src), "row_id", "expense-snapshot")
    dealt.drop("source")
    return merged_ledger("expenses", snapshot, clean, FX.SYNC_AS_OF, dealt=True)


def _merged_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_sync(...).income`` over dealt tables."""
    dealt = Dealt(spark, sf_dir, "orders")
    lines = FX.income_lines(spark, sf_dir, dealt)
    clean = dealt.write(batch_columns(clean_income(FX.raw_income_batch(spark, sf_dir, lines))), "row_id", "income")
    snapshot = dealt.write(FX.income_snapshot(spark, sf_dir, lines), "row_id", "income-snapshot")
    dealt.drop("o_custkey", "c_custkey")
    return merged_ledger("income", snapshot, clean, FX.SYNC_AS_OF, dealt=True)


def _sync_sql(select: str, dirty: bool = False) -> str:
    return O.sync_ctes(dirty=dirty) + "\n" + select


def _dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE) AS {c}"


@register("clean_money", _sync_sql("SELECT _pos, " + ", ".join(
    f"CAST({O._parse_money(c)} AS DOUBLE) AS {c}" for c in S.MONEY_FIELDS)
    + " FROM raw_income"))
def _clean_money(spark, sf_dir):
    raw = FX.raw_income_batch(spark, sf_dir)
    return raw.select("_pos", *[parse_money(F.col(c)).cast("double").alias(c) for c in S.MONEY_FIELDS])


@register("clean_dates", _sync_sql(
    "SELECT _pos, " + O._parse_date("doc_date") + " AS doc_date, " + O._parse_date("overdue_date")
    + " AS overdue_date FROM raw_expenses"))
def _clean_dates(spark, sf_dir):
    raw = FX.raw_expense_batch(spark, sf_dir)
    return raw.select("_pos", parse_day_first(F.col("doc_date")).alias("doc_date"),
                      parse_day_first(F.col("overdue_date")).alias("overdue_date"))


@register("row_id_gate", _sync_sql("SELECT _pos, row_id FROM exp_clean"))
def _row_id_gate(spark, sf_dir):
    return gate_row_id(FX.raw_expense_batch(spark, sf_dir)).select("_pos", "row_id")


@register("doc_no_default", _sync_sql("SELECT _pos, row_id, doc_no FROM inc_clean"))
def _doc_no_default(spark, sf_dir):
    return clean_income(FX.raw_income_batch(spark, sf_dir)).select("_pos", "row_id", "doc_no")


@register("money_defaults", _sync_sql(f"SELECT _pos, {_dbl('amount')}, {_dbl('vat')} FROM inc_clean"))
def _money_defaults(spark, sf_dir):
    c = clean_income(FX.raw_income_batch(spark, sf_dir))
    return c.select("_pos", F.col("amount").cast("double").alias("amount"), F.col("vat").cast("double").alias("vat"))


@register("grand_total_fill", _sync_sql(f"SELECT _pos, {_dbl('grand_total')} FROM inc_clean"))
def _grand_total_fill(spark, sf_dir):
    c = clean_income(FX.raw_income_batch(spark, sf_dir))
    return c.select("_pos", F.col("grand_total").cast("double").alias("grand_total"))


@register("status_normalize", _sync_sql("SELECT _pos, status FROM inc_clean"))
def _status_normalize(spark, sf_dir):
    return clean_income(FX.raw_income_batch(spark, sf_dir)).select("_pos", "status")


@register("location_title", _sync_sql(f"SELECT _pos, {O.title_sql('location')} AS location FROM raw_expenses"))
def _location_title(spark, sf_dir):
    return FX.raw_expense_batch(spark, sf_dir).select("_pos", py_title(F.col("location")).alias("location"))


@register("column_defaults", O.ledger_ctes() + O.raw_ctes() + O.clean_ctes(income_cols=())
          + "\nSELECT _pos, customer, currency, location FROM inc_clean")
def _column_defaults(spark, sf_dir):
    raw = FX.raw_income_batch(spark, sf_dir).drop("customer", "currency", "location")
    return clean_income(raw).select("_pos", "customer", "currency", "location")


@register("expense_date_default", _sync_sql("SELECT _pos, doc_date FROM exp_clean"))
def _expense_date_default(spark, sf_dir):
    return _sync(spark, sf_dir).expense_clean.select("_pos", "doc_date")


@register("category_normalize", _sync_sql("SELECT _pos, category, subcategory, category_key FROM exp_clean"))
def _category_normalize(spark, sf_dir):
    return _sync(spark, sf_dir).expense_clean.select("_pos", "category", "subcategory", "category_key")


@register("recurring_flag", _sync_sql("SELECT _pos, is_recurring, recurrence_period FROM exp_clean"))
def _recurring_flag(spark, sf_dir):
    return _sync(spark, sf_dir).expense_clean.select("_pos", "is_recurring", "recurrence_period")


@register("ledger_rejects", _sync_sql(
    "SELECT 'income' AS ledger, _pos, row_id, reasons FROM inc_clean WHERE reasons <> '' "
    "UNION ALL SELECT 'expenses', _pos, row_id, reasons FROM exp_clean WHERE reasons <> ''", dirty=True))
def _ledger_rejects(spark, sf_dir):
    f = _sync(spark, sf_dir, dirty=True)
    return (rejects(f.income_clean).select(F.lit("income").alias("ledger"), "*")
            .unionByName(rejects(f.expense_clean).select(F.lit("expenses").alias("ledger"), "*")))


_PARENTS_SQL = "SELECT DISTINCT p_type AS category_key, p_type AS name, CAST(NULL AS VARCHAR) AS parent_key FROM part"


@register("category_dim", _sync_sql(f"""
, existing AS ({_PARENTS_SQL})
, wanted AS (
  SELECT DISTINCT category AS category_key, category AS name, CAST(NULL AS VARCHAR) AS parent_key FROM exp_clean
  UNION
  SELECT DISTINCT category_key, subcategory AS name, category AS parent_key FROM exp_clean
  WHERE subcategory IS NOT NULL)
SELECT * FROM existing
UNION ALL
SELECT w.* FROM wanted w WHERE w.category_key NOT IN (SELECT category_key FROM existing)""".replace(
    "\n, existing", ", existing", 1)))
def _category_dim(spark, sf_dir):
    return _sync(spark, sf_dir).categories


@register("expense_category_join", O.ledger_sql(
    "SELECT e.row_id, e.category_key, d.name, d.parent_key FROM expenses e JOIN dim d ON e.category_key = d.category_key"))
def _expense_category_join(spark, sf_dir):
    led = FX.ledgers(spark, sf_dir)
    return led.expenses.select("row_id", "category_key").join(led.categories, "category_key", "inner") \
        .select("row_id", "category_key", "name", "parent_key")


@register("category_parent", O.ledger_sql(
    "SELECT d.category_key, d.name, d.parent_key, pd.name AS parent_name, d.parent_key IS NOT NULL AS is_subcategory "
    "FROM dim d LEFT JOIN dim pd ON d.parent_key = pd.category_key"))
def _category_parent(spark, sf_dir):
    led = FX.ledgers(spark, sf_dir)
    return resolve(led.categories.select("category_key"), led.categories).select(
        "category_key", F.col("own_name").alias("name"), "parent_key", "parent_name", "is_subcategory")


@register("batch_dedupe", _sync_sql("SELECT row_id, _pos, _repeats FROM exp_dedup"))
def _batch_dedupe(spark, sf_dir):
    dealt = Dealt(spark, sf_dir, "lineitem")
    _, clean = _dealt_expenses(spark, sf_dir, dealt)
    dealt.drop("source")
    return dedupe_batch(clean, dealt=True).select("row_id", "_pos", "_repeats")


@register("sync_actions", _sync_sql(
    "SELECT 'income' AS ledger, row_id, action FROM inc_merged "
    "UNION ALL SELECT 'expenses', row_id, action FROM exp_merged"))
def _sync_actions(spark, sf_dir):
    income, expenses = _merged_income(spark, sf_dir), _merged_expenses(spark, sf_dir)
    return (income.select(F.lit("income").alias("ledger"), "row_id", "action")
            .unionByName(expenses.select(F.lit("expenses").alias("ledger"), "row_id", "action")))


@register("sync_income", _sync_sql("SELECT * FROM inc_merged"))
def _sync_income(spark, sf_dir):
    return merged_ledger("income", FX.income_snapshot(spark, sf_dir),
                         clean_income(FX.raw_income_batch(spark, sf_dir)), FX.SYNC_AS_OF)


@register("sync_expenses", _sync_sql("SELECT * FROM exp_merged"))
def _sync_expenses(spark, sf_dir):
    return _merged_expenses(spark, sf_dir)


@register("sync_counts", _sync_sql(
    "SELECT 'income' AS ledger, action, COUNT(*) AS count FROM inc_merged GROUP BY action "
    "UNION ALL SELECT 'expenses', action, COUNT(*) FROM exp_merged GROUP BY action"))
def _sync_counts(spark, sf_dir):
    income, expenses = _merged_income(spark, sf_dir), _merged_expenses(spark, sf_dir)
    return action_counts(income, "income").unionByName(action_counts(expenses, "expenses"))


@register("net_position", _sync_sql("""
, t AS (SELECT (SELECT COALESCE(SUM(grand_total), 0) FROM inc_merged) AS ti,
               (SELECT COALESCE(SUM(grand_total), 0) FROM exp_merged) AS te)
SELECT CAST(ti AS DOUBLE) AS total_income, CAST(te AS DOUBLE) AS total_expenses,
       CAST(ti - te AS DOUBLE) AS net_position FROM t""".replace("\n, t AS", ", t AS", 1)))
def _net_position(spark, sf_dir):
    return net_position(_merged_income(spark, sf_dir), _merged_expenses(spark, sf_dir))


# ---------------------------------------------------------------------------
# Statements
# ---------------------------------------------------------------------------

@register("pnl_statement_wide", O.pnl_statement_sql(YEAR_MONTHLY))
def _pnl_statement_wide(spark, sf_dir):
    return pnl_statement_wide(_pnl(YEAR_MONTHLY)(spark, sf_dir), YEAR_MONTHLY)


@register("cashflow_statement_wide", O.cashflow_statement_sql(CROSS_YEAR, "100000"))
def _cashflow_statement_wide(spark, sf_dir):
    return cashflow_statement_wide(_cashflow(CROSS_YEAR, "100000")(spark, sf_dir), CROSS_YEAR)


@register("pnl_statement_text", O.pnl_statement_sql(YEAR, as_text=True))
def _pnl_statement_text(spark, sf_dir):
    return as_text(pnl_statement_wide(_pnl(YEAR)(spark, sf_dir), YEAR), YEAR)


# ---------------------------------------------------------------------------
# Pending investments (I1-I2) and the period spine
# ---------------------------------------------------------------------------

@register("remaining_to_fund", O.pending_cte() + """
SELECT ref_code, CAST(estimated_cost AS DOUBLE) AS estimated_cost,
       CAST(committed_amount AS DOUBLE) AS committed_amount,
       CAST(estimated_cost - COALESCE(committed_amount, 0) AS DOUBLE) AS remaining_to_fund FROM pending""")
def _remaining_to_fund(spark, sf_dir):
    df = remaining_to_fund(FX.pending_investments(spark, sf_dir))
    return df.select("ref_code", F.col("estimated_cost").cast("double").alias("estimated_cost"),
                     F.col("committed_amount").cast("double").alias("committed_amount"), "remaining_to_fund")


@register("pending_defaults", O.pending_cte() + """
SELECT ref_code, COALESCE(currency, 'THB') AS currency,
       CAST(COALESCE(committed_amount, 0) AS DOUBLE) AS committed_amount,
       COALESCE(priority, 'Medium') AS priority, COALESCE(status, 'Planned') AS status FROM pending""")
def _pending_defaults(spark, sf_dir):
    df = pending_defaults(FX.pending_investments(spark, sf_dir))
    return df.select("ref_code", "currency", F.col("committed_amount").cast("double").alias("committed_amount"),
                     "priority", "status")


@register("period_spine", O.ledger_sql("," + O.periods_values(YEAR_MONTHLY) + f"""
SELECT pp.period_idx, pp.period,
       (SELECT COUNT(*) FROM income i WHERE {O.range_where(YEAR_MONTHLY, 'i')}
          AND {O.idx_sql(YEAR_MONTHLY, 'i.doc_date')} = pp.period_idx) AS income_lines,
       (SELECT COUNT(*) FROM expenses e WHERE {O.range_where(YEAR_MONTHLY, 'e')}
          AND {O.idx_sql(YEAR_MONTHLY, 'e.doc_date')} = pp.period_idx) AS expense_lines
FROM periods pp""").replace("WITH \n", "WITH ", 1).replace("\n,periods", ",periods", 1))
def _period_spine(spark, sf_dir):
    """Every period label of the range with its line counts (0 where
    none); one global aggregate per ledger builds the zero-filled arrays."""
    led = FX.ledgers(spark, sf_dir)
    p = YEAR_MONTHLY
    one = F.lit(1).cast(S.MONEY)

    def counts(df, name):
        rows = range_filter(df, p).select("doc_date").withColumn("_one", one)
        return explode_periods(period_sums(rows, [], "_one", p), p, []).select(
            F.col("period_idx").cast("int").alias("period_idx"), period_label(p, F.col("period_idx")).alias("period"),
            F.col("amount").cast("long").alias(name))
    return counts(led.income, "income_lines").join(counts(led.expenses, "expense_lines"), ["period_idx", "period"])


# ---------------------------------------------------------------------------
# Sources and sinks (A1, A4, A5): rows-only checks
# ---------------------------------------------------------------------------

def _export_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "tally-exports", f"{name}-{uuid.uuid4().hex}")


def _cells(columns: tuple[str, ...], broken: str, source: str) -> str:
    return (", ".join(f"CASE WHEN NOT ({broken}) THEN {c} END AS {c.split()[-1]}" for c in columns)
            + f", {broken} AS malformed FROM {source}")


@register("read_raw_ledger", O.ledger_ctes() + O.raw_ctes() + "\nSELECT " + _cells(
    ("_pos", *S.INCOME_RAW_COLUMNS), "_pos % 61 = 0", "(SELECT * REPLACE (coalesce(doc_no, '') AS doc_no) FROM raw_income)"))
def _read_raw_ledger(spark, sf_dir):
    """A1: the income export written as CSV lines to the shared folder and read
    back as text columns (header rows, no inference, blank cells as ''; rows
    with a cell past the header are told, not cut)."""
    path = _export_path(spark, "income")
    header, lines = FX.income_csv_lines(spark, sf_dir)
    write_raw_lines(lines, path, header)
    return _told(read_raw_ledger(spark, path, "csv"))


@register("read_raw_json", O.ledger_ctes() + O.raw_ctes() + "\nSELECT " + _cells(
    ("_pos", *S.EXPENSE_RAW_COLUMNS), "(_pos // 1000) % 67 = 0", "raw_expenses"))
def _read_raw_json(spark, sf_dir):
    """A1: the expense export as JSON lines, some of them cut short."""
    path = _export_path(spark, "expenses")
    dealt = Dealt(spark, sf_dir, "lineitem")
    lines = FX.expense_batch_lines(spark, sf_dir, FX.dealt_expense_source(spark, sf_dir, dealt))
    write_raw_lines(FX.expense_json_lines(spark, sf_dir, lines), path, None, "gzip")
    dealt.drop("source")
    return _told(read_raw_ledger(spark, path, "json", "expenses"))


def _told(raw: DataFrame) -> DataFrame:
    return raw.withColumn("malformed", F.col(S.CORRUPT).isNotNull()).drop(S.CORRUPT)


@register("sync_snapshot", _sync_sql("SELECT * EXCLUDE (action), CAST(date_trunc('month', doc_date) AS DATE) AS doc_month "
                                     "FROM exp_merged"))
def _sync_snapshot(spark, sf_dir):
    """A4: publish the prior snapshots, sync the raw batches into them (one
    pointer file, only touched months rewritten) and return the published
    expense snapshot."""
    store = SnapshotStore(spark, shared_path(spark, "tally-store", uuid.uuid4().hex))
    dealt = Dealt(spark, sf_dir, "lineitem")
    src, income = FX.dealt_expense_source(spark, sf_dir, dealt), FX.income_lines(spark, sf_dir, dealt)
    lines = FX.expense_batch_lines(spark, sf_dir, src)
    store.commit({"income": store.write_ledger("income", FX.income_snapshot(spark, sf_dir, income), gather=False),
                  "expenses": store.write_ledger("expenses", FX.dealt_expense_snapshot(spark, sf_dir, src), gather=False),
                  "categories": store.write("categories", FX.parent_dimension(spark, sf_dir))})
    publish_batches(store, {"income": FX.raw_income_batch(spark, sf_dir, income),
                            "expenses": FX.raw_expense_batch(spark, sf_dir, lines=lines)},
                    FX.SYNC_AS_OF, FX.SYNC_AS_OF_DATE, FX.TEST_RECURRING, dealt,
                    raw_is_read=lambda: dealt.drop("source", "o_custkey", "c_custkey"))
    return store.read("expenses")


_MONTHS_1996 = ('"jan-96","feb-96","mar-96","apr-96","may-96","jun-96","jul-96","aug-96","sep-96","oct-96","nov-96",'
                '"dec-96"')


@register("pnl_nested_json", O.pnl_document_sql(
    YEAR_MONTHLY, '{"start_date":"1996-01-01","end_date":"1996-12-31","format":"monthly","location":"All","periods":['
    + _MONTHS_1996 + "]}"))
def _pnl_nested_json(spark, sf_dir):
    """A5: the report as a nested document, one member per row."""
    return document(_pnl(YEAR_MONTHLY)(spark, sf_dir), YEAR_MONTHLY, PNL_PATHS)


@register("cashflow_nested_json", O.cashflow_document_sql(
    CROSS_YEAR, "100000", '{"start_date":"1996-11-01","end_date":"1997-02-28","format":"monthly","location":"All",'
    '"periods":["nov-96","dec-96","jan-97","feb-97"]}'))
def _cashflow_nested_json(spark, sf_dir):
    return document(_cashflow(CROSS_YEAR, "100000")(spark, sf_dir), CROSS_YEAR, CASHFLOW_PATHS)


# ---------------------------------------------------------------------------
# More report windows (FIXTURES.md §3): partial months, a year end, no data
# ---------------------------------------------------------------------------

PARTIAL_MONTHLY = ReportParams.of(PARTIAL[0], PARTIAL[1], "monthly")
CROSS_YEAR_PNL = ReportParams.of("1996-11-01", "1997-02-28", "monthly", "Europe")
BEFORE_DATA = ReportParams.of("1990-01-01", "1990-03-31", "monthly")

register("pnl_partial_window", O.pnl_sql(PARTIAL_MONTHLY))(_pnl(PARTIAL_MONTHLY))
register("pnl_cross_year_location", O.pnl_sql(CROSS_YEAR_PNL))(_pnl(CROSS_YEAR_PNL))
register("cashflow_before_data", O.cashflow_sql(BEFORE_DATA, "5000"))(_cashflow(BEFORE_DATA, "5000"))
