"""Worked examples, invariants and plan checks for the reports."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tally import schemas as S
from tally.params import ReportParams
from tally.plans.cashflow import cashflow_report
from tally.plans.pnl import pnl_report
from tally.plans.statement import pnl_statement_wide, statement_order

SEP = S.CATEGORY_KEY_SEP


def ledgers(spark, income_rows, expense_rows):
    inc = spark.createDataFrame(income_rows, "customer string, doc_date date, amount decimal(12,2), "
                                             "grand_total decimal(12,2), location string")
    exp = spark.createDataFrame(expense_rows, "doc_date date, amount decimal(12,2), grand_total decimal(12,2), "
                                              "type string, location string, category_key string")
    dim = spark.createDataFrame([("Cost", "Cost", None), ("Cost" + SEP + "Parts", "Parts", "Cost"),
                                 ("Office", "Office", None), ("Machines", "Machines", None)],
                                "category_key string, name string, parent_key string")
    return inc, exp, dim


def values(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v) if v is not None else df.filter(F.col(k).isNull())
    return sorted(r["amount"] for r in df.collect())


def test_pnl_worked_example(spark):
    import datetime as dt
    d = dt.date(2024, 3, 1)
    inc, exp, dim = ledgers(spark, [("A", d, Decimal(100000), Decimal(107000), "Bkk"),
                                    ("B", d, Decimal(50000), Decimal(53500), "Bkk")],
                            [(d, Decimal(30000), Decimal(32100), "COGS", "Bkk", "Cost" + SEP + "Parts"),
                             (d, Decimal(50000), Decimal(53500), "OPEX", "Bkk", "Office"),
                             (d, Decimal(20000), Decimal(21400), "CAPEX", "Bkk", "Machines")])
    p = ReportParams.of("2024-01-01", "2024-12-31", "yearly")
    rep = pnl_report(spark, inc, exp, dim, p)
    got = {r["section"]: r["amount"] for r in rep.filter("kind = 'metric'").collect()}
    assert got == {"gross_profit": 120000.0, "ebit": 70000.0, "income_tax": 10500.0, "net_earnings": 59500.0}
    assert values(rep, section="revenue", kind="total") == [150000.0]
    assert values(rep, section="cogs", kind="sub") == [30000.0]
    assert values(rep, section="operating_expenses", kind="direct") == [50000.0]
    assert rep.filter("section = 'capex'").count() == 0   # CAPEX left out of P&L


def test_pnl_loss_has_no_tax(spark):
    import datetime as dt
    d = dt.date(2024, 3, 1)
    inc, exp, dim = ledgers(spark, [("A", d, Decimal(0), Decimal(0), "Bkk")],
                            [(d, Decimal(100), Decimal(107), "OPEX", "Bkk", "Office")])
    rep = pnl_report(spark, inc, exp, dim, ReportParams.of("2024-01-01", "2024-12-31", "yearly"))
    got = {r["section"]: r["amount"] for r in rep.filter("kind = 'metric'").collect()}
    assert got["ebit"] == -100.0 and got["income_tax"] == 0.0 and got["net_earnings"] == -100.0


def test_cashflow_worked_example_and_chain(spark):
    import datetime as dt
    d1, d2 = dt.date(2024, 3, 1), dt.date(2024, 5, 2)
    inc, exp, dim = ledgers(spark, [("A", d1, Decimal(0), Decimal(150000), "Bkk")],
                            [(d1, Decimal(0), Decimal(30000), "COGS", "Bkk", "Cost"),
                             (d1, Decimal(0), Decimal(50000), "OPEX", "Bkk", "Office"),
                             (d2, Decimal(0), Decimal(20000), "CAPEX", "Bkk", "Machines")])
    yearly = cashflow_report(spark, inc, exp, dim, ReportParams.of("2024-01-01", "2024-12-31", "yearly"),
                             Decimal(10000))
    got = {r["section"]: r["amount"] for r in yearly.filter("kind = 'metric'").collect()}
    assert got["total_outflows"] == 100000.0 and got["net_cashflow"] == 50000.0
    assert got["opening_balance"] == 10000.0 and got["closing_balance"] == 60000.0
    monthly = cashflow_report(spark, inc, exp, dim, ReportParams.of("2024-01-15", "2024-06-30", "monthly"),
                              Decimal(10000))
    rows = {(r["section"], r["period_idx"]): r["amount"] for r in monthly.filter("kind = 'metric'").collect()}
    n = 6
    assert rows[("opening_balance", 0)] == 10000.0
    for i in range(n):
        assert rows[("closing_balance", i)] == pytest.approx(rows[("opening_balance", i)] + rows[("net_cashflow", i)])
        if i:
            assert rows[("opening_balance", i)] == rows[("closing_balance", i - 1)]
    assert rows[("closing_balance", n - 1)] == 60000.0


def test_empty_range_is_all_zero(spark):
    from tally.sources import fixtures as FX
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    p = ReportParams.of("1990-01-01", "1990-03-31", "monthly")
    rep = pnl_report(spark, led.income, led.expenses, led.categories, p)
    assert rep.filter("kind in ('customer', 'sub', 'direct')").count() == 0
    assert rep.filter("amount != 0").count() == 0
    assert rep.filter("kind = 'total'").count() == 3 * 3


def test_lines_foot_to_totals_and_months_sum_to_year(spark):
    from tally.sources import fixtures as FX
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    m = pnl_report(spark, led.income, led.expenses, led.categories, ReportParams.of("1996-01-01", "1996-12-31", "monthly"))
    y = pnl_report(spark, led.income, led.expenses, led.categories, ReportParams.of("1996-01-01", "1996-12-31", "yearly"))
    lines = m.filter("kind != 'total' and kind != 'metric'").groupBy("section", "period_idx").agg(F.sum("amount").alias("s"))
    tot = m.filter("kind = 'total'").select("section", "period_idx", F.col("amount").alias("t"))
    for r in lines.join(tot, ["section", "period_idx"]).collect():
        assert r["s"] == pytest.approx(r["t"], abs=0.005)
    ym = {(r["section"], r["item"], r["subitem"], r["kind"]): r["amount"] for r in y.collect()}
    mm = (m.filter("section != 'income_tax' and section != 'net_earnings'")
           .groupBy("section", "item", "subitem", "kind").agg(F.sum("amount").alias("a")).collect())
    for r in mm:
        assert r["a"] == pytest.approx(ym[(r["section"], r["item"], r["subitem"], r["kind"])], abs=0.005)


def test_statement_order_and_roles(spark):
    from tally.sources import fixtures as FX
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    p = ReportParams.of("1996-01-01", "1996-12-31", "yearly")
    st = pnl_statement_wide(pnl_report(spark, led.income, led.expenses, led.categories, p), p)
    items = [r["item"] for r in st.orderBy(*statement_order()).collect()]
    assert items[0] == "REVENUE" and items[-1] == "NET EARNINGS"
    assert items.index("Total Revenue") < items.index("COST OF GOODS SOLD") < items.index("GROSS PROFIT")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_aggregates_below_the_dimension_join_and_scans_once(spark, tmp_path):
    """On snapshots, in the final plan: one scan of each ledger, and the
    dimension is joined to aggregated rows."""
    from tally.operators.categories import with_parent_names
    from tally.sources import fixtures as FX
    from tally.sources.snapshot import SnapshotStore
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("income", led.income, partition_by_month=True)
    store.publish("expenses", led.expenses, partition_by_month=True)
    store.publish("categories", with_parent_names(led.categories))
    df = pnl_report(spark, *store.read_many(["income", "expenses", "categories"]),
                    ReportParams.of("1996-01-01", "1996-12-31", "monthly"))
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0].split("+- == Initial Plan ==")[0]
    for column in ("customer", "category_key"):
        assert len(re.findall(rf"FileScan parquet \[[^\]]*{column}#[^\]]*doc_month#", final)) == 1, column
    # Every ledger scan has an aggregate above it before the first join.
    optimized = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in optimized]
    for i, line in enumerate(optimized):
        if "Relation" in line and "grand_total" in line:
            above, level = [], depth[i]
            for j in range(i, -1, -1):
                if depth[j] < level:
                    above.append(optimized[j].lstrip(" :+-").split(" ")[0])
                    level = depth[j]
            assert "Aggregate" in above and ("Join" not in above or above.index("Aggregate") < above.index("Join"))


def test_lists_are_newest_first_without_the_month_column(spark, tmp_path):
    from tally.operators.filters import ledger_list
    from tally.sources import fixtures as FX
    from tally.sources.snapshot import SnapshotStore
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("income", FX.income_ledger(spark, "/root/testdata/sf0.001"), partition_by_month=True)
    out = ledger_list(store.read("income"), "1996-03-10", "1996-05-05")
    assert out.columns == S.column_names(S.INCOME_SCHEMA)
    rows = [(r.doc_date, r.row_id) for r in out.collect()]
    assert rows and rows == sorted(rows, key=lambda r: (-r[0].toordinal(), r[1]))


def test_empty_location_is_no_filter():
    assert ReportParams.of("1996-01-01", "1996-12-31", "yearly", "").location_filter is None
    assert ReportParams.of("1996-01-01", "1996-12-31", "yearly", "").location_label == "All"


def test_statement_roles(spark):
    from tally.plans.statement import cashflow_statement_wide
    from tally.sources import fixtures as FX
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    p = ReportParams.of("1996-01-01", "1996-12-31", "yearly")
    pnl = pnl_statement_wide(pnl_report(spark, led.income, led.expenses, led.categories, p), p)
    cash = cashflow_statement_wide(cashflow_report(spark, led.income, led.expenses, led.categories, p, Decimal(1)), p)

    def roles(df):
        return {r["item"]: {c[3:] for c in df.columns if c.startswith("is_") and r[c]} for r in df.collect()}
    assert roles(pnl)["NET EARNINGS"] == {"total", "final"} and roles(pnl)["EBIT"] == {"total"}
    got = roles(cash)
    assert got["CLOSING BALANCE"] == {"total", "final"} and got["CASH OUTFLOWS"] == {"header"}
    assert all(got["  " + h] == {"subheader"} for h in ("Cost of Goods Sold", "Operating Expenses", "Capital Expenses"))
    items = [r["item"] for r in cash.orderBy(*statement_order()).collect()]
    assert items.index("Total Inflows") < items.index("CASH OUTFLOWS") < items.index("  Cost of Goods Sold")


def test_plans_have_no_python_and_no_cartesian_product(spark):
    from tally.plans.catalog import REGISTRY
    for name in ("pnl_monthly", "cashflow_monthly", "expense_category_mix", "sync_expenses"):
        plan = _plan(REGISTRY[name].build(spark, "/root/testdata/sf0.001"))
        assert "Python" not in plan and "ArrowEval" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_reach_the_scan(spark):
    from tally.plans.catalog import REGISTRY
    plan = _plan(REGISTRY["expense_list"].build(spark, "/root/testdata/sf0.001"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", plan)


def test_reports_on_snapshots_prune_months(spark):
    import tempfile

    from tally.sources import fixtures as FX
    from tally.sources.snapshot import SnapshotStore
    led = FX.ledgers(spark, "/root/testdata/sf0.001")
    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="tally-prune-"))
    store.publish("income", led.income, partition_by_month=True)
    store.publish("expenses", led.expenses, partition_by_month=True)
    from tally.operators.categories import with_parent_names
    store.publish("categories", with_parent_names(led.categories))
    inc, exp, dim = store.read_many(["income", "expenses", "categories"])
    assert "parent_name" in dim.columns
    p = ReportParams.of("1996-01-01", "1996-12-31", "monthly")
    rep = pnl_report(spark, inc, exp, dim, p)
    plan = _plan(rep)
    assert plan.count("PartitionFilters: [isnotnull(doc_month") >= 2
    assert "CartesianProduct" not in plan
    # Same answer as the report straight from the derived ledgers.
    direct = pnl_report(spark, led.income, led.expenses, led.categories, p)
    assert rep.exceptAll(direct).count() == 0 and direct.exceptAll(rep).count() == 0


def test_type_summary_has_a_total_without_rows(spark):
    from tally.plans.expense_report import expense_type_summary
    got = expense_type_summary(spark.createDataFrame([], S.EXPENSE_SCHEMA)).collect()
    assert [(r["type"], r["total_amount"], r["count"]) for r in got] == [("TOTAL", 0.0, 0)]
