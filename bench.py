"""Bench: the engine's work at $BENCH_SF_DIR on local[$BENCH_CPUS].

Shaped like a deployed service. The inputs are materialized once and timed
as ``setup_sec``, which is not part of the total:
  * the ledgers derived from the star schema, published as month-partitioned
    snapshots (the state reports read);
  * raw export batches (text cells + export order) and the prior snapshots
    a sync merges into.
Then the timed queries (the total) run:
  * ``sync``: clean → reject check → dedupe → merge → publish of both
    ledgers and the category dimension, from the raw exports;
  * the reports and lists over the published snapshots;
  * two reports end to end from the star-schema tables (``e2e_*``), ledgers
    derived in the same plan.
Each query is forced in full with the no-op sink (no driver collection). A
warm-up query on sf0.001 runs first. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from pyspark.sql import functions as F  # noqa: E402

from tally.operators.categories import with_parent_names  # noqa: E402
from tally.operators.filters import ledger_list, list_total  # noqa: E402
from tally.operators.sync import net_position  # noqa: E402
from tally.params import ReportParams  # noqa: E402
from tally.plans.cashflow import cashflow_report  # noqa: E402
from tally.plans.catalog import REGISTRY  # noqa: E402
from tally.plans.expense_report import (  # noqa: E402
    expense_category_mix, expense_trend, expense_trend_wide, expense_type_summary)
from tally.plans.pnl import pnl_report  # noqa: E402
from tally.plans.statement import pnl_statement_wide  # noqa: E402
from tally.plans.sync import publish_batches  # noqa: E402
from tally.session import local_session  # noqa: E402
from tally.sources import fixtures as FX  # noqa: E402
from tally.sources.snapshot import SnapshotStore  # noqa: E402

YEAR = ReportParams.of("1996-01-01", "1996-12-31", "yearly")
MONTHLY = ReportParams.of("1996-01-01", "1996-12-31", "monthly")
ASIA = ReportParams.of("1996-01-01", "1997-01-31", "monthly", "Asia")
CROSS = ReportParams.of("1996-11-01", "1997-02-28", "monthly")
PARTIAL = ("1996-03-10", "1996-05-05")


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tally-bench")
    # A folder that all executors share; on one machine a scratch folder will do.
    scratch = os.environ.get("BENCH_DIR") or tempfile.mkdtemp(prefix="tally-bench-")

    warm = timed(lambda: force(REGISTRY["pnl_yearly"].build(spark, "/root/testdata/sf0.001")))

    # ---- setup: materialize inputs once --------------------------------
    reports = SnapshotStore(spark, f"{scratch}/reports")
    prior = SnapshotStore(spark, f"{scratch}/prior")
    exports = f"{scratch}/exports"

    def setup():
        led = FX.ledgers(spark, sf_dir)
        reports.publish("income", led.income, partition_by_month=True)
        reports.publish("expenses", led.expenses, partition_by_month=True)
        reports.publish("categories", with_parent_names(led.categories))
        lines = FX.expense_batch_lines(spark, sf_dir)
        FX.raw_income_batch(spark, sf_dir).write.parquet(f"{exports}/income")
        FX.raw_expense_batch(spark, sf_dir, lines=lines).write.parquet(f"{exports}/expenses")
        prior.publish("income", FX.income_snapshot(spark, sf_dir), partition_by_month=True)
        prior.publish("expenses", FX.expense_snapshot(spark, sf_dir, lines), partition_by_month=True)
        prior.publish("categories", FX.parent_dimension(spark, sf_dir))
    setup_sec = timed(setup)

    queries: dict[str, float] = {}

    # ---- sync from the exports into the prior snapshots -----------------
    def sync():
        publish_batches(prior, {"income": spark.read.parquet(f"{exports}/income"),
                                "expenses": spark.read.parquet(f"{exports}/expenses")},
                        FX.SYNC_AS_OF, FX.SYNC_AS_OF_DATE, FX.TEST_RECURRING)
    queries["sync"] = timed(sync)

    # The usual case: an export of one month, some amounts changed.
    def small_sync():
        month = spark.read.parquet(f"{exports}/income").filter("doc_date LIKE '%/03/1996'")
        publish_batches(prior, {"income": month.withColumn("amount", F.lit("1.00"))}, FX.SYNC_AS_OF, FX.SYNC_AS_OF_DATE)
    queries["sync_one_month"] = timed(small_sync)

    # ---- reports over the published snapshots ---------------------------
    inc, exp, dim = reports.read_many(["income", "expenses", "categories"])
    runs = {
        "pnl_yearly": lambda: pnl_report(spark, inc, exp, dim, YEAR),
        "pnl_monthly": lambda: pnl_report(spark, inc, exp, dim, MONTHLY),
        "pnl_monthly_location": lambda: pnl_report(spark, inc, exp, dim, ASIA),
        "cashflow_yearly": lambda: cashflow_report(spark, inc, exp, dim, YEAR, Decimal(10000)),
        "cashflow_monthly": lambda: cashflow_report(spark, inc, exp, dim, CROSS, Decimal(100000)),
        "pnl_statement_wide": lambda: pnl_statement_wide(pnl_report(spark, inc, exp, dim, MONTHLY), MONTHLY),
        "expense_trend": lambda: expense_trend(exp),
        "expense_trend_wide": lambda: expense_trend_wide(exp),
        "expense_category_mix": lambda: expense_category_mix(exp, dim),
        "expense_type_summary": lambda: expense_type_summary(exp),
        "income_list": lambda: ledger_list(inc),
        "expense_list": lambda: ledger_list(exp, *PARTIAL, "Europe"),
        "list_totals": lambda: list_total(inc, "income", *PARTIAL).unionByName(
            list_total(exp, "expenses", *PARTIAL, "Europe")),
        "net_position": lambda: net_position(inc, exp),
    }
    for name, build in runs.items():
        queries[name] = timed(lambda b=build: force(b()))

    # ---- end to end from the star-schema tables -------------------------
    for name in ("pnl_monthly", "cashflow_monthly"):
        queries[f"e2e_{name}"] = timed(lambda n=name: force(REGISTRY[n].build(spark, sf_dir)))

    total = round(sum(queries.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    rows = {"expenses": exp.count(), "income": inc.count()}
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": queries,
                      "setup_sec": setup_sec, "warmup_sec": warm, "rows": rows, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
