"""Export-triggered sync: exports of several files arrive; the second updates the first."""

import tempfile

from pyspark.sql import functions as F

from tally.sources import fixtures as FX
from tally.sources.raw import write_raw_ledger
from tally.sources.snapshot import SnapshotStore
from tally.streaming.sync_stream import announce_export, start_sync_stream

SF = "/root/testdata/sf0.001"


def test_stream_sync_income(spark):
    root = tempfile.mkdtemp(prefix="tally-stream-")
    exports = f"{root}/exports"
    raw = FX.raw_income_batch(spark, SF)
    half = raw.filter(F.col("_pos") % 2 == 0)
    # Several part files, columns in another order.
    write_raw_ledger(half.select(*reversed(half.columns)).repartition(3), f"{exports}/a", "csv")
    store = SnapshotStore(spark, f"{root}/store")
    announce_export(spark, f"{root}/inbox", f"{exports}/a")
    start_sync_stream(spark, "income", f"{root}/inbox", store, f"{root}/ckpt", available_now=True).awaitTermination(300)
    assert store.latest()[0] == 1
    first = store.read("income")
    gated = raw.filter((F.col("_pos") % 2 == 0) & (F.col("row_id") != "")).count()
    assert first.count() == gated
    # Same rows again with one amount changed: only updates and skips, no new rows.
    changed = raw.filter(F.col("_pos") % 2 == 0).withColumn(
        "amount", F.when(F.col("_pos") % 4 == 0, F.lit("1.00")).otherwise(F.col("amount")))
    write_raw_ledger(changed.repartition(2), f"{exports}/b", "csv")
    announce_export(spark, f"{root}/inbox", f"{exports}/b")
    start_sync_stream(spark, "income", f"{root}/inbox", store, f"{root}/ckpt", available_now=True).awaitTermination(300)
    assert store.latest()[0] == 2
    second = store.read("income")
    assert second.count() == gated
    assert second.filter(F.col("amount") == 1).count() > 0


def test_stream_sync_expenses_creates_categories(spark):
    from tally.params import ReportParams
    from tally.plans.pnl import pnl_report
    root = tempfile.mkdtemp(prefix="tally-stream-exp-")
    raw = FX.raw_expense_batch(spark, SF)
    write_raw_ledger(raw, f"{root}/exports", "csv")
    announce_export(spark, f"{root}/inbox", f"{root}/exports")
    store = SnapshotStore(spark, f"{root}/store")
    q = start_sync_stream(spark, "expenses", f"{root}/inbox", store, f"{root}/ckpt", available_now=True,
                          recurring=FX.TEST_RECURRING)
    q.awaitTermination(300)
    exp, dim = store.read_many(["expenses", "categories"])
    # Every synced expense's category key is in the published dimension ...
    assert exp.join(dim, "category_key", "left_anti").count() == 0
    # ... so a report sees every synced line of the range.
    p = ReportParams.of("1996-01-01", "1996-12-31", "yearly")
    rep = pnl_report(spark, spark.createDataFrame([], "customer string, doc_date date, amount decimal(12,2), "
                                                       "grand_total decimal(12,2), location string"), exp, dim, p)
    total = {r["section"]: r["amount"] for r in rep.filter("kind = 'total'").collect()}
    in_range = exp.filter("doc_date between '1996-01-01' and '1996-12-31'")
    want = {t: in_range.filter(f"type = '{t}'").agg(F.sum("amount")).collect()[0][0] for t in ("COGS", "OPEX")}
    assert abs(total["cogs"] - float(want["COGS"] or 0)) < 0.005
    assert abs(total["operating_expenses"] - float(want["OPEX"] or 0)) < 0.005
