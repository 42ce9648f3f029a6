"""Cleaning, rejects, dedupe and merge on inline rows."""

from decimal import Decimal

import pytest

from tally import schemas as S
from tally.operators.categories import build_dimension, merge_dimension, resolve
from tally.operators.clean import clean_expenses, clean_income, rejects
from tally.operators.sync import action_counts, dedupe_batch, merge_ledger, net_position

SF = "/root/testdata/sf0.001"


def prior_store(spark, root):
    """A store with the prior snapshots of the sync fixtures."""
    from tally.sources import fixtures as FX
    from tally.sources.snapshot import SnapshotStore
    store = SnapshotStore(spark, root)
    store.commit({"income": store.write("income", FX.income_snapshot(spark, SF), by_month=True),
                  "expenses": store.write("expenses", FX.expense_snapshot(spark, SF), by_month=True),
                  "categories": store.write("categories", FX.parent_dimension(spark, SF))})
    return store


def publish_fixture(spark, store, dirty=False):
    from tally.plans.sync import publish_batches
    from tally.sources import fixtures as FX
    return publish_batches(store, {"income": FX.raw_income_batch(spark, SF),
                                   "expenses": FX.raw_expense_batch(spark, SF, dirty)},
                           FX.SYNC_AS_OF, FX.SYNC_AS_OF_DATE, FX.TEST_RECURRING)


RAW_INCOME = "_pos long, row_id string, doc_no string, doc_date string, customer string, currency string, " \
             "amount string, vat string, grand_total string, status string, location string"


def income_rows(spark, rows):
    return spark.createDataFrame(rows, RAW_INCOME)


def test_gate_defaults_and_fallbacks(spark):
    raw = income_rows(spark, [
        (1, None, "D1", "01/02/2025", "A", "THB", "10", "1", "11", "Paid", "bkk"),
        (2, "  ", "D2", "01/02/2025", "A", "THB", "10", "1", "11", "Paid", "bkk"),
        (3, "\t", "D3", "01/02/2025", "A", "THB", "10", "1", "11", "Paid", "bkk"),
        (4, " 7 ", "", "01/02/2025", "A", "THB", "1,234.50", None, None, "paid", "bkk-2a o'neil"),
        (5, "8", " keep ", "2025-03-04", "B", "THB", "x", "2", "99", "PENDING", "Pattaya"),
    ])
    out = {r["row_id"]: r for r in clean_income(raw).collect()}
    assert set(out) == {"7", "8"}
    r7 = out["7"]
    assert r7["doc_no"] == "AUTO-7"
    assert r7["amount"] == Decimal("1234.50") and r7["vat"] == Decimal("0.00")
    assert r7["grand_total"] == Decimal("1234.50")
    assert r7["status"] == "Paid" and r7["location"] == "Bkk-2A O'Neil"
    r8 = out["8"]
    assert r8["doc_no"] == " keep "
    assert r8["amount"] == Decimal("0.00") and r8["grand_total"] == Decimal("99.00")
    assert r8["status"] == "Pending"


def test_no_amount_and_no_row_is_lost(spark):
    """Blank positions and numbers of any width are rejects, never nulls or zeros."""
    good = ("D", "01/01/2025", "A", "THB")
    rows = [(None, "1", *good, "700.00", "0", "700.00", "Paid", "x"),
            (2, "2", *good, "12345678901234567890.00", "0", None, "Paid", "x"),
            (3, "3", *good, "1e20", "0", "5", "Paid", "x"),
            (4, "4", *good, "9" * 50, "-" + "9" * 50, "5", "Paid", "x"),
            (5, "5", *good, "1e2", "n/a", "", "Paid", "x")]
    cleaned = clean_income(income_rows(spark, rows))
    assert {r["row_id"]: r["reasons"] for r in rejects(cleaned).collect()} == {
        "1": "pos_missing", "2": "amount_out_of_range,grand_total_out_of_range", "3": "amount_out_of_range",
        "4": "amount_out_of_range,vat_out_of_range"}
    kept = {r["row_id"]: r for r in dedupe_batch(cleaned).collect()}
    assert len(kept) == 5 and kept["1"]["amount"] == Decimal("700.00") and str(kept["1"]["doc_date"]) == "2025-01-01"
    assert kept["5"]["amount"] == Decimal("100.00") and kept["5"]["_junk"] == "vat"


def test_dates_day_first(spark):
    from tally.functions import parse_day_first
    from pyspark.sql import functions as F
    want = {"05-12-2025": 1, "5.12.2025": 1, "2025/12/05": 1, "05/12/2025 10:00": 1, " 5 Dec 2025\t": 1, "2025-12-05": 1,
            "2025-12-05T10:00:01.5": 1, "5/12/2025": 1, "12/31/2025": 0, "5/12/25": 0, "31/02/2025": 0, "junk": 0, "": 0}
    df = spark.createDataFrame([(t,) for t in want], "t string").withColumn("d", parse_day_first(F.col("t")))
    assert {r.t: int(str(r.d) == "2025-12-05") for r in df.collect()} == want


def test_missing_columns_take_defaults(spark):
    raw = income_rows(spark, [(1, "1", "D", "01/01/2025", "A", "USD", "1", "0", "1", "Paid", "x")])
    raw = raw.drop("customer", "currency", "location")
    r = clean_income(raw).collect()[0]
    assert (r["customer"], r["currency"], r["location"]) == ("Unknown", "THB", "Unknown")


def test_rejects(spark):
    raw = income_rows(spark, [
        (1, "1", "D", "01/01/2025", "A", "THB", "1", "0", "1", "bogus", "x"),
        (2, "2", "D", "junk", "A", "THB", "1", "0", "1", "Paid", None),
        (3, "3", "D", "01/01/2025", None, "THB", "12345678901.00", "0", None, "Paid", "x"),
        (4, "4", "D", "01/01/2025", "A", "THB", "1", "0", "1", "Cancelled", "x"),
    ])
    got = {r["row_id"]: r["reasons"] for r in rejects(clean_income(raw)).collect()}
    assert got == {
        "1": "status_unknown",
        "2": "location_missing,doc_date_missing",
        "3": "customer_missing,amount_out_of_range,grand_total_out_of_range",
    }


RAW_EXP = "_pos long, row_id string, doc_no string, doc_date string, overdue_date string, supplier string, " \
          "currency string, amount string, vat string, grand_total string, status string, type string, " \
          "location string, category string, subcategory string"


def test_expense_rules(spark):
    raw = spark.createDataFrame([
        (1, "a", "B", "", None, "S", "THB", "5", "0", "5", "Paid", "OPEX", "bkk", None, "x"),
        (2, "b", "B", "01/01/2025", None, "S", "THB", "5", "0", "5", "Paid", "opex", "bkk", "", "NaN"),
        (3, "c", "B", "01/01/2025", None, "S", "THB", "5", "0", "5", "Paid", "CAPEX", "bkk", " Sueldos ", " nan "),
    ], RAW_EXP)
    out = {r["row_id"]: r for r in clean_expenses(raw, "2030-01-01").collect()}
    assert str(out["a"]["doc_date"]) == "2030-01-01"
    assert out["a"]["category"] == "Uncategorized" and out["a"]["subcategory"] == "x"
    assert out["a"]["category_key"] == "Uncategorized" + S.CATEGORY_KEY_SEP + "x"
    assert out["b"]["type"] is None and out["b"]["_reasons"] == "type_unknown"
    assert out["b"]["subcategory"] is None
    assert out["c"]["category"] == "Sueldos" and out["c"]["is_recurring"] is True
    assert out["c"]["recurrence_period"] == "monthly" and out["a"]["is_recurring"] is False


def _typed_income(spark, rows):
    df = spark.createDataFrame(rows, "row_id string, amount decimal(12,2), vat decimal(12,2), status string, _pos long")
    from pyspark.sql import functions as F
    return (df.withColumn("doc_no", F.lit("D")).withColumn("doc_date", F.lit("2025-01-01").cast("date"))
              .withColumn("customer", F.lit("A")).withColumn("currency", F.lit("THB"))
              .withColumn("grand_total", F.col("amount") + F.coalesce(F.col("vat"), F.lit(0)))
              .withColumn("location", F.lit("Bkk")))


def test_dedupe_last_position_wins(spark):
    b = _typed_income(spark, [("1", Decimal("1"), Decimal("0"), "Paid", 1), ("1", Decimal("2"), Decimal("0"), "Paid", 5),
                              ("1", Decimal("3"), Decimal("0"), "Paid", 3), ("2", Decimal("9"), Decimal("0"), "Paid", 2)])
    got = {r["row_id"]: (r["amount"], r["_repeats"]) for r in dedupe_batch(b).collect()}
    assert got == {"1": (Decimal("2.00"), 3), "2": (Decimal("9.00"), 1)}


def test_merge_actions_and_one_sided_nulls(spark):
    from pyspark.sql import functions as F
    snap_rows = [("1", Decimal("10"), Decimal("1"), "Paid", 0), ("2", Decimal("10"), None, "Paid", 0),
                 ("3", Decimal("10"), Decimal("1"), "Paid", 0), ("4", Decimal("10"), Decimal("1"), "Paid", 0)]
    snap = _typed_income(spark, snap_rows).drop("_pos")
    snap = (snap.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                .withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                .withColumn("created_by", F.lit("me")).withColumn("notes", F.lit("n")))
    batch = _typed_income(spark, [("1", Decimal("10.0005"), Decimal("1"), "Paid", 1),   # within tolerance
                                  ("2", Decimal("10"), Decimal("0"), "Paid", 2),        # null vs 0 → change
                                  ("3", Decimal("10"), Decimal("1"), "Pending", 3),     # status change
                                  ("5", Decimal("1"), Decimal("0"), "Paid", 4)]).drop("_pos")
    batch = batch.withColumn("doc_no", F.when(F.col("row_id") == "1", "CHANGED").otherwise(F.col("doc_no")))
    merged = merge_ledger(snap, batch, S.INCOME_SCHEMA, S.INCOME_COMPARE, "2025-01-01 00:00:00")
    got = {r["row_id"]: r for r in merged.collect()}
    assert {k: v["action"] for k, v in got.items()} == {"1": "skip", "2": "update", "3": "update",
                                                        "4": "retain", "5": "insert"}
    assert got["1"]["doc_no"] == "D"                      # doc_no alone is not compared
    assert got["3"]["status"] == "Pending" and got["3"]["created_by"] == "me"
    assert str(got["3"]["updated_at"]) == "2025-01-01 00:00:00"
    assert str(got["5"]["created_at"]) == "2025-01-01 00:00:00" and got["5"]["notes"] is None
    counts = {r["action"]: r["count"] for r in action_counts(merged, "income").collect()}
    assert counts == {"skip": 1, "update": 2, "retain": 1, "insert": 1}
    # Re-running the same batch against the result changes nothing.
    again = merge_ledger(merged.drop("action"), batch, S.INCOME_SCHEMA, S.INCOME_COMPARE, "2025-02-01 00:00:00")
    assert {r["action"] for r in again.filter("row_id != '4'").collect()} == {"skip"}


def test_net_position_empty_is_zero(spark):
    empty = spark.createDataFrame([], "grand_total decimal(12,2)")
    inc = spark.createDataFrame([(Decimal("5.00"),)], "grand_total decimal(12,2)")
    r = net_position(inc, empty).collect()[0]
    assert (r["total_income"], r["total_expenses"], r["net_position"]) == (5.0, 0.0, 5.0)


def test_dimension_same_subname_under_two_parents(spark):
    lines = spark.createDataFrame([("Rent", "Office"), ("Travel", "Office"), ("Rent", None), ("Rent", "Office")],
                                  "category string, subcategory string")
    dim = build_dimension(lines)
    assert dim.count() == 4
    existing = dim.filter("parent_key is null")
    assert merge_dimension(existing, lines).count() == 4
    agg = spark.createDataFrame([("Rent" + S.CATEGORY_KEY_SEP + "Office",), ("Rent",), ("Ghost",)], "category_key string")
    got = {r["category_key"]: (r["category"], r["subcategory"], r["kind"]) for r in resolve(agg, dim).collect()}
    assert got == {"Rent" + S.CATEGORY_KEY_SEP + "Office": ("Rent", "Office", "sub"), "Rent": ("Rent", None, "direct")}


def test_missing_parent_counts_in_total_only(spark):
    from tally.operators.categories import with_parent_names
    dim = spark.createDataFrame([("P" + S.CATEGORY_KEY_SEP + "c", "c", "P")], "category_key string, name string, parent_key string")
    agg = spark.createDataFrame([("P" + S.CATEGORY_KEY_SEP + "c",)], "category_key string")
    for d in (dim, with_parent_names(dim)):
        r = resolve(agg, d).collect()[0]
        assert r["category"] is None and r["is_subcategory"] is True


def test_resolve_same_with_published_parent_names(spark):
    from tally.operators.categories import with_parent_names
    from tally.sources import fixtures as FX
    dim = FX.category_dimension(spark, "/root/testdata/sf0.001")
    keys = dim.select("category_key").union(spark.createDataFrame([("Ghost",)], "category_key string"))
    cols = ["category_key", "category", "subcategory", "kind", "is_subcategory"]
    a = resolve(keys, dim).select(*cols)
    b = resolve(keys, with_parent_names(dim)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == dim.count()


def test_params_checks():
    from tally.params import ReportParams, parse_ddmmyyyy
    assert len(ReportParams.of("1996-01-01", "1997-01-31", "monthly").period_labels()) == 13
    with pytest.raises(ValueError):
        ReportParams.of("1996-01-01", "1997-02-01", "monthly")
    with pytest.raises(ValueError):
        ReportParams.of("1996-01-01", "1996-02-01", "weekly")
    with pytest.raises(ValueError):
        ReportParams.of("1996-03-01", "1996-02-01", "yearly")
    with pytest.raises(ValueError):
        parse_ddmmyyyy("2025-12-31")
    assert ReportParams.of("1996-11-01", "1997-02-28", "monthly").period_labels() == ["nov-96", "dec-96", "jan-97", "feb-97"]


def test_publish_counts_match_actions(spark):
    """Counters observed during the publish equal a groupBy over the merge."""
    import tempfile

    from tally.plans.catalog import _sync
    f = _sync(spark, SF)
    expect = {}
    for ledger, merged in (("income", f.income), ("expenses", f.expenses)):
        for r in action_counts(merged, ledger).collect():
            expect[f"{ledger}_{r['action']}"] = r["count"]
    store = prior_store(spark, tempfile.mkdtemp(prefix="tally-pub-"))
    summary = publish_fixture(spark, store)
    got = {k: v for k, v in summary.items() if v and k.rpartition("_")[2] in ("insert", "update", "skip", "retain")}
    assert got == expect
    assert summary["expenses_losers"] == f.expense_clean.count() - f.expense_clean.select("row_id").distinct().count() > 0
    assert summary["income_losers"] == 0
    assert summary["income_junk"] == f.income_clean.filter("_junk <> ''").count() > 0
    assert store.read("expenses").count() == f.expenses.count()
    assert summary["net_position"] == pytest.approx(summary["total_income"] - summary["total_expenses"], abs=0.01)


def test_observed_totals_equal_published_snapshots(spark):
    import tempfile

    store = prior_store(spark, tempfile.mkdtemp(prefix="tally-pub2-"))
    summary = publish_fixture(spark, store)
    r = net_position(*store.read_many(["income", "expenses"])).collect()[0]
    assert (summary["total_income"], summary["total_expenses"], summary["net_position"]) == \
        (r["total_income"], r["total_expenses"], r["net_position"])
