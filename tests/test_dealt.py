"""Syncs over tables dealt by key: nothing is shuffled or kept twice on disk, and
the rows are those of the plain operators, also for null and repeated keys."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tally import schemas as S
from tally.operators.sync import dedupe_batch
from tally.plans.catalog import REGISTRY, _sync
from tally.plans.sync import publish_batches
from tally.session import shared_path
from tally.sources import fixtures as FX
from tally.sources.dealt import Dealt
from tally.sources.raw import read_raw_ledger, write_raw_lines
from tally.sources.snapshot import SnapshotStore

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def _tables(spark) -> str:
    """Lines without key or number, equal lines, a part that comes twice, lines of no part or supplier."""
    at = tempfile.mkdtemp(prefix="tally-odd-")
    day = dt.datetime(1996, 1, 31)
    lines = [(k, p, s, n, float(q), 10.5 * q, 0.05, 0.02, "N", "O", day + dt.timedelta(days=q))
             for k, p, s, n, q in [(1, 1, 1, 1, 1), (1, 2, 1, 1, 2), (1, 2, 1, 1, 2), (1, 1, 2, 2, 3), (2, 3, 2, None, 4),
                                   (2, 1, 1, None, 9), (2, 1, 1, 1, 5), (3, 2, 2, None, 6), (None, 1, 1, 1, 7), (6, 1, 1, 7, 1),
                                   (None, 2, 2, None, 8), (7, 9, 1, 1, 1), (7, 1, 9, 1, 1), (7, None, 1, 1, 1), (7, 2, 2, 1, 1)]]
    for name, rows, schema in (
            ("region", [(0, "ASIA")], "r_regionkey int, r_name string"),
            ("nation", [(0, "X", 0)], "n_nationkey int, n_name string, n_regionkey int"),
            ("supplier", [(1, "S1", 0), (2, "S2", 0), (None, "S0", 0)], "s_suppkey long, s_name string, s_nationkey int"),
            ("part", [(1, "a", "B#1", "PROMO", 1), (2, "b", "B#2", "SMALL", 7), (3, "c", "B#3", "LARGE", 3),
                      (3, "c", "B#3", "LARGE", 3), (None, "d", "B#4", "LARGE", 4)],
             "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
             "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
             "l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("broadcast", ["10m", "1k"])
def test_dealt_lines_and_snapshot_are_the_plain_ones(spark, broadcast):
    at, before = _tables(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        dealt = Dealt(spark, at, "lineitem")
        src = FX.dealt_expense_source(spark, at, dealt)
        lines, plain = FX.expense_batch_lines(spark, at, src), FX.expense_batch_lines(spark, at)
        assert _rows(lines) == _rows(plain) and lines.count() == 13
        held, same = FX.dealt_expense_snapshot(spark, at, src), FX.expense_snapshot(spark, at, plain)
        assert _rows(held) == _rows(same) and held.filter("row_id IS NULL").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dealt_batch_has_the_same_winners(spark):
    rows = [("1", 4, "a", "x"), ("1", 4, "b", None), ("1", 4, "b", ""), ("1", 3, "z", "x"), ("2", 7, "c", "x"),
            ("2", 7, "c", "x"), ("3", None, "d", "x"), ("3", None, "e", "x"), (None, 9, "f", "x")]
    df = spark.createDataFrame(rows, "row_id string, _pos long, v string, w string")
    table = Dealt(spark, SF, "lineitem").write(df, "row_id", "batch")
    assert _rows(dedupe_batch(table, dealt=True)) == _rows(dedupe_batch(df))


def test_more_buckets_than_files_allow_are_shuffled_first(spark, monkeypatch):
    monkeypatch.setattr("tally.sources.dealt.MOST_BUCKETS", 1)
    dealt = Dealt(spark, SF, "lineitem")
    table = dealt.write(spark.range(100).repartition(5), "id", "ids")
    assert _rows(table) == _rows(spark.range(100))
    files = [f for f in os.listdir(f"{dealt.root}/ids".removeprefix("file:")) if f.startswith("part-")]
    assert len(files) <= dealt.buckets


@pytest.mark.parametrize("name", ["sync_expenses", "sync_actions", "sync_counts", "net_position", "batch_dedupe"])
def test_merge_shuffles_no_ledger_rows(spark, name):
    df = REGISTRY[name].build(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert not [x for x in dealt if "row_id" in x or "_key" in x], dealt
    if name == "sync_expenses":
        assert _rows(df) == _rows(_sync(spark, SF).expenses)


def test_steps_keep_no_table_that_is_done_with(spark):
    top = shared_path(spark, "tally-dealt").removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    REGISTRY["sync_expenses"].build(spark, SF)
    [made] = set(os.listdir(top)) - before
    assert sorted(os.listdir(f"{top}/{made}")) == ["expense-snapshot", "expenses"]


def test_a_json_export_is_compressed(spark):
    path = tempfile.mkdtemp(prefix="tally-json-") + "/out"
    lines = spark.range(5000).select(F.to_json(F.struct(F.col("id").alias("_pos"), F.lit("x" * 200).alias("supplier"))).alias("line"))
    write_raw_lines(lines, path, None, "gzip")
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < 5000 * 20
    back = read_raw_ledger(spark, path, "json", "expenses")
    assert back.agg(F.count("supplier"), F.sum("_pos")).first()[:] == (5000, 4999 * 2500)
    at = set(os.listdir(top)) if os.path.isdir(top := shared_path(spark, "tally-exports").removeprefix("file:")) else set()
    REGISTRY["read_raw_json"].build(spark, SF)
    [made] = set(os.listdir(top)) - at
    assert all(f.endswith(".gz") for f in os.listdir(f"{top}/{made}") if f.startswith("part-"))


def _income(spark, rows):
    """(row_id, doc_date, amount) in export order."""
    cells = {"row_id": 0, "doc_date": 1, "amount": 2}
    raw = [(n, *[r[cells[c]] if c in cells else "Paid" if c == "status" else "0" if c in S.MONEY_FIELDS else "x"
                 for c in S.INCOME_RAW_COLUMNS]) for n, r in enumerate(rows)]
    return spark.createDataFrame(raw, "_pos long, " + ", ".join(f"{c} string" for c in S.INCOME_RAW_COLUMNS))


def test_a_dealt_publish_is_the_plain_one(spark):
    """Skips, updates, a row that moves into a month the batch has no other ids of, one
    that leaves its month empty, a repeat and inserts; then a batch that changes nothing."""
    first = [(str(k), f"0{1 + k % 4}/0{1 + k % 3}/2025", str(k)) for k in range(12)] + [("x", "01/07/2025", "1"), ("y", "01/08/2025", "2")]
    second = [("0", "01/01/2025", "0"), ("3", "01/01/2025", "99"), ("x", "05/08/2025", "1"), ("new", "05/09/2025", "7"),
              ("4", "01/01/2025", "4"), ("3", "04/01/2025", "98"), ("older", "05/03/2025", "7")]
    got = []
    for deal in (False, True):
        store = SnapshotStore(spark, tempfile.mkdtemp(prefix="tally-publish-"))
        made, told = [], []
        for n, rows in enumerate((first, second, second)):
            dealt = Dealt(spark, SF, "lineitem") if deal else None
            made.append(dealt)
            summary = publish_batches(store, {"income": _income(spark, rows)}, f"2025-0{n + 1}-01 00:00:00", "2025-01-01",
                                      dealt=dealt, raw_is_read=lambda: told.append(n))
            got.append((_rows(store.read("income")), summary, store.latest()[1]["income"].parts.keys()))
        assert told == [0, 1, 2]
        assert not any(os.listdir(d.root.removeprefix("file:")) for d in made if d)
    assert got[:3] == got[3:] and got[4][1]["income_update"] == 3 and got[4][1]["income_insert"] == 2
    assert got[5][1]["income_skip"] == 6 and len(got[5][0]) == 16


def test_a_dealt_publish_shuffles_no_rows_by_month(spark, monkeypatch):
    """What is written by month has no exchange over it, and nothing is staged a second time."""
    plans = []
    write = SnapshotStore.write

    def seen(self, name, df, *a, **b):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString(), b))
        return write(self, name, df, *a, **b)

    monkeypatch.setattr(SnapshotStore, "write", seen)
    top = shared_path(spark, "tally-dealt").removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    REGISTRY["sync_snapshot"].build(spark, SF)
    ledgers = [p for name, p, b in plans if name == "expenses" and b["gather"] is False]
    assert len(ledgers) == 2 and not any("Exchange hashpartitioning(row_id" in p for p in ledgers)
    [made] = set(os.listdir(top)) - before
    assert os.listdir(f"{top}/{made}") == []
