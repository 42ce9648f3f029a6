"""Hot keys: one key holding a third of the rows is combined map-side."""

from decimal import Decimal

from pyspark.sql import functions as F

from tally.operators.sync import dedupe_batch
from tally.params import ReportParams
from tally.plans.pnl import revenue_lines


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_row_id_dedupes_with_partial_aggregation(spark):
    n = 30000
    batch = (spark.range(n).repartition(8)
             .select(F.col("id").alias("_pos"),
                     F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("row_id"),
                     (F.col("id") * 2).alias("v")))
    d = dedupe_batch(batch)
    plan = _plan(d)
    assert "partial_max(_place" in plan      # combined before the shuffle
    assert "SortAggregate" not in plan
    hot = d.filter("row_id = 'HOT'").collect()
    assert len(hot) == 1 and hot[0]["_repeats"] == n // 3 and hot[0]["_pos"] == 29997
    assert d.count() == 1 + (n - n // 3)


def test_equal_positions_have_one_winner_whatever_the_order(spark):
    """Exports of several files that each count from 1: the winner is a row of
    the input, the same for every order and spread of the input; equal rows are one."""
    rows = [("1", 4, "a", "x"), ("1", 4, "b", None), ("1", 4, "b", ""), ("1", 3, "z", "x"), ("2", 7, "c", "x"),
            ("2", 7, "c", "x"), ("3", None, "d", "x"), ("3", None, "e", "x"), (None, 9, "f", "x")]
    schema = "row_id string, _pos long, v string, w string"
    winners = set()
    for seed in range(6):
        df = spark.createDataFrame(rows[seed:] + rows[:seed], schema).repartition(1 + seed)
        got = dedupe_batch(df)
        assert "SortAggregate" not in _plan(got)
        winners.add(tuple(sorted((r.row_id, r._pos, r.v, r.w, r._repeats) for r in got.collect())))
    assert len(winners) == 1
    one, two, three = winners.pop()
    assert one[:2] == ("1", 4) and (one[0], *one[1:4]) in rows and one[4] == 4
    assert two == ("2", 7, "c", "x", 2) and three[:2] == ("3", None) and three[2] in ("d", "e")


def test_hot_customer_is_preaggregated(spark):
    import datetime as dt
    rows = [("BIG" if i % 3 == 0 else f"C{i}", dt.date(2024, 1 + i % 12, 1), Decimal("1.00")) for i in range(3000)]
    inc = spark.createDataFrame(rows, "customer string, doc_date date, amount decimal(12,2)").repartition(8)
    p = ReportParams.of("2024-01-01", "2024-12-31", "monthly")
    lines = revenue_lines(inc, p)
    assert "partial_sum" in _plan(lines)
    big = {r["period_idx"]: r["amount"] for r in lines.filter("item = 'BIG'").collect()}
    assert len(big) == 12 and sum(big.values()) == Decimal(1000)


def test_losers_of_a_hot_row_id_are_reported(spark):
    from tally.operators.sync import batch_losers
    n = 3000
    batch = spark.range(n).select(F.col("id").alias("_pos"),
                                  F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string"))
                                  .alias("row_id"))
    losers = batch_losers(batch, dedupe_batch(batch))
    assert losers.count() == n // 3 - 1
    assert losers.filter("row_id != 'HOT'").count() == 0
    assert losers.agg(F.max("_pos")).collect()[0][0] < 2997
