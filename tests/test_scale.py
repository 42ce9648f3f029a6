"""Steps whose cost per row, or per task, must not grow: the generated code stays
short enough for the JVM to compile, a merge reads its batch once, an export is
written by as many tasks as hold its lines."""

import os
import tempfile

from pyspark.sql import functions as F

from tally.functions import parse_day_first, parse_money
from tally.operators.clean import batch_columns, clean_expenses, clean_income, rejects
from tally.operators.sync import dedupe_batch
from tally.plans.sync import merged_ledger
from tally.sources.raw import read_raw_ledger, write_raw_lines
from tally import schemas as S

JIT_LIMIT = 8000  # bytes of a method that HotSpot compiles
DATES = ("02/01/2025", "2-1-2025", "2.1.2025 10:05", "2025-01-02", " 2 Jan 2025 ", "")


def _raw(spark, ledger: str, n: int = 60):
    k = F.col("id")
    cells = {"row_id": k.cast("string"), "doc_no": k.cast("string"), "amount": F.lit("1,000.00"), "vat": F.lit("n/a"),
             "grand_total": F.lit(""), "status": F.lit("paid"), "type": F.lit("OPEX"), "location": F.lit("bkk"),
             "doc_date": F.element_at(F.array(*map(F.lit, DATES)), (k % 6 + 1).cast("int")),
             "overdue_date": F.lit("2025-01-02")}
    columns = S.INCOME_RAW_COLUMNS if ledger == "income" else S.EXPENSE_RAW_COLUMNS
    return spark.range(n).select(k.alias("_pos"), *[cells.get(c, F.lit("x")).alias(c) for c in columns])


def _longest_method(spark, df) -> int:
    df.collect()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_cleaning_and_dedupe_compile(spark):
    income, expenses = clean_income(_raw(spark, "income")), clean_expenses(_raw(spark, "expenses"), "2025-01-01")
    for df in (income, expenses, dedupe_batch(batch_columns(income)), dedupe_batch(batch_columns(expenses)),
               rejects(expenses)):
        assert _longest_method(spark, df) < JIT_LIMIT


def test_place_is_worked_out_once_a_row(spark):
    """The join on it infers a null filter, which would hold all of the cleaning again."""
    plan = dedupe_batch(batch_columns(clean_expenses(_raw(spark, "expenses"), "2025-01-01")))._jdf.queryExecution()
    filters = [x for x in plan.optimizedPlan().toString().split("\n") if "Filter" in x]
    assert filters and not any("md5" in x for x in filters)


def test_merge_reads_its_sides_once(spark):
    clean = clean_income(_raw(spark, "income")).filter("doc_date IS NOT NULL")
    old = spark.createDataFrame([], S.INCOME_SCHEMA)
    first = merged_ledger("income", old, clean, "2025-01-01 00:00:00").drop("action")
    merged = merged_ledger("income", first.filter("row_id < '3'"), clean, "2025-02-01 00:00:00")
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 2
    held = spark.createDataFrame(first.limit(3).collect(), S.INCOME_SCHEMA)
    rows = held.unionByName(held.limit(1)).unionByName(held.limit(1).withColumn("row_id", F.lit(None).cast("string")))
    got = merged_ledger("income", rows, clean, "2025-02-01 00:00:00").groupBy("action").count().collect()
    assert dict(got) == {"skip": 4, "retain": 1, "insert": 47}


def test_dates_and_money_of_odd_forms(spark):
    dates = {"1/2/0000": "0000-02-01", "001/002/2025": "2025-02-01", "1/2/+12025": "+12025-02-01", "1 jAn 2025": "2025-01-01",
             "2025.1-2": "2025-01-02", "1/2/2025\n 10:05": None, "2025": None, "2025-01": None, "2025-01-02x": None,
             "0/1/2025": None, "1/13/2025": None, "1 Foo 2025": None, "29/2/2024": "2024-02-29", "29/2/2025": None}
    df = spark.createDataFrame([(t,) for t in dates], "t string").select("t", parse_day_first(F.col("t")).cast("string").alias("d"))
    assert dict(df.collect()) == dates
    money = {"\x1c1.5\x00": "1.50", "٣": "3.00", "1.2.3": None, ".": None, "+.5e1": "5.00", "1e30": "1000000000000000000000000000000.00",
             "9" * 40: "1" + "0" * 20 + ".00", "1,2,3": "123.00", "- 1": None, "1 2": None, "NaN": None}
    df = spark.createDataFrame([(t,) for t in money], "t string").select("t", parse_money(F.col("t")).cast("string").alias("m"))
    assert dict(df.collect()) == money


def test_an_export_has_as_many_files_as_tasks(spark):
    raw = _raw(spark, "income", 90).repartition(9)
    path = tempfile.mkdtemp(prefix="tally-lines-")
    for header, at in ((None, f"{path}/json"), (",".join(raw.columns), f"{path}/csv")):
        line = F.to_json(F.struct(*raw.columns)) if header is None else F.to_csv(F.struct(*raw.columns))
        write_raw_lines(raw.select(line.alias("line")), at, header)
        assert sum(f.startswith("part-") for f in os.listdir(at)) == 9 + (header is not None)
        back = read_raw_ledger(spark, at, "json" if header is None else "csv", "income").collect()
        assert sorted(r._pos for r in back) == list(range(90)) and not any(r[S.CORRUPT] for r in back)
    write_raw_lines(raw.filter("_pos < 0").select(F.lit("").alias("line")), f"{path}/none", ",".join(raw.columns))
    none = read_raw_ledger(spark, f"{path}/none")
    assert none.columns[:2] == raw.columns[:2] and none.count() == 0
