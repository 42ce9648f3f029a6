"""Ledgers derived from the star schema (see FIXTURES.md).

Every derived table is a lazy DataFrame over the given Parquet tables, so the
work grows with them. Doubles are cast to DECIMAL *before* arithmetic and
rounded to cents, so the same values come out of Spark and of the SQL oracle.

Joins here are equi joins on the star schema keys. No broadcast hints are
given: the planner broadcasts nation/region (and part/supplier while they are
small) only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``; beyond it the join is a
sort-merge join on the key, with AQE splitting skewed partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from .. import schemas as S
from ..functions import py_title, to_money
from .dealt import Dealt
from .tables import read_table

# Fixture constants (parameters of the test ledgers, not of the engine).
INCOME_FACTOR = "0.53"
INCOME_VAT_RATE = "0.07"
TEST_RECURRING = ("ECONOMY", "SMALL")
SNAPSHOT_CREATED = "2024-12-01 00:00:00"
SYNC_AS_OF = "2025-01-01 00:00:00"
SYNC_AS_OF_DATE = "2025-01-01"

INCOME_STATUS = {"F": "Paid", "O": "Pending", "P": "Overdue"}
EXPENSE_STATUS = {"F": "Paid", "O": "Pending"}
EXPENSE_TYPE = {"R": "CAPEX", "A": "OPEX", "N": "COGS"}


def _map(c: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr


def _dec(c: Column, p: int = 12, s: int = 2) -> Column:
    return c.cast(T.DecimalType(p, s))


def _region_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation → region name and its title-cased location, computed on the
    dimension side (one row per nation) rather than once per ledger line."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", "r_name", py_title(F.col("r_name")).alias("r_location")))


# ---------------------------------------------------------------------------
# Typed ledgers
# ---------------------------------------------------------------------------

def income_source(spark: SparkSession, sf_dir: str, dealt: Dealt | None = None) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region, the columns the ledger needs."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    geo = _region_of_nation(spark, sf_dir)
    held = (orders.join(customer, orders.o_custkey == customer.c_custkey) if dealt is None
            else dealt.join(orders, customer, "o_custkey", "c_custkey"))
    return held.join(geo, F.col("c_nationkey") == geo.n_nationkey)


def income_lines(spark: SparkSession, sf_dir: str, dealt: Dealt | None = None) -> DataFrame:
    """Every income line, with its key and region text."""
    src = income_source(spark, sf_dir, dealt)
    amount = to_money(_dec(F.col("o_totalprice")) * F.lit(INCOME_FACTOR).cast("decimal(3,2)"))
    df = (src.select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("doc_no"),
        F.col("o_orderdate").cast("date").alias("doc_date"),
        F.col("c_name").alias("customer"),
        F.lit(S.DEFAULT_CURRENCY).alias("currency"),
        amount.alias("amount"),
        _map(F.col("o_orderstatus"), INCOME_STATUS).alias("status"),
        F.col("r_location").alias("location"),
        F.col("o_orderkey").alias("_key"), "r_name",
    ).withColumn("vat", to_money(F.col("amount") * F.lit(INCOME_VAT_RATE).cast("decimal(3,2)")))
     .withColumn("grand_total", to_money(F.col("amount") + F.col("vat"))))
    return df


def income_ledger(spark: SparkSession, sf_dir: str, with_audit: bool = True, lines: DataFrame | None = None) -> DataFrame:
    df = lines if lines is not None else income_lines(spark, sf_dir)
    ts = F.lit(SNAPSHOT_CREATED).cast("timestamp_ntz")
    df = (df.withColumn("created_at", ts if with_audit else F.lit(None).cast("timestamp_ntz"))
            .withColumn("updated_at", ts if with_audit else F.lit(None).cast("timestamp_ntz"))
            .withColumn("created_by", F.lit(None).cast("string"))
            .withColumn("notes", F.lit(None).cast("string")))
    return df.select(*S.column_names(S.INCOME_SCHEMA))


def expense_source(spark: SparkSession, sf_dir: str, dealt: Dealt | None = None) -> DataFrame:
    """lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    geo = _region_of_nation(spark, sf_dir)
    if dealt is not None:
        held = dealt.join(dealt.join(li, part, "l_partkey", "p_partkey"), supp, "l_suppkey", "s_suppkey")
        return held.join(geo, F.col("s_nationkey") == geo.n_nationkey)
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(supp, F.col("l_suppkey") == supp.s_suppkey)
              .join(geo, F.col("s_nationkey") == geo.n_nationkey))


def dealt_expense_source(spark: SparkSession, sf_dir: str, dealt: Dealt) -> DataFrame:
    """``expense_source`` as a table dealt by order, so that the lines of an
    order are numbered, and the last of each row_id is found, without an exchange."""
    src = expense_source(spark, sf_dir, dealt).drop("p_partkey", "s_suppkey", "s_nationkey", "n_nationkey")
    src = dealt.write(src, "l_orderkey", "source")
    dealt.drop("l_partkey", "p_partkey", "l_suppkey", "s_suppkey")
    return src


def _expense_columns(recurring: tuple[str, ...]) -> list[Column]:
    amount = to_money(_dec(F.col("l_extendedprice")) * (F.lit(1) - _dec(F.col("l_discount"), 4, 2)))
    sub = F.when((F.col("p_type") == "PROMO") | (F.col("p_size") % 7 == 0), F.lit(None).cast("string")) \
           .otherwise(F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")))
    rec = F.col("p_type").isin(*recurring)
    return [
        F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("BILL-"), F.col("l_orderkey")).alias("doc_no"),
        F.col("l_shipdate").cast("date").alias("doc_date"),
        F.date_add(F.col("l_shipdate").cast("date"), 30).alias("overdue_date"),
        F.col("s_name").alias("supplier"),
        F.lit(S.DEFAULT_CURRENCY).alias("currency"),
        amount.alias("amount"),
        to_money(amount * _dec(F.col("l_tax"), 4, 2)).alias("vat"),
        _map(F.col("l_linestatus"), EXPENSE_STATUS).alias("status"),
        _map(F.col("l_returnflag"), EXPENSE_TYPE).alias("type"),
        F.col("r_location").alias("location"),
        F.col("p_type").alias("category"),
        sub.alias("subcategory"),
        F.concat_ws(S.CATEGORY_KEY_SEP, F.col("p_type"), sub).alias("category_key"),
        rec.alias("is_recurring"),
        F.when(rec, F.lit(S.RECURRENCE_PERIOD)).alias("recurrence_period"),
    ]


def expense_lines(spark: SparkSession, sf_dir: str, recurring: tuple[str, ...] = TEST_RECURRING) -> DataFrame:
    """Every expense line (row_id repeats kept), with category text columns."""
    df = expense_source(spark, sf_dir).select(*_expense_columns(recurring))
    return df.withColumn("grand_total", to_money(F.col("amount") + F.col("vat")))


def expense_ledger(spark: SparkSession, sf_dir: str, recurring: tuple[str, ...] = TEST_RECURRING) -> DataFrame:
    """Typed expense ledger over every line (reports use all lines)."""
    ts = F.lit(SNAPSHOT_CREATED).cast("timestamp_ntz")
    df = (expense_lines(spark, sf_dir, recurring)
          .withColumn("subcategory_free", F.lit(None).cast("string"))
          .withColumn("forecasted_until", F.lit(None).cast("date"))
          .withColumn("created_at", ts).withColumn("updated_at", ts)
          .withColumn("created_by", F.lit(None).cast("string"))
          .withColumn("notes", F.lit(None).cast("string")))
    return df.select(*S.column_names(S.EXPENSE_SCHEMA))


def category_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-level category dimension of the part catalog: parents keyed by
    name, children keyed by parent + separator + name. It may hold categories
    no line uses (as a long-lived dimension does); reports reach it with an
    inner join from the aggregated ledger side, so unused entries change nothing.
    """
    from ..operators.categories import build_dimension
    part = read_table(spark, sf_dir, "part").select("p_type", "p_brand", "p_size")
    lines = part.select(
        F.col("p_type").alias("category"),
        F.when((F.col("p_type") == "PROMO") | (F.col("p_size") % 7 == 0), F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"))).alias("subcategory"))
    return build_dimension(lines)


def parent_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior dimension holding only the parents (children get created by the sync)."""
    return category_dimension(spark, sf_dir).filter(F.col("parent_key").isNull())


# ---------------------------------------------------------------------------
# Sync fixtures: raw text batches and prior snapshots
# ---------------------------------------------------------------------------

def _text_money(c: Column) -> Column:
    return F.format_number(c, 2)


def _text_date(c: Column, k: Column) -> Column:
    """A date as exports spell it: six day-first and ISO forms by key."""
    forms = ["dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy 10:05", " d MMM yyyy "]
    out = None
    for i, form in enumerate(forms):
        text = F.concat(F.date_format(c, "dd/MM/yyyy"), F.lit(" 10:05")) if "10:05" in form else F.date_format(c, form)
        out = F.when(k % 6 == i, text) if out is None else out.when(k % 6 == i, text)
    return out


def _text_row_id(c: Column, k: Column) -> Column:
    """Blank or padded by key."""
    return F.when(k % 97 == 0, F.lit("")).when(k % 23 == 0, F.concat(F.lit("  "), c, F.lit("\t"))).otherwise(c)


def _text_location(k: Column) -> Column:
    """Mixed case and punctuation by key."""
    return F.when(k % 31 == 0, F.concat(F.lower("r_name"), F.lit("-2a o'neil"))).otherwise(F.col("r_name"))


def _text_amount(k: Column) -> Column:
    """With a fraction of a cent (below the change tolerance) by key."""
    text = _text_money(F.col("amount"))
    return F.when(k % 47 == 0, F.concat(text, F.lit("04"))).otherwise(text)


def _text_vat(k: Column) -> Column:
    return F.when(k % 13 == 0, F.lit("")).when(k % 29 == 0, F.lit("n/a")).otherwise(_text_money(F.col("vat")))


def _text_grand_total(k: Column) -> Column:
    return (F.when(k % 17 == 0, F.lit("")).when(k % 37 == 0, F.lit("see note"))
            .otherwise(_text_money(F.col("grand_total"))))


def raw_income_batch(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Income ledger rendered as export text; blanks, padding, date forms and
    junk cells by key arithmetic."""
    df = lines if lines is not None else income_lines(spark, sf_dir)
    k = F.col("_key")
    return df.select(
        k.alias("_pos"),
        _text_row_id(F.col("row_id"), k).alias("row_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("doc_no")).alias("doc_no"),
        _text_date(F.col("doc_date"), k).alias("doc_date"),
        F.col("customer"),
        F.col("currency"),
        _text_amount(k).alias("amount"),
        _text_vat(k).alias("vat"),
        _text_grand_total(k).alias("grand_total"),
        F.when(k % 3 == 0, F.lower(F.col("status"))).otherwise(F.col("status")).alias("status"),
        _text_location(k).alias("location"),
    )


def income_snapshot(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Prior income snapshot: keys % 5 = 0 missing (inserts), amount + 1.00
    where key % 7 = 0 (updates)."""
    led = income_ledger(spark, sf_dir, lines=lines)
    k = F.col("row_id").cast("long")
    return (led.filter(k % 5 != 0)
            .withColumn("amount", F.when(k % 7 == 0, to_money(F.col("amount") + F.lit(1))).otherwise(F.col("amount"))))


def expense_batch_lines(spark: SparkSession, sf_dir: str, src: DataFrame | None = None) -> DataFrame:
    """Expense lines in export order (``_pos``), the common input of the raw
    expense batch and the prior expense snapshot. The position is the order key
    times 1000 plus the line's number within its order, so no pass over the
    whole table is needed to number it. ``src`` is a dealt ``expense_source``."""
    src = src if src is not None else expense_source(spark, sf_dir)
    cols = _expense_columns(TEST_RECURRING) + [
        F.col("l_orderkey").alias("_key"), F.col("r_name"), F.col("p_size"),
        F.col("l_linenumber"), F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_extendedprice"), F.col("l_quantity")]
    df = src.select(*cols).withColumn("grand_total", to_money(F.col("amount") + F.col("vat")))
    return df.withColumn("_pos", (F.col("_key") * 1000 + F.row_number().over(_in_order())).cast("long"))


def _in_order() -> WindowSpec:
    return Window.partitionBy("_key").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
                                              "l_extendedprice", "l_quantity")


def raw_expense_batch(spark: SparkSession, sf_dir: str, dirty: bool = False,
                      lines: DataFrame | None = None) -> DataFrame:
    """Expense lines rendered as export text; row_id repeats kept, `_pos` is
    the export order. Blank doc_date where key % 19 = 0 and an impossible one
    where % 41 = 0 (both take the as-of date); blank category where % 43 = 0;
    one position for all lines of an order where % 59 = 0.
    ``dirty`` adds rows that break constraints (for the reject check):
    unknown status (% 101), lower-case type (% 103), missing location (% 107),
    amounts too large for DECIMAL(12,2) (% 109), for 18 (% 127) and for 38
    digits (% 131), no position (% 113), rows that could not be read (% 137). ``lines`` reuses already numbered
    lines (see ``expense_batch_lines``)."""
    df = lines if lines is not None else expense_batch_lines(spark, sf_dir)
    k = F.col("_key")
    out = df.select(
        F.when(k % 59 == 0, k * 1000).otherwise(F.col("_pos")).alias("_pos"),
        _text_row_id(F.col("row_id"), k).alias("row_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("doc_no")).alias("doc_no"),
        F.when(k % 19 == 0, F.lit("")).when(k % 41 == 0, F.lit("31/02/1997"))
         .otherwise(_text_date(F.col("doc_date"), k)).alias("doc_date"),
        _text_date(F.col("overdue_date"), k).alias("overdue_date"),
        F.col("supplier"),
        F.col("currency"),
        _text_amount(k).alias("amount"),
        _text_vat(k).alias("vat"),
        _text_grand_total(k).alias("grand_total"),
        F.when(k % 3 == 0, F.upper(F.col("status"))).otherwise(F.col("status")).alias("status"),
        F.col("type"),
        _text_location(k).alias("location"),
        F.when(k % 43 == 0, F.lit("")).when(k % 53 == 0, F.concat(F.lit(" "), F.col("category"), F.lit(" ")))
         .otherwise(F.col("category")).alias("category"),
        F.when(F.col("p_size") % 7 == 0, F.lit(" NaN ")).otherwise(F.col("subcategory")).alias("subcategory"),
        k.alias("_key"),
    )
    if dirty:
        out = (out.withColumn("status", F.when(k % 101 == 0, F.lit("bogus")).otherwise(F.col("status")))
                  .withColumn("type", F.when(k % 103 == 0, F.lower(F.col("type"))).otherwise(F.col("type")))
                  .withColumn("location", F.when(k % 107 == 0, F.lit(None).cast("string")).otherwise(F.col("location")))
                  .withColumn("amount", F.when(k % 109 == 0, F.lit("12,345,678,901.00"))
                              .when(k % 127 == 0, F.lit("12345678901234567890.00"))
                              .when(k % 131 == 0, F.lit("9" * 40)).otherwise(F.col("amount")))
                  .withColumn("_pos", F.when(k % 113 != 0, F.col("_pos"))))
        broken = k % 137 == 0
        out = out.select(*[F.when(~broken, F.col(c)).alias(c) for c in out.columns if c != "_key"],
                         F.when(broken, F.lit("cut")).alias(S.CORRUPT), "_key")
    return out.drop("_key")


def income_csv_lines(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Header and lines of the income export as CSV; a cell past the header
    where keys % 61 = 0."""
    raw = raw_income_batch(spark, sf_dir)
    style = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*raw.columns), style)
    return ",".join(raw.columns), raw.select(
        F.when(F.col("_pos") % 61 == 0, F.concat(line, F.lit(",one more"))).otherwise(line).alias("line"))


def expense_json_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Lines of the expense export as JSON; cut short where keys % 67 = 0."""
    raw = raw_expense_batch(spark, sf_dir, lines=lines)
    line = F.to_json(F.struct(*raw.columns))
    cut = F.floor(F.col("_pos") / 1000) % 67 == 0
    return raw.select(F.when(cut, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("line"))


def expense_snapshot(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Prior expense snapshot: one row per row_id (the last export line),
    keys % 5 = 0 missing, amount + 1.00 where key % 7 = 0."""
    df = lines if lines is not None else expense_batch_lines(spark, sf_dir)
    last = (df.groupBy("row_id")
              .agg(F.max_by(F.struct(*[c for c in df.columns if c != "row_id"]), F.col("_pos")).alias("r"))
              .select("row_id", "r.*"))
    return _prior_expenses(last)


def dealt_expense_snapshot(spark: SparkSession, sf_dir: str, src: DataFrame) -> DataFrame:
    """``expense_snapshot`` of a dealt source, without an exchange: a row_id is an
    order key and a line number. Lines without a number share the null row_id
    over all orders; they are numbered first in their order, so they alone are read for it."""
    lines = expense_batch_lines(spark, sf_dir, src)
    following = lines.withColumn("_next", F.lead("l_linenumber").over(_in_order()))
    last = following.filter("l_linenumber <> _next OR l_linenumber IS NOT NULL AND _next IS NULL").drop("_next")
    none = expense_batch_lines(spark, sf_dir, src.filter("l_orderkey IS NOT NULL AND l_linenumber IS NULL"))
    none = none.agg(F.max_by(F.struct(*none.columns), F.col("_pos")).alias("r")).select("r.*")
    return _prior_expenses(last.filter("_key IS NOT NULL").unionByName(none))


def _prior_expenses(last: DataFrame) -> DataFrame:
    k = F.col("_key")
    ts = F.lit(SNAPSHOT_CREATED).cast("timestamp_ntz")
    out = (last.filter(k % 5 != 0)
           .withColumn("amount", F.when(k % 7 == 0, to_money(F.col("amount") + F.lit(1))).otherwise(F.col("amount")))
           .withColumn("subcategory_free", F.lit(None).cast("string"))
           .withColumn("forecasted_until", F.lit(None).cast("date"))
           .withColumn("created_at", ts).withColumn("updated_at", ts)
           .withColumn("created_by", F.lit(None).cast("string"))
           .withColumn("notes", F.lit(None).cast("string")))
    return out.select(*S.column_names(S.EXPENSE_SCHEMA))


def pending_investments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending investments from part, with some defaults left to fill."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = _dec(F.col("p_retailprice"), 14, 2)
    return part.select(
        F.concat(F.lit("CAPEX-"), k).alias("ref_code"),
        F.col("p_name").alias("description"),
        F.lit(None).cast("string").alias("detailed_notes"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("THB")).alias("currency"),
        F.round(price * F.col("p_size"), 2).cast(S.MONEY_WIDE).alias("estimated_cost"),
        F.when(k % 10 == 0, F.lit(None).cast(S.MONEY_WIDE))
         .otherwise(F.round(price * (F.col("p_size") % 10), 2).cast(S.MONEY_WIDE)).alias("committed_amount"),
        F.lit(None).cast("string").alias("funding_source"),
        F.lit(None).cast("date").alias("target_start_date"),
        F.lit(None).cast("date").alias("expected_completion_date"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("High")).alias("priority"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.lit("Approved")).alias("status"),
        F.col("p_brand").alias("location"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("string").alias("created_by"),
    )


@dataclass
class Ledgers:
    """The derived ledgers of one scale-factor folder."""
    income: DataFrame
    expenses: DataFrame
    categories: DataFrame


def ledgers(spark: SparkSession, sf_dir: str) -> Ledgers:
    return Ledgers(income_ledger(spark, sf_dir), expense_ledger(spark, sf_dir), category_dimension(spark, sf_dir))
