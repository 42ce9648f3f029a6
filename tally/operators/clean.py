"""Cleaning and conforming raw export rows.

A raw batch has text columns named by the export header plus ``_pos`` (its
order). Cleaning is a few projections in one stage, with no shuffle: every
rule is a built-in column expression. The date and money cells of a row are
read as two arrays (``_days``, ``_money``), once for all that use them.
Rows that break a constraint keep their values and get reasons in
``_reasons``; the publish step refuses a batch with any. Cells that hold text
no rule can read (and so take a default) are named in ``_junk``; the publish
step counts and reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import is_blank, parse_days_first, parse_monies, py_strip, py_title, to_money
from ..functions.money import fits_money, is_number
from .categories import category_key


def _col(raw: DataFrame, name: str, default: str | None = None) -> Column:
    """A column missing from the export takes its default (decided at
    plan-build time); a null cell in a present column does not."""
    if name in raw.columns:
        return F.col(name)
    return F.lit(default).cast("string")


def gate_row_id(raw: DataFrame) -> DataFrame:
    """Skip rows whose row_id is null or blank; strip the rest. A malformed
    row passes, without a row_id, so that it ends as a reject."""
    rid, broken = _col(raw, "row_id"), malformed(raw)
    return raw.filter(broken | ~is_blank(rid)).withColumn("row_id", F.when(~broken, py_strip(rid)))


def malformed(raw: DataFrame) -> Column:
    """A1: the reader could not take the row apart as the header says."""
    return _col(raw, S.CORRUPT).isNotNull()


def doc_no_default(raw: DataFrame) -> Column:
    """Blank doc_no → ``AUTO-<row_id>``; a given value is kept as is."""
    d = _col(raw, "doc_no")
    return F.when(is_blank(d), F.concat(F.lit(S.AUTO_DOC_PREFIX), F.col("row_id"))).otherwise(d)


def normalize_status(c: Column) -> Column:
    """Upper-cased name lookup; unknown or null → null (then rejected)."""
    values = F.create_map(*[F.lit(text) for pair in S.STATUS_VALUES.items() for text in pair])
    return F.try_element_at(values, F.upper(c))


def normalize_category(c: Column) -> Column:
    """Null or empty → ``Uncategorized``; otherwise stripped."""
    return F.when(c.isNull() | (c == ""), F.lit(S.DEFAULT_CATEGORY)).otherwise(py_strip(c))


def normalize_subcategory(c: Column) -> Column:
    """Stripped; null, blank or the text ``nan`` (any case) → none."""
    s = py_strip(c)
    return F.when(c.isNull() | (s == "") | (F.lower(s) == "nan"), F.lit(None).cast("string")).otherwise(s)


def recurring_flag(category_raw: Column, names: tuple[str, ...] = S.RECURRING_CATEGORIES) -> Column:
    """The stripped raw category is one of the recurring names."""
    return F.coalesce(py_strip(category_raw).isin(*names), F.lit(False))


def _parsed(gated: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    """The rows with their date and money cells read, as ``_days`` and ``_money``."""
    return gated.withColumns({"_days": parse_days_first([_col(gated, c) for c in dates]),
                              "_money": parse_monies([_col(gated, c) for c in S.MONEY_FIELDS])})


def _money_columns() -> dict[str, Column]:
    """Parse, default to 0, fall back to amount + vat."""
    zero = F.lit(0).cast(S.MONEY_PARSE)
    amount, vat, grand_total = (F.col("_money")[S.MONEY_FIELDS.index(c)] for c in ("amount", "vat", "grand_total"))
    amount, vat = F.coalesce(amount, zero), F.coalesce(vat, zero)
    both = F.coalesce(F.try_add(amount, vat), F.lit(S.MONEY_BEYOND)).cast(S.MONEY_PARSE)
    return {"amount": amount, "vat": vat, "grand_total": F.coalesce(grand_total, both)}


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    """Comma-joined reasons, empty when the row is clean (``concat_ws`` skips
    the nulls of checks that pass)."""
    return F.concat_ws(",", *[F.when(cond, F.lit(reason)) for cond, reason in checks])


def _row_reasons(checks: list[tuple[Column, str]]) -> Column:
    """The same; of a malformed row nothing else is judged."""
    return F.when(F.col("_broken"), F.lit(S.MALFORMED)).otherwise(_reasons(checks))


def _junk(raw: DataFrame, dates: tuple[str, ...]) -> Column:
    """Comma-joined names of the cells that are not blank and cannot be read."""
    cells = [(F.coalesce(~is_blank(_col(raw, c)), F.lit(False)) & F.col("_days")[i].isNull(), c) for i, c in enumerate(dates)]
    cells += [(F.coalesce(~is_blank(_col(raw, c)), F.lit(False)) & ~is_number(_col(raw, c)), c) for c in S.MONEY_FIELDS]
    return _reasons(cells)


def _money_checks(cols: list[str]) -> list[tuple[Column, str]]:
    return [(~fits_money(F.col(f"_{c}")), f"{c}_out_of_range") for c in cols]


def clean_income(raw: DataFrame) -> DataFrame:
    """Raw income rows → typed income rows + ``_pos`` + ``_reasons``."""
    dates = ("doc_date",)
    gated = _parsed(gate_row_id(raw), dates)
    money = _money_columns()
    df = gated.select(
        F.col("_pos"), F.col("row_id"),
        doc_no_default(gated).alias("doc_no"),
        F.col("_days")[0].alias("doc_date"),
        _col(gated, "customer", S.DEFAULT_PARTY).alias("customer"),
        _col(gated, "currency", S.DEFAULT_CURRENCY).alias("currency"),
        money["amount"].alias("_amount"), money["vat"].alias("_vat"), money["grand_total"].alias("_grand_total"),
        normalize_status(_col(gated, "status")).alias("status"),
        py_title(_col(gated, "location", S.DEFAULT_LOCATION)).alias("location"),
        _junk(gated, dates).alias("_junk"), malformed(gated).alias("_broken"),
    )
    checks = [
        (F.col("_pos").isNull(), "pos_missing"),
        (F.col("status").isNull(), "status_unknown"),
        (F.col("location").isNull(), "location_missing"),
        (F.col("customer").isNull(), "customer_missing"),
        (F.col("currency").isNull(), "currency_missing"),
        (F.col("doc_date").isNull(), "doc_date_missing"),
    ] + _money_checks(list(S.MONEY_FIELDS))
    df = df.withColumn("_reasons", _row_reasons(checks))
    return df.select(
        "_pos", "row_id", "doc_no", "doc_date", "customer", "currency",
        *[F.when(fits_money(F.col(f"_{c}")), to_money(F.col(f"_{c}"))).alias(c) for c in S.MONEY_FIELDS],
        "status", "location", "_reasons", "_junk")


def clean_expenses(raw: DataFrame, as_of_date: str,
                   recurring: tuple[str, ...] = S.RECURRING_CATEGORIES) -> DataFrame:
    """Raw expense rows → typed expense rows + category text + ``_pos`` +
    ``_reasons``. ``as_of_date`` replaces the clock for a missing doc_date."""
    dates = ("doc_date", "overdue_date")
    gated = _parsed(gate_row_id(raw), dates)
    money = _money_columns()
    cat_raw = _col(gated, "category")
    category = normalize_category(cat_raw)
    sub = normalize_subcategory(_col(gated, "subcategory"))
    rec = recurring_flag(cat_raw, recurring)
    typ = _col(gated, "type")
    df = gated.select(
        F.col("_pos"), F.col("row_id"),
        doc_no_default(gated).alias("doc_no"),
        F.coalesce(F.col("_days")[0], F.lit(as_of_date).cast("date")).alias("doc_date"),
        F.col("_days")[1].alias("overdue_date"),
        _col(gated, "supplier", S.DEFAULT_PARTY).alias("supplier"),
        _col(gated, "currency", S.DEFAULT_CURRENCY).alias("currency"),
        money["amount"].alias("_amount"), money["vat"].alias("_vat"), money["grand_total"].alias("_grand_total"),
        normalize_status(_col(gated, "status")).alias("status"),
        F.when(typ.isin(*S.EXPENSE_TYPES), typ).alias("type"),
        py_title(_col(gated, "location", S.DEFAULT_LOCATION)).alias("location"),
        category.alias("category"), sub.alias("subcategory"),
        category_key(category, sub).alias("category_key"),
        rec.alias("is_recurring"),
        F.when(rec, F.lit(S.RECURRENCE_PERIOD)).alias("recurrence_period"),
        _junk(gated, dates).alias("_junk"), malformed(gated).alias("_broken"),
    )
    checks = [
        (F.col("_pos").isNull(), "pos_missing"),
        (F.col("status").isNull(), "status_unknown"),
        (F.col("type").isNull(), "type_unknown"),
        (F.col("location").isNull(), "location_missing"),
        (F.col("supplier").isNull(), "supplier_missing"),
        (F.col("currency").isNull(), "currency_missing"),
    ] + _money_checks(list(S.MONEY_FIELDS))
    df = df.withColumn("_reasons", _row_reasons(checks))
    return df.select(
        "_pos", "row_id", "doc_no", "doc_date", "overdue_date", "supplier", "currency",
        *[F.when(fits_money(F.col(f"_{c}")), to_money(F.col(f"_{c}"))).alias(c) for c in S.MONEY_FIELDS],
        "status", "type", "location", "category", "subcategory", "category_key", "is_recurring",
        "recurrence_period", "_reasons", "_junk")


def batch_columns(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows without the columns that only describe the cleaning."""
    return cleaned.drop("_reasons", "_junk")


def rejects(cleaned: DataFrame) -> DataFrame:
    """Rows with at least one reason, reasons as comma-joined text."""
    return cleaned.filter(F.col("_reasons") != "").select("_pos", "row_id", F.col("_reasons").alias("reasons"))
