"""Report periods: index, label, per-period sums with zero fill.

A report has at most 13 periods (``params.check_range``). Each ledger row
gets a ``period_idx`` from its date; one hash aggregate per line key builds
an array of the period sums (partial aggregation runs map-side, so a hot key
is combined before the shuffle), and ``posexplode`` turns it into long rows.
Every (line, period) pair is then present with 0 where no row fell, without
a spine join or a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import month_label
from ..params import ReportParams

LONG_COLUMNS = ("section", "item", "subitem", "kind", "period_idx", "period", "amount")


# Report expressions are written as SQL expression text: one JVM parse per
# expression instead of one driver→JVM call per expression node (a 13-period
# report builds hundreds of nodes), which keeps plan building fast.

def period_index_sql(params: ReportParams, date_col: str = "doc_date") -> str:
    """0-based period of a date already inside the report range."""
    if params.fmt == "yearly":
        return "0"
    return f"((year({date_col}) - {params.start.year}) * 12 + (month({date_col}) - {params.start.month}))"


def period_label_sql(params: ReportParams, idx: str = "period_idx") -> str:
    if params.fmt == "yearly":
        return f"'{S.YEARLY_LABEL}'"
    return f"lower(date_format(add_months(DATE '{params.start.replace(day=1).isoformat()}', {idx}), 'MMM-yy'))"


def period_label(params: ReportParams, idx: Column) -> Column:
    if params.fmt == "yearly":
        return F.lit(S.YEARLY_LABEL)
    first = F.lit(params.start.replace(day=1))
    return month_label(F.add_months(first, idx))


def n_periods(params: ReportParams) -> int:
    return len(params.period_labels())


def month_partition_predicate(df: DataFrame, start, end):
    """On a month-partitioned snapshot, the same range on ``doc_month`` so
    the scan lists and reads only the months in range (Catalyst does not
    derive a partition filter from a ``doc_date`` filter). None otherwise."""
    if "doc_month" not in df.columns:
        return None
    conds = []
    if start is not None:
        conds.append(F.col("doc_month") >= F.lit(start.replace(day=1)))
    if end is not None:
        conds.append(F.col("doc_month") <= F.lit(end.replace(day=1)))
    return _and(conds)


def _and(conds):
    out = None
    for c in conds:
        out = c if out is None else (out & c)
    return out


def month_partition_filter(df: DataFrame, start, end) -> DataFrame:
    pred = month_partition_predicate(df, start, end)
    return df if pred is None else df.filter(pred)


def range_predicate(df: DataFrame, params: ReportParams, date_col: str = "doc_date") -> Column:
    """Inclusive date range (+ month partitions) and optional exact location."""
    conds = [month_partition_predicate(df, params.start, params.end),
             F.col(date_col).between(F.lit(params.start), F.lit(params.end))]
    if params.location_filter is not None:
        conds.append(F.col("location") == F.lit(params.location_filter))
    return _and([c for c in conds if c is not None])


def range_filter(df: DataFrame, params: ReportParams, date_col: str = "doc_date") -> DataFrame:
    """Inclusive date range and optional exact location (one filter)."""
    return df.filter(range_predicate(df, params, date_col))


def period_sums(df: DataFrame, keys: list[str], measure: str, params: ReportParams) -> DataFrame:
    """``keys`` + ``amounts``: array of exact per-period sums, 0 where empty.

    One hash aggregate; ``period_idx`` is computed in the same projection as
    the scan so the whole step stays in one codegen stage.
    """
    n = n_periods(params)
    idx = period_index_sql(params)
    zero = "CAST(0 AS DECIMAL(12,2))"
    if n == 1:
        sums = [f"coalesce(sum(`{measure}`), {zero})"]
    else:
        sums = [f"coalesce(sum(CASE WHEN {idx} = {i} THEN `{measure}` END), {zero})" for i in range(n)]
    return df.groupBy(*keys).agg(F.expr(f"array({', '.join(sums)})").alias("amounts"))


def explode_periods(df: DataFrame, params: ReportParams, keep: list[str]) -> DataFrame:
    """Array of period sums → one row per period (labels are added at the
    output edge by ``to_long``)."""
    return df.select(*keep, F.posexplode("amounts").alias("period_idx", "amount"))


def zero_rows(spark, sections: list[str], params: ReportParams) -> DataFrame:
    """(section, period_idx, amount=0) for every section and period: a
    parameter-sized frame (≤ 13 × sections rows) that guarantees every total
    exists even when no ledger row falls in the range."""
    n = n_periods(params)
    names = ", ".join(f"'{s}'" for s in sections)
    return spark.range(n).selectExpr(f"explode(array({names})) AS section", "CAST(id AS INT) AS period_idx",
                                     "CAST(0 AS DECIMAL(12,2)) AS amount")


def to_long(df: DataFrame, params: ReportParams) -> DataFrame:
    """Final long form: labels added, amounts as double at the output edge."""
    return df.selectExpr("section", "item", "subitem", "kind", "CAST(period_idx AS INT) AS period_idx",
                         f"{period_label_sql(params)} AS period", "CAST(amount AS DOUBLE) AS amount")
