"""Money expressions: exact decimals inside, double only at the output edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Holds every text that a decimal can be read from.
_MAYBE_DECIMAL = r"^[\x00-\x20]*[+-]?[\p{Nd}.]+([eE][+-]?\p{Nd}+)?[\x00-\x20]*$"


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def is_number(c: Column) -> Column:
    """True when the text, without its ``,``, is a number of any size."""
    return F.coalesce(_bare(c).rlike(_NUMBER), F.lit(False))


def _read_money(bare: Column) -> Column:
    # Text that no decimal can be read from is not tried: each failure costs an
    # exception inside Spark.
    parsed = bare.try_cast(S.MONEY_PARSE)
    return F.when(bare.rlike(_MAYBE_DECIMAL), F.coalesce(parsed, F.when(
        bare.rlike(_NUMBER), F.lit(S.MONEY_BEYOND).cast(S.MONEY_PARSE))))


def parse_monies(cells: list[Column]) -> Column:
    """``parse_money`` of several cells, as one array (see ``parse_days_first``)."""
    return F.transform(F.array(*[_bare(c) for c in cells]), _read_money)


def parse_money(c: Column) -> Column:
    """Remove every ``,`` and parse; junk or empty text is null.

    A number of any width keeps a value that the range check can see: one
    beyond DECIMAL(38,2) becomes ``MONEY_BEYOND`` (which never fits).
    """
    return parse_monies([c])[0]


def fits_money(c: Column) -> Column:
    """True when a parsed value fits the stored DECIMAL(12,2)."""
    return c.isNull() | (F.abs(c) < F.lit(10 ** 10))


def to_money(c: Column) -> Column:
    """Round to cents and store as DECIMAL(12,2)."""
    return F.round(c, 2).cast(S.MONEY)


def to_report_double(c: Column) -> Column:
    """Exact decimal result to double, the report output type."""
    return c.cast("double")
