"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

_TIME = r"[ T]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$"
_DAY_FIRST = r"^([0-9]{1,2})[-./]([0-9]{1,2})[-./]([0-9]{4})\z"
_YEAR_FIRST = r"^([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})\z"
_MONTH_NAMED = r"^[0-9]+ [^0-9 ]+ [+-]?[0-9]+\z"
_OTHER_DIGITS = r"^[+]?[0-9]+[-./][0-9]+[-./][+]?[0-9]+\z"


def _without_time(c: Column) -> Column:
    return F.regexp_replace(py_strip(c), _TIME, "")


def _read_day(day: Column) -> Column:
    """The date of a text without time. A pattern is tried only on text of its
    form: one that does not fit costs an exception per row inside Spark."""
    marks = F.translate(day, "-.", "//")
    return (F.when(day.rlike(_DAY_FIRST), F.regexp_replace(day, _DAY_FIRST, "$3-$2-$1").try_cast("date"))
            .when(day.rlike(_YEAR_FIRST), F.regexp_replace(day, _YEAR_FIRST, "$1-$2-$3").try_cast("date"))
            .when(day.rlike(_MONTH_NAMED), F.try_to_date(day, "d MMM yyyy"))
            .when(day.rlike(_OTHER_DIGITS), F.coalesce(F.try_to_date(marks, "d/M/yyyy"), F.try_to_date(marks, "yyyy/M/d"))))


def parse_days_first(cells: list[Column]) -> Column:
    """``parse_day_first`` of several cells, as one array. The rule is one small
    function that Spark calls per cell; written out per column it makes the
    generated method of a stage too long for the JVM to compile."""
    return F.transform(F.array(*[_without_time(c) for c in cells]), _read_day)


def parse_day_first(c: Column) -> Column:
    """Day-first date text: trimmed, an optional time dropped, then day, month
    and four-digit year (or year, month, day) with ``/``, ``-`` or ``.``, or
    ``d Mon yyyy``. Anything else (month-first, two-digit years, impossible
    days) is null.
    """
    return parse_days_first([c])[0]


def period_start(c: Column) -> Column:
    """First day of the month of a date."""
    return F.trunc(c, "MM")


def month_label(c: Column) -> Column:
    """``mmm-yy`` lower case, e.g. ``nov-96``."""
    return F.lower(F.date_format(c, "MMM-yy"))
