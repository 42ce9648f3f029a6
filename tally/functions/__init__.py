"""Column expressions (JVM-side, codegen-friendly) used by the operators."""

from .dates import month_label, parse_day_first, parse_days_first, period_start
from .money import parse_money, parse_monies, to_money, to_report_double
from .text import is_blank, py_strip, py_title

__all__ = [
    "is_blank", "month_label", "parse_day_first", "parse_days_first", "parse_money", "parse_monies",
    "period_start", "py_strip", "py_title", "to_money", "to_report_double",
]
