"""Driver-side parameter parsing and checks.

These run before any plan is built; a bad parameter raises ``ValueError``
and no Spark job starts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from . import schemas as S


def parse_ddmmyyyy(text: str | None) -> dt.date | None:
    """Strict ``DD/MM/YYYY``; ``None`` passes through."""
    if text is None:
        return None
    try:
        return dt.datetime.strptime(text, "%d/%m/%Y").date()
    except (TypeError, ValueError) as exc:
        raise ValueError(f"Invalid date format: {text!r}. Expected DD/MM/YYYY") from exc


def as_date(value: str | dt.date | None) -> dt.date | None:
    """Accept a date, an ISO string or a DD/MM/YYYY string."""
    if value is None or isinstance(value, dt.date):
        return value
    if "/" in value:
        return parse_ddmmyyyy(value)
    return dt.date.fromisoformat(value)


def month_difference(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + (end.month - start.month)


def check_range(start: dt.date, end: dt.date) -> None:
    if start > end:
        raise ValueError("start_date cannot be after end_date")
    diff = month_difference(start, end)
    if diff > S.MAX_MONTH_DIFFERENCE:
        raise ValueError(
            f"Date range cannot exceed {S.MAX_MONTH_DIFFERENCE} months (difference {diff})"
        )


def check_format(fmt: str) -> None:
    if fmt not in S.REPORT_FORMATS:
        raise ValueError("Invalid format. Must be 'yearly' or 'monthly'")


def location_filter(location: str | None) -> str | None:
    """Reports treat ``All`` (and an absent or empty name) as no filter."""
    return None if not location or location == S.ALL_LOCATIONS else location


@dataclass(frozen=True)
class ReportParams:
    start: dt.date
    end: dt.date
    fmt: str = "yearly"
    location: str | None = None

    @classmethod
    def of(cls, start, end, fmt: str = "yearly", location: str | None = None) -> "ReportParams":
        s, e = as_date(start), as_date(end)
        check_range(s, e)
        check_format(fmt)
        return cls(s, e, fmt, location)

    @property
    def location_filter(self) -> str | None:
        return location_filter(self.location)

    @property
    def location_label(self) -> str:
        return self.location or S.ALL_LOCATIONS

    def period_labels(self) -> list[str]:
        """Period labels in report order (driver side, at most 13 entries)."""
        if self.fmt == "yearly":
            return [S.YEARLY_LABEL]
        out, cur = [], self.start.replace(day=1)
        last = self.end.replace(day=1)
        while cur <= last:
            out.append(cur.strftime("%b-%y").lower())
            cur = (cur.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        return out
