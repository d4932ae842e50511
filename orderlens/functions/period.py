"""Period bounds and zone-free timestamp literals.

Bounds are plain ``datetime`` values computed on the driver from an explicit
``as_of`` (never the wall clock), then handed to Catalyst as
``TIMESTAMP_NTZ`` literals so they fold into the scan's pushed filters.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The period names and their meaning, all bounds inclusive.
PERIODS = ("today", "yesterday", "week", "month", "last_month", "all")

# Bucket of the orders timeline for each period (hour / day / month).
TIMELINE_UNIT = {
    "today": "hour",
    "yesterday": "day",
    "week": "day",
    "month": "day",
    "last_month": "day",
    "all": "month",
}

EPOCH_MIN = datetime.min  # 0001-01-01 00:00:00, the start of "all time"


def _midnight(d: datetime) -> datetime:
    return d.replace(hour=0, minute=0, second=0, microsecond=0)


def period_bounds(period: str, as_of: datetime) -> tuple[datetime, datetime]:
    """Inclusive ``(start, end)`` of a named period as seen at ``as_of``.

    Any name other than the five known ones means all time up to ``as_of``.
    """
    if period == "today":
        return _midnight(as_of), as_of
    if period == "yesterday":
        day = as_of - timedelta(days=1)
        return _midnight(day), day.replace(hour=23, minute=59, second=59, microsecond=999999)
    if period == "week":
        return as_of - timedelta(days=7), as_of
    if period == "month":
        return _midnight(as_of.replace(day=1)), as_of
    if period == "last_month":
        last_day = as_of.replace(day=1) - timedelta(days=1)
        return (_midnight(last_day.replace(day=1)),
                last_day.replace(hour=23, minute=59, second=59, microsecond=999999))
    return EPOCH_MIN, as_of


def timeline_unit(period: str) -> str:
    return TIMELINE_UNIT.get(period, "month")


def ts_text(value: datetime) -> str:
    return value.isoformat(sep=" ", timespec="microseconds")


def ts_lit(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal; built from text so no zone is applied."""
    return F.lit(ts_text(value)).cast("timestamp_ntz")


def date_lit(value: date | datetime) -> Column:
    if isinstance(value, datetime):
        value = value.date()
    return F.lit(value.isoformat()).cast("date")


def sql_ts(value: datetime) -> str:
    """The same literal as SQL text (Spark and DuckDB both accept it)."""
    return f"TIMESTAMP '{ts_text(value)}'"


_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(col: str | Column) -> Column:
    """A ``timestamp_ntz`` wall time read as UTC, as a ``timestamp`` instant.

    Needed for ``withWatermark``/``window`` (they reject NTZ).  Computed as a
    microsecond difference from the epoch, so the session time zone plays no
    part (a plain cast would apply it).
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c))


def instant_to_ntz(col: str | Column) -> Column:
    """Inverse of :func:`ntz_to_instant`: the UTC wall time of an instant."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
