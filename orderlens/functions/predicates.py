"""Predicates as composable ``Column`` expressions (never SQL strings)."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.period import date_lit, period_bounds, ts_lit


def all_of(*preds: Column | None) -> Column:
    """AND of the given predicates, skipping ``None``; TRUE when empty."""
    present = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def status_is(status: str | None, col: str = "status") -> Column | None:
    """case-sensitive equality, skipped when the filter is empty."""
    if not status:
        return None
    return F.col(col) == F.lit(status)


def like_pattern(term: str) -> str:
    """``%term%`` with user wildcards kept live; backslashes made literal."""
    return "%" + term.replace("\\", "\\\\") + "%"


def search_any(term: str | None, cols: list[Column]) -> Column | None:
    """``c1 ILIKE %t% OR c2 ILIKE %t% ...``, skipped when empty."""
    if not term:
        return None
    pattern = like_pattern(term)
    return reduce(lambda a, b: a | b, [c.ilike(pattern) for c in cols])


def order_search(term: str | None) -> Column | None:
    return search_any(term, [F.col("user_name"), F.col("user_phone"), F.col("user_email"),
                             F.col("order_id").cast("string")])


def customer_search(term: str | None) -> Column | None:
    return search_any(term, [F.col("full_name"), F.col("phone"), F.col("email")])


def on_day(col: str, day: date | datetime) -> Column:
    """``DATE(c) = day``; Catalyst turns it into a pushed range."""
    return F.to_date(F.col(col)) == date_lit(day)


def from_day(col: str, day: date | datetime) -> Column:
    """``DATE(c) >= day``."""
    return F.to_date(F.col(col)) >= date_lit(day)


def between(col: str, start: datetime, end: datetime) -> Column:
    """inclusive range; NULL values drop out."""
    return F.col(col).between(ts_lit(start), ts_lit(end))


def prune_months(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Add the ``order_month`` partition filter matching ``[start, end]`` when
    the table is stored partitioned by month (Spark does not derive partition
    filters from filters on data columns)."""
    if "order_month" not in df.columns:
        return df
    month = F.col("order_month")
    if start is not None:
        df = df.where(month >= start.strftime("%Y-%m"))
    if end is not None:
        df = df.where(month <= end.strftime("%Y-%m"))
    return df


def in_period(df: DataFrame, period: str, as_of: datetime, col: str = "order_date") -> DataFrame:
    """Rows of ``df`` whose ``col`` lies in the period.

    When the table is stored partitioned by ``order_month`` (see
    ``write_tables``), the matching month range is added as a partition filter
    so whole folders are skipped, not just row groups.
    """
    start, end = period_bounds(period, as_of)
    return prune_months(df.where(between(col, start, end)), start, end)
