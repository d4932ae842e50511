"""Ordered pages and page counts.

``orderBy(...).offset(o).limit(n)`` plans as a single TakeOrderedAndProject:
every task keeps its own top ``o + n`` rows and one task merges them, so no
global sort and no shuffle of the table.  Deep offsets grow that per-task
top-k, so :func:`keyset_page` offers seek paging (``after=`` the last key of
the previous page) whose per-task work stays at ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a page at most: its keys travel as a literal list and it is sorted in one task.
MAX_PER_PAGE = 1000


def check_size(per_page: int) -> int:
    """The size of a page, which has at least one row and at most MAX_PER_PAGE."""
    if not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page must be >= 1 and <= {MAX_PER_PAGE}, got {per_page}")
    return per_page


def check_page(page: int, per_page: int) -> int:
    """Pages start at 1 (the reference's negative OFFSET is an error)."""
    if page < 1:
        raise ValueError(f"page must be >= 1, got {page}")
    return (page - 1) * check_size(per_page)


def offset_page(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    offset = check_page(page, per_page)
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(per_page) if offset else ordered.limit(per_page)


def newest_first(date_col: str, id_col: str) -> list[Column]:
    """Postgres ``ORDER BY date DESC`` (NULLs first) plus a unique tiebreaker."""
    return [F.desc_nulls_first(date_col), F.desc(id_col)]


def after_key(date_col: str, id_col: str, last_date, last_id) -> Column:
    """Rows strictly after ``(last_date, last_id)`` in :func:`newest_first` order."""
    d, i = F.col(date_col), F.col(id_col)
    if last_date is None:
        return (d.isNull() & (i < F.lit(last_id))) | d.isNotNull()
    from orderlens.functions.period import date_lit, ts_lit

    key = ts_lit(last_date) if hasattr(last_date, "hour") else date_lit(last_date)
    return d.isNotNull() & ((d < key) | ((d == key) & (i < F.lit(last_id))))


def keyset_page(df: DataFrame, date_col: str, id_col: str, per_page: int, after=None) -> DataFrame:
    """Seek paging: the ``per_page`` rows after ``after=(date, id)``."""
    if after is not None:
        df = df.where(after_key(date_col, id_col, *after))
    return df.orderBy(*newest_first(date_col, id_col)).limit(check_size(per_page))


def sort_bounded(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Order a result known to be small (a page): one partition, sorted in
    place, instead of a range-partitioned global sort."""
    return df.coalesce(1).sortWithinPartitions(*order)


def page_count(total: DataFrame, per_page: int = 20, col: str = "total") -> DataFrame:
    """``ceil(total / per_page)``, and 1 when there are no rows."""
    return total.withColumn(
        "total_pages", F.greatest(F.ceil(F.col(col) / F.lit(per_page)).cast("bigint"), F.lit(1).cast("bigint")))
