"""O2, O3: deep pages by selecting the page's first key, then seeking to it.

``offset(o).limit(n)`` lets every task keep ``o + n`` rows.  Here the key
``(date, id)`` of the row at an offset is found first, by counting: a round cuts
the remaining range of one key column into ``BINS`` bins, counts the rows of each
(partial counts in the map tasks), and goes on in the bin that the offset falls
into.  At most ``BINS`` counts reach the driver in a round.  A date of
microseconds takes at most six rounds and an id six more; each reads only
the rows of the bin before, by pushed range filters.  The page is then the first
``n`` rows from that key on, so no task keeps more than a page.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.period import date_lit, ts_lit
from orderlens.plans.paging import check_page, newest_first

BINS = 4096
#: Offsets from here on are sought; below, the top rows are taken at once.
DEEP = 10_000
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Key:
    """The sort key of one row of a list that is ordered by date (NULL first) and id, both descending."""

    date: datetime | date | None
    id: int


def _number(col: str, kind: T.DataType) -> Column:
    """A date column as a whole number that grows with it."""
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col)).cast("long")
    return F.timestamp_diff("MICROSECOND", ts_lit(_EPOCH), F.col(col))


def _value(number: int, kind: T.DataType) -> datetime | date:
    if isinstance(kind, T.DateType):
        return _EPOCH.date() + timedelta(days=number)
    return _EPOCH + timedelta(microseconds=number)


def _literal(value: datetime | date) -> Column:
    return ts_lit(value) if isinstance(value, datetime) else date_lit(value)


def _descend(rows: DataFrame, number: Column, narrow, low: int, high: int, offset: int) -> tuple[int, int]:
    """``(value, skipped)``: the number of the row at ``offset`` when sorted by
    ``number`` descending, and how many rows have a larger one.  ``narrow(lo,
    hi)`` filters rows to a range of numbers."""
    skipped = 0
    while low < high:
        width = (high - low) // BINS + 1
        place = F.call_function("div", number - F.lit(low), F.lit(width))  # of whole numbers: a quotient of doubles would round
        counts = {r["bin"]: r["n"] for r in narrow(rows, low, high).groupBy(place.cast("long").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("n")).collect()}  # BINS at most
        for one in sorted(counts, reverse=True):
            if skipped + counts[one] > offset:
                low, high = low + one * width, min(high, low + (one + 1) * width - 1)
                break
            skipped += counts[one]
        else:
            raise ValueError("the offset lies beyond the rows")
    return low, skipped


def key_at(rows: DataFrame, date_col: str, id_col: str, offset: int) -> Key | None:
    """The key of the row at ``offset`` (from 0) in :func:`newest_first` order; None beyond the last row."""
    kind = rows.schema[date_col].dataType
    keys = rows.select(date_col, F.col(id_col).cast("long").alias(id_col))
    d, i = F.col(date_col), F.col(id_col)
    missing = d.isNull()
    told = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("nulls"),
                    F.min(_number(date_col, kind)).alias("lo"), F.max(_number(date_col, kind)).alias("hi")).first()
    if offset >= told["n"]:
        return None
    if offset < told["nulls"]:
        when, same, before = None, keys.where(missing), 0
    else:
        def dates(df: DataFrame, low: int, high: int) -> DataFrame:
            return df.where(d.between(_literal(_value(low, kind)), _literal(_value(high, kind))))

        number, before = _descend(keys, _number(date_col, kind), dates, told["lo"], told["hi"], offset - told["nulls"])
        before += told["nulls"]
        when = _value(number, kind)
        same = keys.where(d == _literal(when))
    ends = same.agg(F.min(i).alias("lo"), F.max(i).alias("hi")).first()

    def ids(df: DataFrame, low: int, high: int) -> DataFrame:
        return df.where(i.between(F.lit(low), F.lit(high)))

    return Key(when, _descend(same, i, ids, ends["lo"], ends["hi"], offset - before)[0])


def from_key(key: Key, date_col: str, id_col: str) -> Column:
    """The row of ``key`` and all after it in :func:`newest_first` order."""
    d, i = F.col(date_col), F.col(id_col)
    if key.date is None:
        return (d.isNull() & (i <= F.lit(key.id))) | d.isNotNull()
    when = _literal(key.date)
    # the plain range is pushed to the scan, the rest decides among rows of the same date
    return (d <= when) & ((d < when) | (i <= F.lit(key.id)))


def deep_page(df: DataFrame, date_col: str, id_col: str, page: int, per_page: int) -> DataFrame:
    """The page that ``offset_page`` gives, by selection and a seek.  ``id_col`` is a unique whole number."""
    key = key_at(df, date_col, id_col, check_page(page, per_page))
    if key is None:
        return df.limit(0)
    return df.where(from_key(key, date_col, id_col)).orderBy(*newest_first(date_col, id_col)).limit(per_page)
