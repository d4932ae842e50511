"""Join helpers: broadcasts only behind a size bound, child aggregates below
joins, and one-row-per-key picks that aggregate map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded BY CONSTRUCTION
    (a page of ``per_page`` rows, a top-k, the rows of a fixed domain).

    ``max_rows`` documents the bound; the hint is refused above a size a
    broadcast should never carry.  Sides without such a bound are left to
    AQE, which broadcasts from measured runtime sizes only.
    """
    if max_rows > 1_000_000:
        return df
    return F.broadcast(df)


def pick_one(df: DataFrame, key: str | Sequence[str], order: Sequence[str], alias: str,
             payload: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the smallest by ``order`` (e.g. lowest id).

    Written as ``min(struct(order..., payload...))`` grouped by key: Min is
    partially aggregated, so even a key holding a third of the rows reduces to
    one row per map task before the shuffle (a row_number window would sort
    the whole group in one task).  Struct ordering compares fields left to
    right, so ties on ``order`` are broken by the payload deterministically.
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in (payload or df.columns) if c not in keys and c not in order]
    rec = F.struct(*[F.col(c) for c in list(order) + payload])
    return df.groupBy(*keys).agg(F.min(rec).alias(alias))


def attach_counts(parents: DataFrame, counts: DataFrame, key: str, alias: str) -> DataFrame:
    """Left join of pre-aggregated counts; parents without children get 0."""
    return (parents.join(counts, key, "left")
            .withColumn(alias, F.coalesce(F.col(alias), F.lit(0).cast("bigint"))))


def restrict_to_keys(child: DataFrame, keys: DataFrame, col: str, max_keys: int,
                     key_col: str | None = None) -> DataFrame:
    """Keep the ``child`` rows whose ``col`` is among ``keys`` (a result of at
    most ``max_keys`` rows by construction, e.g. a checkpointed page).

    The keys become a literal ``IN`` list, which Spark pushes into the parquet
    scan (row-group statistics, bucket pruning) — a broadcast semi join would
    still read the whole child table.  Above ``max_keys`` it falls back to a
    semi join, so no unbounded list ever reaches the driver.
    """
    key_col = key_col or col
    values = [r[0] for r in keys.select(key_col).limit(max_keys + 1).collect()]
    if len(values) > max_keys:
        return child.join(keys.select(F.col(key_col).alias(col)), col, "left_semi")
    values = [v for v in values if v is not None]
    return child.where(F.col(col).isin(values)) if values else child.where(F.lit(False))


def restrict_to_key_range(child: DataFrame, keys: DataFrame, col: str, key_col: str | None = None) -> DataFrame:
    """Add ``col BETWEEN min(key) AND max(key)`` of ``keys`` to ``child``.

    Always a superset of the semi join it accompanies, so results are
    unchanged; when ids grow with time (recent orders have recent ids) it lets
    the child scan skip every row group outside a period's id range.  The
    bounds are one aggregated row.
    """
    key_col = key_col or col
    lo, hi = keys.agg(F.min(key_col), F.max(key_col)).first()
    if lo is None:
        return child.where(F.lit(False))
    return child.where(F.col(col).between(F.lit(lo), F.lit(hi)))
