"""Large results in slices of a key, so that only one slice is being shuffled.

A union of sections keeps the shuffle files of all of them on disk until its last
row is out.  Here the rows are cut at quantiles of the key, all rows of a key in
one slice; each section of a slice is computed and written as compressed parquet,
and its shuffle files go before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.plans.lineage import file_bytes, new_folder, step

#: Bytes of files that a slice reads; what fits one slice is not cut.
SLICE_BYTES = 256 << 20


def slices(tables: Sequence[DataFrame], key: str) -> list[Column]:
    """Conditions on ``key`` of which every row of the tables meets one (NULLs
    the first): as many as the tables' files fill slices, a single one for
    tables that are not files or have another than an integral key."""
    n = -(-file_bytes(*tables) // SLICE_BYTES)
    if n <= 1 or not all(isinstance(df.schema[key].dataType, T.IntegralType) for df in tables):
        return [F.lit(True)]
    keys = tables[0].select(key)
    for df in tables[1:]:
        keys = keys.union(df.select(key))
    cuts = keys.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0]
    ends = sorted(set(cuts or []))
    if not ends:
        return [F.lit(True)]
    col = F.col(key)
    inner = [(col > low) & (col <= high) for low, high in zip(ends, ends[1:])]
    return [col.isNull() | (col <= ends[0]), *inner, col > ends[-1]]


def in_slices(spark: SparkSession, parts: Sequence[Column], sections: dict[str, Callable[[Column], DataFrame]]) -> dict[str, DataFrame]:
    """The rows of each section over all ``parts``, written part by part."""
    root, schemas = new_folder(spark, "slices"), {}
    for where in parts:
        for name, make in sections.items():
            with step(spark):
                rows = make(where)
                rows.write.mode("append").parquet(f"{root}/{name}", compression="zstd")
                schemas[name] = rows.schema
                del rows
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in schemas.items()}
