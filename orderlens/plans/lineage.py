"""Lineage cuts with reliable checkpoints in the session's shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from orderlens.session import ensure_checkpoint_dir


def materialize_bounded(df: DataFrame) -> DataFrame:
    """Compute a small result once (a page, a top-k) and keep it in
    ``spark.checkpoint.dir``.

    A page feeds both the key set broadcast into a child scan and the output
    rows; without this the top-k over the parent table would be computed
    twice (two full scans).  A reliable checkpoint survives lost executors
    and cuts the lineage; ``localCheckpoint``/``cache`` would not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several consumers and cut its lineage with a
    reliable checkpoint (any size; written to the shared checkpoint folder)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_parquet(df: DataFrame) -> DataFrame:
    """As :func:`materialize` for tables of the input's size: written as
    compressed parquet, of which later steps read only their columns."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of :func:`materialize_parquet` that go with the step that needs them.
_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now; else
    they stay until the driver's JVM happens to collect the plans that made them."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A step whose result is written within: tables that it materializes as
    parquet and its shuffle files go when it ends."""
    token = _passing.set([])
    try:
        yield
    finally:
        paths = _passing.get()
        _passing.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        sweep(spark)


def file_bytes(*tables: DataFrame) -> int:
    """Bytes of the files that the tables are read or derived from."""
    total = 0
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total
