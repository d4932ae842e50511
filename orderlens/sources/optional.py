"""Reading a dataset that may not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_parquet_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset, or None where the path does not exist.  Any other failure
    (permissions, a corrupt file, an outage) is raised: it must never read as
    "nothing is there"."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
