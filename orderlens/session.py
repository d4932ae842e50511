"""Session helpers: one place for the settings the library relies on.

The library never creates a session on its own inside an operator; callers
pass one in.  ``local_session`` is for tests and the bench.  On a cluster the
deployment provides the session (and ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE re-plans joins from runtime
# sizes (a filtered "today" side becomes a broadcast on its own), splits skewed
# join partitions, and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the keys of a page (paging.MAX_PER_PAGE) reach the parquet scan as values, not as their range
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # remove checkpoint files once the checkpointed data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "orderlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ORDERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    A scratch folder is created only for a local-mode session that names none
    (tests, local runs).  On a cluster a machine-local folder would not be
    shared by the executors, so an unset ``spark.checkpoint.dir`` is an error.
    """
    root = checkpoint_root(spark)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(checkpoints, pages and stream outputs are written there)")
    root = tempfile.mkdtemp(prefix="orderlens-ckpt-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir() or root
