"""Helpers shared by the corpus operators: tables in the shared folder, hashed
folds, weighted cuts and gapless numbering, all as DataFrame operations."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir

#: White space of the word and equality rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


class SharedFolder:
    """A folder of one operator run below the cluster's checkpoint folder.

    Tables written here cut the lineage: a lost executor rereads files, it
    does not recompute the steps before them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now:
        it does so when the driver's JVM collects plans that nothing refers to,
        which in a loop of small plans would be long after the disk is full."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()


#: Bytes of rows that go to a Python worker at once, unless the session names another bound.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound what goes to Python workers at once by its bytes.

    Spark's own bound is a number of rows: of long texts these are many times
    a batch's use, in buffers beside the JVM's heap and once more in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session: Python functions of
    its modules then run on workers that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_orderlens_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    name = f"orderlens-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path.toString())
    context._orderlens_shipped = True


#: What operators keep in this Python process from task to task: how it is let go, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keep_only(operator: str, let_go: Callable[[], None]) -> None:
    """Tell that ``operator`` keeps tables in this process, which ``let_go`` drops.

    Python workers go from stage to stage.  What another operator has kept in
    this one is dropped first and its memory given back, so that a worker never
    holds the tables of all the stages that it has served.
    """
    others = [name for name in _kept if name != operator]
    for name in others:
        _kept.pop(name)()
    _kept[operator] = let_go
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


#: What a Python worker makes of the batches of a task.
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def resting(run: Task) -> Task:
    """``run``, after which the worker, which waits for its next task while
    other steps need the memory, gives back what the task has freed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % F.lit(folds)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs outside SPACES: each run becomes one letter,
    then the white space goes."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), SPACES, "")).cast("long")


def weighted_cuts(rows: DataFrame, wants: DataFrame, bits: int, folder: SharedFolder, label: str,
                  step: int = 12) -> DataFrame:
    """Exact weighted quantiles of many groups at once, without sorting rows.

    ``rows(g, k, w)`` has a group, a key in ``[0, 2**bits)`` and a weight;
    ``wants(g, want)`` a prefix sum to reach.  Returns ``(g, cut, below,
    through)`` for each group with a positive want and rows: the smallest key
    whose prefix sum reaches ``want`` (the group's largest key if its total is
    less), the sum before that key, and the sum up to and with it.

    Each round adds up the weights of ``2**step`` bins per group (partial sums
    in the map tasks), prefix-sums the bins of a group and descends into the
    bin where the target falls: at most ``ceil(bits / step)`` scans of
    ``rows``, and no task sees more than the bins of a group.
    """
    state = wants.where(F.col("want") > 0).select("g", F.col("want").cast("double").alias("want"),
                                                  F.lit(0).cast("long").alias("lead"), F.lit(0.0).alias("below"))
    shift = bits
    rank = 0
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("g")
    while shift > 0:
        width = min(step, shift)
        shift -= width
        inside = rows.join(state.select("g", "lead"), "g").where(F.shiftright("k", shift + width) == F.col("lead"))
        bins = inside.groupBy("g", F.shiftright("k", shift).alias("bin")).agg(F.sum("w").cast("double").alias("s"))
        sums = (bins.join(state.select("g", "want", "below"), "g")
                .withColumn("through", F.col("below") + F.sum("s").over(upto))
                .withColumn("last", F.max("bin").over(whole)))
        hit = sums.where((F.col("through") >= F.col("want")) | (F.col("bin") == F.col("last")))
        first = hit.groupBy("g", "want").agg(F.min(F.struct("bin", "s", "through")).alias("f"))
        state = folder.write(first.select("g", "want", F.col("f.bin").alias("lead"),
                                          (F.col("f.through") - F.col("f.s")).alias("below"),
                                          F.col("f.through").alias("through")), f"{label}-cut{rank}")
        rank += 1
    return state.select("g", F.col("lead").alias("cut"), "below", "through")


def gapless(rows: DataFrame, group: str, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in tasks of one
    bucket: counts per bucket are prefix-summed, then each bucket numbers its
    own rows.  ``bucket`` must split a group into pieces a task can sort."""
    keyed = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inner = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (keyed.withColumn("_in", F.row_number().over(inner)).join(starts, [group, "_bucket"])
            .withColumn(out, (F.col("_start") + F.col("_in") - 1).cast("long"))
            .drop("_bucket", "_start", "_in"))
