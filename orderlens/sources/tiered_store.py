"""Additive figures written batch by batch, read as one table.

A batch brings partial sums (a row per key, which may be negative where
something is taken back); a reader adds up all of them.  Each batch is a part
of level 0.  When ``fanout`` parts of a level are complete they are added up
into one part of the next level, so a reader of ``n`` batches opens fewer than
``fanout * (log(n) / log(fanout) + 1)`` parts:

    {root}/parts/level=L/seq=S      sums of batches S*fanout**L .. (S+1)*fanout**L - 1
    {root}/_commits/level=L/seq=S   an empty file, written LAST: the part is visible

* A reader lists the markers and takes the committed parts that no committed
  part of a higher level contains, so it never sees a half-written batch and
  never one twice.
* A part is written with ``overwrite`` before its marker.  A replayed batch (a
  lost driver, a restarted stream) rewrites its own part, or nothing if a merged
  part holds it already, and does again a merge that broke off.
* Merged parts are removed one merge later: readers that listed the markers just
  before a merge still find their files.  The marker goes first, then the data,
  so what is left of a broken removal is invisible and is removed with the next.

Nothing is read on the driver but the list of markers, which stays logarithmic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8


@dataclass(frozen=True)
class TieredStore:
    """Sums over ``keys`` of a table with columns ``schema`` (keys and sums) below ``root``."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    fanout: int = FANOUT

    def __post_init__(self) -> None:
        if self.fanout < 2:
            raise ValueError("fanout must be at least 2")

    # --- files

    def _path(self, section: str, level: int, seq: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{section}/level={level}/seq={seq}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> set[tuple[int, int]]:
        """(level, seq) of every visible part; none where nothing was written."""
        _, files = self._path("_commits", 0, 0)
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/_commits/level=*/seq=*")
        found = files.globStatus(pattern)
        out = set()
        for status in found or ():
            path = status.getPath()
            out.add((int(path.getParent().getName().split("=")[1]), int(path.getName().split("=")[1])))
        return out

    def _commit(self, level: int, seq: int) -> None:
        path, files = self._path("_commits", level, seq)
        files.create(path, True).close()

    def _remove(self, level: int, seq: int) -> None:
        for section in ("_commits", "parts"):
            path, files = self._path(section, level, seq)
            files.delete(path, True)

    # --- sums

    def _holder(self, level: int, seq: int, parts: set[tuple[int, int]]) -> bool:
        """Whether a committed part of a higher level contains this one."""
        top = max((lv for lv, _ in parts), default=0)
        return any((up, seq // self.fanout ** (up - level)) in parts for up in range(level + 1, top + 1))

    def visible(self) -> list[tuple[int, int]]:
        parts = self.committed()
        return sorted(p for p in parts if not self._holder(*p, parts))

    def _added(self, df: DataFrame) -> DataFrame:
        sums = [f for f in self.schema.fields if f.name not in self.keys]
        # a decimal's sum is wider than its column; the column says how wide the sums are
        return df.groupBy(*self.keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums]).select(*self.schema.names)

    def _read(self, parts: Sequence[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root.rstrip('/')}/parts/level={lv}/seq={s}" for lv, s in parts])

    def read(self) -> DataFrame:
        """One row per key: the sums over all committed batches (an empty table before the first)."""
        return self._added(self._read(self.visible()))

    def _write(self, df: DataFrame, level: int, seq: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/parts/level={level}/seq={seq}")
        self._commit(level, seq)

    def write(self, batch_id: int, sums: DataFrame) -> None:
        """Commit a batch's sums (rows of equal keys are added up), and merge the levels that it completes."""
        if batch_id < 0:
            raise ValueError("batches are numbered from 0")
        parts = self.committed()
        if not self._holder(0, batch_id, parts):
            self._write(self._added(sums), 0, batch_id)
        self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        level, seq = 0, batch_id
        while (seq + 1) % self.fanout == 0:
            parts = self.committed()
            group = seq // self.fanout
            children = sorted((level, s) for s in range(group * self.fanout, (group + 1) * self.fanout) if (level, s) in parts)
            if (level + 1, group) not in parts and children and not self._holder(level + 1, group, parts):
                self._write(self._added(self._read(children)), level + 1, group)
            for s in range(max(0, (group - 1) * self.fanout), group * self.fanout):  # of the merge before this one
                if self._holder(level, s, parts) or (level, s) not in parts:
                    self._remove(level, s)
            level, seq = level + 1, group
