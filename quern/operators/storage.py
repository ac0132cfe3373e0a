"""Writing rows as segments of a table."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.catalog import RID, Segment, Table


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without the setting one of this machine, if it is the only one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class SegmentStore:
    """Makes segments below a folder; every one has a name of its own, so none is ever overwritten.

    Without a folder they go to the shared one and are deleted when the process ends.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self._folder = spark, folder

    @property
    def folder(self) -> str:
        if self._folder is None:
            self._folder = f"{shared_folder(self.spark)}/quern-{uuid.uuid4().hex}"
            _unnamed.append(self)
        return self._folder

    def drop(self, path: str) -> None:
        """Delete what was written below a path; only for what no table names."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def write(self, table: Table, frame: DataFrame, looked_up: str | None = None) -> Segment:
        """A frame of RID and fields as a segment, with bloom filters for a field by which rows are looked up."""
        path = f"{self.folder}/{table.uid}/{uuid.uuid4().hex}"
        bloom = {f"parquet.bloom.filter.enabled#{looked_up}": "true"} if looked_up else {}
        frame.write.options(**bloom).parquet(path)
        rows = self.spark.read.parquet(path).count()  # from the files' footers
        return Segment(path, tuple(c.field for c in table.columns), rows)

    def settled(self, table: Table) -> Table:
        """The table with its tail written as a segment."""
        if not table.tailed:
            return table
        only_tail = table.changed(segments=())
        segment = self.write(table, only_tail.fields_frame(self.spark).coalesce(1))
        return table.changed(segments=(*table.segments, segment), tail=[], tailed=0)

    def rewritten(self, table: Table, frame: DataFrame, next_rid: int | None = None, looked_up: str | None = None) -> Table:
        """The table with all its rows replaced by those of the frame (RID and fields)."""
        segment = self.write(table, frame, looked_up)
        return table.changed(segments=(segment,) if segment.rows else (), tail=[], tailed=0, next_rid=table.next_rid if next_rid is None else next_rid)

    def compacted(self, table: Table, by: str | None = None) -> Table:
        """All rows in one segment, sorted by an indexed field or else by arrival, so that files and row groups cover ranges of it."""
        frame, parts = table.fields_frame(self.spark), max(1, -(-table.rows // 1_000_000))
        return self.rewritten(table, frame.repartitionByRange(parts, by or RID).sortWithinPartitions(by or RID, RID), looked_up=by)


_unnamed: list[SegmentStore] = []


@atexit.register
def _clean() -> None:
    for store in _unnamed:
        try:
            store.drop(store.folder)
        except Exception:  # noqa: BLE001 - the JVM may have gone already
            return
