"""A table of the newest row per key, fed by a stream's micro-batches, with a commit log.

A micro-batch writes its rows to a folder of its own name and then one small manifest, which lists the folders that make up the
table.  The manifest gets its final name by a rename, so a reader sees a batch whole or not at all; it reads the highest-numbered
manifest and never lists data folders.  A replayed batch that has a manifest does nothing; one that has none writes to a
new folder.  Every ``compact_every``-th batch writes the newest rows of all keys to its folder and a manifest that lists only that;
folders are deleted one compaction later, so readers of the manifest before have time to finish.

One stream writes to a table.  The folder needs a file system whose rename does not replace an existing file (as Spark's own
checkpoints do): local disks and HDFS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"
COMMITS = "_commits"


class StateTable:
    """The files of one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the committed batches whose manifests are kept, ascending."""
        home = self._path(f"{self.root}/{COMMITS}")
        names = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, batch_id: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{COMMITS}/{batch_id}", wholetext=True).first()[0])

    def commit(self, batch_id: int, manifest: dict) -> bool:
        """Give the manifest its name; False if the batch has one already."""
        draft, final = (self._path(f"{self.root}/{COMMITS}/{n}") for n in (f".{batch_id}-{uuid.uuid4().hex}", str(batch_id)))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])


def newest(rows: DataFrame, keys: Sequence[str], batch: bool = False) -> DataFrame:
    """The row of the latest batch per key (``batch``: with its number)."""
    cols = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), BATCH).alias("_v"))
    return g.select(*keys, *[F.col("_v").getField(c).alias(c) for c in cols if batch or c != BATCH])


def upsert_sink(path: str, keys: Sequence[str], compact_every: int = 50):
    """foreachBatch writer of a state table; ``latest`` reads it."""
    keys = list(keys)

    def write(batch: DataFrame, batch_id: int):
        t = StateTable(batch.sparkSession, path)
        done = t.commits()
        if batch_id in done or (done and batch_id < done[-1]):
            return  # replayed after its commit
        old = t.manifest(done[-1]) if done else {"folders": [], "retired": []}
        batch = batch.withColumn(BATCH, F.lit(batch_id).cast("long"))
        compact = bool(old["folders"]) and batch_id % compact_every == 0
        if compact:
            batch = newest(t.read(old["folders"]).unionByName(batch), keys, batch=True)
        folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{t.root}/{folder}")
        folders = [folder] if compact else [*old["folders"], folder]
        retired = old["folders"] if compact else old["retired"]
        if t.commit(batch_id, {"folders": folders, "retired": retired}) and compact:
            for f in old["retired"]:  # retired by the compaction before this one
                t.delete(f)
            for n in done[:-1]:
                t.delete(f"{COMMITS}/{n}")
    return write


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of the last committed batch's table."""
    t = StateTable(spark, path)
    done = t.commits()
    if not done:
        raise FileNotFoundError(f"{path}: no committed batch")
    return newest(t.read(t.manifest(done[-1])["folders"]), list(keys))
