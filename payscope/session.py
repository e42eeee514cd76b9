"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins and coalesces shuffle
# partitions at runtime, skew-join splitting is on, the UI (a server) is off.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shuffle partitions are sized by bytes at runtime: AQE coalesces small
    # ones to ~128 MB and splits partitions 5x above the median (and > 256 MB)
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # lineage cuts write reliable checkpoints; remove them once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only what the planner can prove small; 10 MB is Spark's own
    # default, stated here so nobody raises it silently.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "payscope", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` and ``shuffle_partitions`` are only applied when given; on a
    cluster the launcher decides them.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def cut_lineage(df):
    """Write ``df`` as Parquet into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint) and return a DataFrame whose
    plan starts there: later steps read only the columns they use, and the
    planner knows the table's size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that fits a model; Spark ML keeps all of them in memory, about half a kilobyte a row in a forest of 100 trees.
TASK_ROWS = 100_000


def spread(df, rows: int = TASK_ROWS, count: int | None = None):
    """``df`` dealt evenly to tasks of about ``rows`` rows (read twice: counted, unless ``count`` is known, then dealt); as it is
    if one task will do.  Files are read in tasks of so many bytes, which can be any number of rows."""
    tasks = -(-(df.count() if count is None else count) // rows)
    return df.repartition(tasks) if tasks > 1 else df


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Where it is unset, a fresh scratch folder is
    created and registered, but only if the master is local: on a cluster a
    machine's own folder would lose what executors write."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="payscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return d
