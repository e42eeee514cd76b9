"""Readers and writers (IO1-IO8, IO11).  Schemas are always given: no
inference at scale, and malformed rows are dropped or dead-lettered by the
reader itself, not by a Python loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.sources import schemas as S

#: CSV layout of the raw transaction files: the timestamp arrives as text.
TRANSACTION_CSV = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
                                for f in S.TRANSACTION.fields])


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", ts_col: str = "timestamp",
                      ts_format: str = "yyyy-MM-dd HH:mm:ss", schema: T.StructType | None = None) -> DataFrame:
    """IO1: CSV (header, explicit schema, timestamp parsed; unparsable text
    -> NULL) or parquet."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = spark.read.schema(schema or TRANSACTION_CSV).option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    if ts_col in df.columns and isinstance(df.schema[ts_col].dataType, T.StringType):
        df = df.withColumn(ts_col, F.try_to_timestamp(F.col(ts_col), F.lit(ts_format)).cast("timestamp_ntz"))
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas skips NaN in sums and means, Spark does not: NaN -> NULL."""
    fix = {f.name: F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name))
           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_with_fallback(spark: SparkSession, candidates: Sequence[tuple[str, str]], **kw) -> DataFrame:
    """IO2: the first (path, format) that exists: processed file, else raw."""
    for path, fmt in candidates:
        if _exists(spark, path):
            return read_transactions(spark, path, fmt, **kw)
    raise FileNotFoundError(f"none of {[p for p, _ in candidates]} exists")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """IO3: csv or parquet, optionally partitioned (e.g. by date so later
    filters prune directories); any other format raises ValueError."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_batches(df: DataFrame, path: str, specs: Sequence[tuple[str, str, str]], ts: str = "txn_ts",
                  fmt: str = "parquet") -> None:
    """IO4: one named output per batch window, written in ONE pass: rows are
    tagged with their batch by date range and the write is partitioned by
    the tag (rows outside every window are not written)."""
    d = F.to_date(ts)
    tag = None
    for name, start, end in specs:
        cond = (d >= F.lit(start).cast("date")) & (d <= F.lit(end).cast("date"))
        tag = F.when(cond, name) if tag is None else tag.when(cond, name)
    t = df.withColumn("batch", tag).where(F.col("batch").isNotNull())
    write_table(t, path, fmt, ["batch"])


def read_feedback(spark: SparkSession, directory: str, pattern: str = "feedback_data_*") -> DataFrame | None:
    """IO5: every feedback file, concatenated; malformed lines dropped (the
    per-file ``except`` of the reference); no file -> None."""
    glob = f"{directory.rstrip('/')}/{pattern}"
    if not _exists(spark, glob):
        return None
    return spark.read.schema(S.FEEDBACK).option("header", True).option("mode", "DROPMALFORMED").csv(glob)


def export_features(df: DataFrame, path: str, selected: Sequence[str], label: str = "result_numeric",
                    id_col: str = "transaction_id", ts: str = "txn_ts") -> None:
    """IO7: the selected columns + label + id + timestamp, and the full set,
    both partitioned by date."""
    base = df.withColumn("date", F.to_date(ts))
    write_table(base.select(id_col, ts, *selected, label, "date"), f"{path}/selected", "parquet", ["date"])
    write_table(base, f"{path}/full", "parquet", ["date"])


def write_report(report: DataFrame, path: str) -> None:
    """IO8: a one-row report with nested structs, as JSON (one file)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def parse_requests(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """IO11: JSON text -> typed request (F2); every field is required, so a
    row with a missing or mistyped field goes to the dead-letter frame."""
    p = raw.withColumn("_r", F.from_json(F.col(value), S.REQUEST, {"mode": "PERMISSIVE"}))
    ok = None
    for f in S.REQUEST.fields:
        c = F.col(f"_r.{f.name}").isNotNull()
        ok = c if ok is None else ok & c
    ok = F.coalesce(ok, F.lit(False))
    good = p.where(ok).select("_r.*")
    bad = p.where(~ok).select(value, F.lit("missing or invalid field").alias("error"))
    return good, bad


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key`` at ``path``.
    Two tables bucketed the same way on the join key join without a shuffle
    (co-located sort-merge join); returns the table as a DataFrame."""
    spark = df.sparkSession
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table))
    return spark.table(table)
