"""Helpers of the operators: tables, the word pattern, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.session import checkpoint_dir

#: A word is a run of characters other than space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage without depending on any executor's disk, and tells the planner the
    table's true size, so that it broadcasts it only below the session's threshold.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def about(df: DataFrame, rows: int, total: int, key: Column) -> DataFrame:
    """Rows of ``df`` (of ``total`` rows) whose hash ``key`` lies below a threshold: about ``rows`` of them (all, if fewer).

    What follows, such as a sort with a limit, then works on that many rows, however many partitions the table has.
    """
    share = min(1.0, rows / max(total, 1))
    return df if share >= 1 else df.where(F.pmod(key, F.lit(1 << 62)) < F.lit(share * 2.0 ** 62))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, lengthened until none of ``columns`` has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)
