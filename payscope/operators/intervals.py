"""Joining times with intervals by buckets (JN5, JN6).

An interval is filed under buckets of about its own length: level l has buckets of ``BASE_SECONDS`` * 2^l, and an interval goes to
the first level whose buckets are at least as long, where it meets two buckets at most.  A time has one bucket a level, so time and
interval meet in an equi-join on (level, bucket); an exact check follows.  Hours, overlapping intervals and intervals of many years
cost the same.  The rows of each level in use are counted first (at most 40 numbers), and
intervals counted to be few are broadcast, so that the times are not moved.

Ends count as inside.  An end that is a DATE lasts until the end of that day.  An interval without start or end, or that ends before it
starts, holds no time; a NULL time is in no interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_SECONDS = 3600
#: Filed intervals up to this many are broadcast, after counting them.
BROADCAST_ROWS = 50_000
_BASE = BASE_SECONDS * 1_000_000
_DAY = 86_400 * 1_000_000


def _micros(df: DataFrame, c: str, last: bool = False) -> Column:
    """Microseconds of a time; with ``last``, of the last moment of a DATE."""
    m = F.unix_micros(F.col(c).cast("timestamp"))
    return m + (_DAY - 1) if last and df.schema[c].dataType.typeName() == "date" else m


def _bucket(micros: Column, level: Column) -> Column:
    """Non-decreasing in the time, so that an interval's buckets hold those of its times."""
    return F.floor(micros / F.pow(F.lit(2.0), level) / _BASE)


def filed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """``intervals`` with _from, _to (microseconds, both inside), and a row for each _level, _bucket."""
    t = intervals.withColumns({"_from": _micros(intervals, start), "_to": _micros(intervals, end, last=True)}).where("_from <= _to")
    t = t.withColumn("_level", F.greatest(F.ceil(F.log2((F.col("_to") - F.col("_from") + 1) / _BASE)), F.lit(0)).cast("int"))
    return t.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_from"), F.col("_level")), _bucket(F.col("_to"), F.col("_level")))))


def _levels(by_bucket: DataFrame) -> dict[int, int]:
    """Rows filed in each level in use (at most 40)."""
    return {r[0]: r[1] for r in by_bucket.groupBy("_level").count().orderBy("_level").collect()}


def _broadcast(side: DataFrame, rows: int) -> DataFrame:
    """Send ``side`` to all tasks if it was counted to be small; else the planner decides by size."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def interval_join(df: DataFrame, intervals: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """A row per row of ``df`` and interval that holds its time, with the columns of both (their names must differ).

    Rows are copied once per level in use; beyond the broadcast bound, a bucket that many rows share is a skewed join key, which
    AQE splits."""
    by_bucket = filed(intervals, start, end)
    levels = _levels(by_bucket)
    if not levels:
        return df.sparkSession.createDataFrame([], StructType([*df.schema.fields, *intervals.schema.fields]))
    at = F.col("_at")
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), _bucket(at, F.lit(n)).alias("_bucket")) for n in levels]))
    rows = df.withColumn("_at", _micros(df, ts)).where(at.isNotNull()).withColumn("_k", keys).select("*", "_k.*").drop("_k")
    j = rows.join(_broadcast(by_bucket, sum(levels.values())), ["_level", "_bucket"]).where((F.col("_from") <= at) & (at <= F.col("_to")))
    return j.select(*df.columns, *intervals.columns)


def with_intervals(df: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, payload: Sequence[str], out: str) -> DataFrame:
    """``df`` with the array ``out`` of the ``payload`` of the intervals that hold the row's time, for calendars: what joins
    is one row a bucket with the intervals filed there, so a row of ``df`` is never copied."""
    by_bucket = filed(intervals, start, end)
    kind = intervals.select(F.array(F.struct(*payload)).alias("x")).schema["x"].dataType
    t, found = df.withColumn("_at", _micros(df, ts)), []
    for n, rows in _levels(by_bucket).items():
        here = by_bucket.where(F.col("_level") == n).groupBy(F.col("_bucket").alias(f"_b{n}")).agg(
            F.collect_list(F.struct("_from", "_to", F.struct(*payload).alias("p"))).alias(f"_i{n}"))
        t = t.join(_broadcast(here, rows), _bucket(F.col("_at"), F.lit(n)) == F.col(f"_b{n}"), "left")
        inside = F.filter(f"_i{n}", lambda i: (i["_from"] <= F.col("_at")) & (F.col("_at") <= i["_to"]))
        found.append(F.coalesce(F.transform(inside, lambda i: i["p"]), F.array()))
    every = F.concat(*found) if found else F.array().cast(kind)
    return t.withColumn(out, every).drop("_at", *[c for c in t.columns if c[:2] in ("_b", "_i") and c[2:].isdigit()])
