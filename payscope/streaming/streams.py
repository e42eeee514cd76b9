"""Structured Streaming versions of the four online flows (SS1-SS6).

Every query has a checkpoint location (exactly-once sinks, restart from the
checkpoint) and bounded state: by an event-time watermark in SS2-SS4 and SS6;
SS1 keeps none and SS5 one row per processor.  Aggregations that
must be complete at any time run in update mode and land through
``foreachBatch`` in a state table (``state_table``): committed batches, the
newest row per key.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payscope.functions import expr as X
from payscope.sources import schemas as S
from payscope.streaming.state_table import latest, upsert_sink

__all__ = ["arm_stats_stream", "drift_stream", "error_stream", "feedback_stream", "file_stream", "join_feedback_stream", "latest",
           "outcome_stream", "run_available", "score_stream", "upsert_sink"]

NBINS = 10


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ.  With the
    session time zone at UTC the cast keeps the wall-clock value."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None,
                archive_dir: str | None = None) -> DataFrame:
    """File source; with ``archive_dir`` consumed files are moved there so
    each is read once (IO6, ``cleanSource=archive``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return r.load(path)


def run_available(q_builder, checkpoint: str) -> StreamingQuery:
    """Start with the availableNow trigger and wait for the end."""
    q = q_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# -- SS1 ---------------------------------------------------------------------------------

def score_stream(events: DataFrame, model: PipelineModel, version: str = "1.0.0") -> DataFrame:
    """Score each arriving transaction (F3 rows); stateless."""
    s = model.transform(events)
    p = vector_to_array("probability")[1]
    return s.select(F.col("transaction_id").cast("string").alias("transaction_id"), "txn_ts",
                    p.alias("success_probability"), X.action(p).alias("recommended_action"),
                    F.lit(version).alias("model_version"))


# -- SS2 ---------------------------------------------------------------------------------

def feedback_stream(feedback: DataFrame, ts: str = "txn_ts", delay: str = "1 hour") -> DataFrame:
    """Feedback appended once per transaction: duplicates inside the
    watermark delay are dropped, with state bounded by the watermark."""
    return event_time(feedback, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["transaction_id"])


# -- SS3 ---------------------------------------------------------------------------------

def drift_stream(feedback: DataFrame, ts: str = "txn_ts", window: str = "1 day", delay: str = "1 hour",
                 prob: str = "prediction_probability", label: str = "actual_success") -> DataFrame:
    """Calibration error per tumbling window on FIXED 0..1 buckets (a stream
    has no global min/max): one aggregation of per-bucket counts and sums,
    then a stateless projection to the error."""
    b = F.least(F.floor(F.col(prob) * NBINS), F.lit(NBINS - 1)).cast("int")
    t = event_time(feedback, ts).withWatermark(ts, delay).withColumn("_b", b).withColumn("_y", F.col(label).cast("int"))
    aggs = []
    for i in range(NBINS):
        aggs += [F.count_if(F.col("_b") == i).alias(f"n{i}"), F.sum(F.when(F.col("_b") == i, F.col("_y"))).alias(f"s{i}")]
    g = t.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    err = sum((F.when(F.col(f"n{i}") > 0, F.abs(F.lit((i + 0.5) / NBINS) - F.col(f"s{i}") / F.col(f"n{i}"))
                      * F.col(f"n{i}")).otherwise(0.0) for i in range(NBINS)), F.lit(0.0)) / F.col("n")
    return g.select(_ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), "n",
                    X.rnd(err).alias("calibration_error"),
                    F.when(F.col("n") < S.CALIBRATION_MIN_ROWS, F.lit(None).cast("boolean"))
                     .otherwise(err > S.CALIBRATION_ERROR_LIMIT).alias("drift_detected"))


# -- SS4 ---------------------------------------------------------------------------------

def error_stream(log: DataFrame, ts: str = "ts", length: str = "24 hours", slide: str = "1 hour",
                 delay: str = "1 hour") -> DataFrame:
    """ERROR lines per sliding 24 h window (1 h slide); rows later than the
    watermark are dropped; alert above the limit."""
    e = event_time(log, ts).where(F.col("level") == "ERROR").withWatermark(ts, delay)
    g = e.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count(F.lit(1)).alias("error_count"))
    return g.select(_ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), "error_count",
                    (F.col("error_count") > S.ERROR_COUNT_LIMIT).alias("alert"))


# -- SS5 ---------------------------------------------------------------------------------

def arm_stats_stream(events: DataFrame, arm: str = "processor_id", reward: str = "result") -> DataFrame:
    """Trials and successes per processor (update mode -> the state table the
    bandit policies read)."""
    return events.groupBy(arm).agg(F.count(F.lit(1)).cast("bigint").alias("trials"),
                                   F.sum(X.is_success(reward)).cast("bigint").alias("successes"))


# -- SS6 ---------------------------------------------------------------------------------

def join_feedback_stream(scored: DataFrame, feedback: DataFrame, bound: str = "7 days", delay: str = "1 hour",
                         ts_scored: str = "txn_ts", ts_feedback: str = "feedback_ts") -> DataFrame:
    """Prediction joined with its feedback when it arrives within ``bound``;
    both sides watermarked so join state is dropped after the bound."""
    s = event_time(scored, ts_scored).withWatermark(ts_scored, delay).alias("s")
    f = event_time(feedback, ts_feedback).withWatermark(ts_feedback, delay).alias("f")
    cond = ((F.col("s.transaction_id") == F.col("f.fb_transaction_id"))
            & (F.col(f"f.{ts_feedback}") >= F.col(f"s.{ts_scored}"))
            & (F.col(f"f.{ts_feedback}") <= F.col(f"s.{ts_scored}") + F.expr(f"INTERVAL {bound}")))
    return s.join(f, cond, "inner").select("s.transaction_id", _ntz(f"s.{ts_scored}").alias(ts_scored),
                                           "s.success_probability", "f.actual_success",
                                           _ntz(f"f.{ts_feedback}").alias(ts_feedback))


def outcome_stream(scored: DataFrame, feedback: DataFrame, bound: str = "7 days", delay: str = "1 hour",
                   ts_scored: str = "txn_ts", ts_feedback: str = "feedback_ts") -> DataFrame:
    """Every prediction once: with its outcome when feedback arrives within ``bound``, with NULLs when the watermark has
    passed the bound without any.  Repeats of an id within ``delay`` (predictions or feedback) count once, so that they do not
    make a row leave twice.  Join state is dropped with the bound; feedback without a prediction does not leave."""
    wait = f"INTERVAL {bound}"
    s = (event_time(scored, ts_scored).withWatermark(ts_scored, delay).dropDuplicatesWithinWatermark(["transaction_id"]).alias("s"))
    f = (event_time(feedback, ts_feedback).withWatermark(ts_feedback, delay).dropDuplicatesWithinWatermark(["fb_transaction_id"]).alias("f"))
    at, answered = F.col(f"s.{ts_scored}"), F.col(f"f.{ts_feedback}")
    cond = (F.col("s.transaction_id") == F.col("f.fb_transaction_id")) & (answered >= at) & (answered <= at + F.expr(wait))
    return s.join(f, cond, "left_outer").select("s.transaction_id", _ntz(f"s.{ts_scored}").alias(ts_scored), "s.success_probability",
                                                "f.actual_success", _ntz(f"f.{ts_feedback}").alias(ts_feedback))
