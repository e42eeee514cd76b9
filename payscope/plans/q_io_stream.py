"""Source/sink (IO*) and streaming (SS*) queries.  Each writes derived
data to a fresh folder under the session's checkpoint directory, reads it
back (or streams it) and returns a DataFrame the oracle can check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import reports as R
from payscope.plans.q_ml import model_table
from payscope.plans.q_monitor import CAL_CTES
from payscope.plans.q_reports import _fr_sql
from payscope.plans.q_routing import _hu
from payscope.plans.registry import FEEDBACK_CTE, LOG_CTE, OK, register, txn_sql
from payscope.session import checkpoint_dir, cut_lineage
from payscope.sources import io as IO
from payscope.sources import schemas as S
from payscope.sources import views as V
from payscope.streaming import bandit as BA
from payscope.streaming import streams as ST


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


def _raw_f1(spark, d):
    """Transactions in the raw F1 layout (timestamp as text)."""
    t = V.transactions(spark, d)
    return t.select(F.col("transaction_id").cast("string").alias("transaction_id"),
                    X.format_ts("txn_ts").alias("timestamp"), "merchant_id", "customer_id", "customer_location",
                    "payment_amount", "payment_method", "device_type", "network_latency", "result", "processor_id",
                    X.hhmm("txn_ts").alias("hhmm"), X.day_name("txn_ts").alias("day_name"), "error_code",
                    F.lit(None).cast("string").alias("failure_reason"), "retry_count",
                    F.lit(None).cast("string").alias("regional_event"))


# ---- IO1 / IO2 / IO3 ------------------------------------------------------------------

@register("io_csv_roundtrip_failure_rate", txn_sql(_fr_sql(["payment_method"])))
def q_csv(spark, d):
    p = scratch(spark, "csv")
    IO.write_table(_raw_f1(spark, d), p, "csv")
    back = IO.read_transactions(spark, p, "csv")
    return R.failure_rate_by(back, ["payment_method"])


@register("io_read_with_fallback", txn_sql(
    "SELECT payment_method, count(*) AS n, count(timestamp) AS n_ts FROM (SELECT payment_method, txn_ts AS timestamp "
    "FROM transactions) s GROUP BY 1"))
def q_fallback(spark, d):
    p = scratch(spark, "raw")
    IO.write_table(_raw_f1(spark, d), p, "csv")
    df = IO.read_with_fallback(spark, [(scratch(spark, "processed-missing"), "parquet"), (p, "csv")])
    return df.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("n_ts"))


@register("io_write_batches", txn_sql("""
SELECT batch, count(*) AS n FROM (SELECT CASE WHEN CAST(txn_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-07' THEN 'week1'
  WHEN CAST(txn_ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 'week2' END AS batch FROM transactions) s
WHERE batch IS NOT NULL GROUP BY 1"""))
def q_batches(spark, d):
    p = scratch(spark, "batches")
    IO.write_batches(V.transactions(spark, d), p, [("week1", "2024-01-01", "2024-01-07"),
                                                   ("week2", "2024-01-08", "2024-01-14")])
    return spark.read.parquet(p).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


# ---- IO5 / IO7 / IO8 / IO11 ----------------------------------------------------------------

@register("io_read_feedback_files", txn_sql("""
SELECT count(*) AS n, CAST(sum(CASE WHEN actual_success THEN 1 ELSE 0 END) AS BIGINT) AS n_success,
       round(sum(prediction_probability), 4) AS sum_probability FROM feedback""", FEEDBACK_CTE))
def q_feedback_files(spark, d):
    root = scratch(spark, "feedback")
    fb = V.feedback(spark, d).select(F.col("transaction_id").cast("string").alias("transaction_id"),
                                     "actual_success", "prediction_probability")
    for i in range(3):
        IO.write_table(fb.where(F.col("transaction_id").cast("long") % 3 == i), f"{root}/feedback_data_{i}", "csv")
    back = IO.read_feedback(spark, root)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("actual_success").cast("int")).cast("bigint").alias("n_success"),
                    X.rnd(F.sum("prediction_probability"), 4).alias("sum_probability"))


@register("io_export_features", txn_sql("""
SELECT CAST(txn_ts AS DATE) AS date, count(*) AS n, CAST(sum(""" + OK + """) AS BIGINT) AS n_success FROM transactions GROUP BY 1"""))
def q_export(spark, d):
    p = scratch(spark, "export")
    IO.export_features(model_table(spark, d), p, ["hour", "retry_count", "amount_log"])
    s = spark.read.parquet(f"{p}/selected")
    return s.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("result_numeric").cast("bigint").alias("n_success"))


@register("io_write_report", txn_sql("""
SELECT l.n, mean_s, p95_s, p99_s, success_share, c.calibration_error, c.n AS n_feedback,
       CASE WHEN c.n < 100 THEN NULL ELSE c.calibration_error > 0.05 END AS drift_detected
FROM cerr c CROSS JOIN (SELECT count(*) AS n, round(avg(response_time_s), 6) AS mean_s, round(quantile_cont(response_time_s, 0.95), 6) AS p95_s,
       round(quantile_cont(response_time_s, 0.99), 6) AS p99_s, round(avg(CASE WHEN status = 200 THEN 1 ELSE 0 END), 6) AS success_share
  FROM request_log) l""", *CAL_CTES, LOG_CTE))
def q_report(spark, d):
    from payscope.operators import monitor as MN
    log = V.request_log(spark, d)
    lat = R.latency_percentiles(log)
    drift = MN.drift_flag(MN.calibration_error(MN.calibration_table(V.feedback(spark, d)))).withColumnRenamed("n", "n_feedback")
    rt = lat.select(F.struct(*lat.columns)).scalar()
    dr = drift.select(F.struct(*drift.columns)).scalar()
    rep = spark.range(1).select(rt.alias("response_times"), dr.alias("drift"))
    p = scratch(spark, "report")
    IO.write_report(rep, p)
    return spark.read.schema(rep.schema).json(p).select("response_times.*", "drift.*")


@register("io_parse_requests", txn_sql("""
SELECT CASE WHEN transaction_id % 7 <> 0 AND network_latency IS NOT NULL THEN 'valid' ELSE 'dead_letter' END AS outcome,
       count(*) AS n FROM transactions GROUP BY 1"""))
def q_requests(spark, d):
    t = V.transactions(spark, d)
    fields = []
    for f in S.REQUEST.fields:
        if f.name == "transaction_id":
            v = F.col("transaction_id").cast("string")
        elif f.name == "timestamp":
            v = X.format_ts("txn_ts")
        elif f.name in t.columns:
            v = F.col(f.name)
        elif f.name == "network_latency":
            v = F.col("network_latency")
        else:
            v = F.lit("x") if f.dataType.simpleString() == "string" else F.lit(1).cast(f.dataType)
        if f.name == "network_latency":
            v = F.when(F.col("transaction_id") % 7 != 0, v)  # dropped field -> dead letter
        fields.append(v.alias(f.name))
    raw = t.select(F.to_json(F.struct(*fields)).alias("value"))
    good, bad = IO.parse_requests(raw)
    return (good.select(F.lit("valid").alias("outcome")).unionByName(bad.select(F.lit("dead_letter").alias("outcome")))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


# ---- streaming -------------------------------------------------------------------------------

def _stage(spark, df, name):
    """Write a derived input table for a file stream; returns (path, schema)."""
    p = scratch(spark, name)
    df.write.parquet(p)
    return p, spark.read.parquet(p).schema


@register("stream_feedback_dedup", txn_sql("""
SELECT transaction_id, actual_success, round(prediction_probability, 6) AS prediction_probability FROM feedback""",
                                           FEEDBACK_CTE))
def q_ss2(spark, d):
    fb = V.feedback(spark, d)
    src, schema = _stage(spark, fb.unionByName(fb), "fb-in")  # every row is sent twice
    out, ck = scratch(spark, "fb-out"), scratch(spark, "fb-ck")
    s = ST.feedback_stream(ST.file_stream(spark, src, schema))
    ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    return spark.read.parquet(out).select("transaction_id", "actual_success",
                                          X.rnd("prediction_probability").alias("prediction_probability"))


@register("stream_drift_daily", txn_sql("""
SELECT window_start, window_end, n, round(err, 6) AS calibration_error,
       CASE WHEN n < 100 THEN NULL ELSE err > 0.05 END AS drift_detected
FROM (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, sum(nb) AS n,
             sum(abs((b + 0.5) / 10 - sb / nb) * nb) / sum(nb) AS err
      FROM (SELECT date_trunc('day', txn_ts) AS window_start, b, count(*) AS nb, sum(y) AS sb
            FROM (SELECT txn_ts, CAST(least(floor(prediction_probability * 10), 9) AS INTEGER) AS b,
                         CAST(actual_success AS INTEGER) AS y FROM feedback) x GROUP BY 1, 2) g GROUP BY 1) w""",
                                        FEEDBACK_CTE))
def q_ss3(spark, d):
    src, schema = _stage(spark, V.feedback(spark, d), "drift-in")
    out, ck = scratch(spark, "drift-out"), scratch(spark, "drift-ck")
    s = ST.drift_stream(ST.file_stream(spark, src, schema))
    ST.run_available(s.writeStream.foreachBatch(ST.upsert_sink(out, ["window_start"])).outputMode("update"), ck)
    return ST.latest(spark, out, ["window_start"])


@register("stream_error_windows", txn_sql("""
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS error_count, count(*) > 10 AS alert
FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS window_start
      FROM request_log, range(0, 24) r(k) WHERE level = 'ERROR') w GROUP BY 1""", LOG_CTE))
def q_ss4(spark, d):
    src, schema = _stage(spark, V.request_log(spark, d), "log-in")
    out, ck = scratch(spark, "log-out"), scratch(spark, "log-ck")
    s = ST.error_stream(ST.file_stream(spark, src, schema))
    ST.run_available(s.writeStream.foreachBatch(ST.upsert_sink(out, ["window_start"])).outputMode("update"), ck)
    return ST.latest(spark, out, ["window_start"])


@register("stream_arm_stats", txn_sql("""
SELECT processor_id, count(*) AS trials, CAST(sum(""" + OK + """) AS BIGINT) AS successes FROM transactions GROUP BY 1"""))
def q_ss5(spark, d):
    src, schema = _stage(spark, V.transactions(spark, d), "arm-in")
    out, ck = scratch(spark, "arm-out"), scratch(spark, "arm-ck")
    s = ST.arm_stats_stream(ST.file_stream(spark, src, schema))
    ST.run_available(s.writeStream.foreachBatch(ST.upsert_sink(out, ["processor_id"])).outputMode("update"), ck)
    return ST.latest(spark, out, ["processor_id"])


@register("stream_join_feedback", txn_sql("""
SELECT CAST(s.transaction_id AS VARCHAR) AS transaction_id, s.txn_ts,
       round(0.98 - 0.003 * coalesce(s.network_latency, 100.0), 6) AS success_probability, f.actual_success,
       f.txn_ts + (f.transaction_id % 10) * INTERVAL 1 DAY AS feedback_ts
FROM transactions s JOIN feedback f ON s.transaction_id = f.transaction_id WHERE f.transaction_id % 10 <= 7""", FEEDBACK_CTE))
def q_ss6(spark, d):
    t = V.transactions(spark, d)
    scored = t.select(F.col("transaction_id").cast("string").alias("transaction_id"), "txn_ts",
                      X.rnd(F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0))).alias("success_probability"))
    fb = V.feedback(spark, d).select(
        F.col("transaction_id").cast("string").alias("fb_transaction_id"), "actual_success",
        (F.col("txn_ts") + F.make_dt_interval(F.col("transaction_id") % 10)).alias("feedback_ts"))
    s_src, s_schema = _stage(spark, scored, "pred-in")
    f_src, f_schema = _stage(spark, fb, "fbk-in")
    out, ck = scratch(spark, "join-out"), scratch(spark, "join-ck")
    j = ST.join_feedback_stream(ST.file_stream(spark, s_src, s_schema), ST.file_stream(spark, f_src, f_schema))
    ST.run_available(j.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    return spark.read.parquet(out)


def _stage_in_order(spark, df, ts, name, slices=3, files=2, slice_rows=None):
    """Write a stream's rows as time slices, one after the other; returns (path, schema, files per trigger): a trigger takes a slice.
    ``slice_rows``: where a slice would hold more rows, as many slices of about even rows as keep to it (rows of one time stay together)."""
    p = scratch(spark, name)
    at = F.col(ts).cast("timestamp").cast("double")
    lo, hi, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    if slice_rows and n > slices * slice_rows:
        slices = -(-n // slice_rows)
        ends = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 100 * slices)).first()[0]
        part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < at))
    else:
        part = F.least(F.floor((at - lo) / ((hi - lo) / slices or 1.0)), F.lit(slices - 1))
    df = cut_lineage(df.withColumn("_part", part))
    for i in range(slices):
        df.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(p)
    return p, df.drop("_part").schema, files


#: Rows of a micro-batch that one lane decides: its task holds them at once in Python.
SLICE_ROWS = 500_000

_ROUTE_STREAM = """SELECT r.transaction_id, r.txn_ts, a.trials_before, CASE WHEN {explore} < 0.1 THEN pick ELSE exploit END AS route_epsilon_greedy,
       CASE WHEN a.trials_before = 0 THEN pick ELSE best_ucb END AS route_ucb
FROM (SELECT *, ['PROC001', 'PROC002', 'PROC003', 'PROC004', 'PROC005'][CAST(floor({pick} * 5) AS INTEGER) + 1] AS pick FROM transactions) r
JOIN (SELECT transaction_id, CAST(max(total) AS BIGINT) AS trials_before, arg_max(arm, (CASE WHEN n > 0 THEN s / n ELSE 0.0 END, -i)) AS exploit,
             arg_max(arm, (CASE WHEN n > 0 THEN s / n + sqrt(ln(total) / n) ELSE CAST('inf' AS DOUBLE) END, -i)) AS best_ucb
      FROM (SELECT *, sum(n) OVER (PARTITION BY transaction_id) AS total FROM st) x GROUP BY 1) a USING (transaction_id)"""
_ROUTE_STREAM_STATE = f"""st AS (SELECT transaction_id, i, arm, coalesce(sum(CASE WHEN processor_id = arm THEN 1 ELSE 0 END) OVER w, 0) AS n,
         coalesce(sum(CASE WHEN processor_id = arm THEN {OK} ELSE 0 END) OVER w, 0) AS s
       FROM transactions, (SELECT CAST(i AS INTEGER) AS i, 'PROC00' || i AS arm FROM range(1, 6) g(i)) a
       WINDOW w AS (PARTITION BY arm ORDER BY txn_ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("stream_route_bandit", txn_sql(_ROUTE_STREAM.format(explore=_hu("explore"), pick=_hu("pick")), _ROUTE_STREAM_STATE))
def q_route_stream(spark, d):
    """RO5 and RO6 decided row by row on a stream of time slices, from the counters as the row before left them."""
    t = V.transactions(spark, d).select("transaction_id", "txn_ts", "processor_id", "result")
    src, schema, files = _stage_in_order(spark, t, "txn_ts", "route-in", slice_rows=SLICE_ROWS)
    out, ck = scratch(spark, "route-out"), scratch(spark, "route-ck")
    s = BA.route_stream(ST.file_stream(spark, src, schema, max_files=files), [p[0] for p in S.PROCESSORS])
    ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    return spark.read.parquet(out)


@register("stream_prediction_outcomes", txn_sql("""
SELECT CAST(s.transaction_id AS VARCHAR) AS transaction_id, s.txn_ts,
       round(0.98 - 0.003 * coalesce(s.network_latency, 100.0), 6) AS success_probability, f.actual_success, f.feedback_ts
FROM transactions s LEFT JOIN (SELECT transaction_id, actual_success, txn_ts + (transaction_id % 10) * INTERVAL 1 DAY AS feedback_ts
                               FROM feedback WHERE transaction_id % 10 <= 7) f USING (transaction_id)""", FEEDBACK_CTE))
def q_outcomes(spark, d):
    """Every prediction once, unanswered ones when the watermark passes their seven days: both streams come in time slices, and a
    last row far ahead (not returned) moves the watermark past all of them."""
    t = V.transactions(spark, d)
    scored = t.select(F.col("transaction_id").cast("string").alias("transaction_id"), "txn_ts",
                      X.rnd(F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0))).alias("success_probability"))
    fb = V.feedback(spark, d).select(F.col("transaction_id").cast("string").alias("fb_transaction_id"), "actual_success",
                                     (F.col("txn_ts") + F.make_dt_interval(F.col("transaction_id") % 10)).alias("feedback_ts"))
    ahead = F.make_dt_interval(F.lit(60))
    end = scored.agg((F.max("txn_ts") + ahead).alias("txn_ts")).select(F.lit("-").alias("transaction_id"), "txn_ts", F.lit(0.0).alias("success_probability"))
    end_fb = end.select(F.lit("--").alias("fb_transaction_id"), F.lit(None).cast("boolean").alias("actual_success"), F.col("txn_ts").alias("feedback_ts"))
    s_src, s_schema, files = _stage_in_order(spark, scored, "txn_ts", "pred-in")
    f_src, f_schema, _ = _stage_in_order(spark, fb, "feedback_ts", "fbk-in")
    end.write.mode("append").parquet(s_src)
    end_fb.write.mode("append").parquet(f_src)
    out, ck = scratch(spark, "outcome-out"), scratch(spark, "outcome-ck")
    j = ST.outcome_stream(ST.file_stream(spark, s_src, s_schema, max_files=files), ST.file_stream(spark, f_src, f_schema, max_files=files))
    ST.run_available(j.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    return spark.read.parquet(out).where("transaction_id <> '-'")


@register("stream_score")
def q_ss1(spark, d):
    from payscope.operators import ml as ML
    feats = ["hour", "retry_count", "has_retry", "amount_log", "network_latency"]
    t = model_table(spark, d)
    model = ML.fit(t, "logistic", feats)
    src, schema = _stage(spark, t.drop("merchant_success_rate"), "score-in")
    out, ck = scratch(spark, "score-out"), scratch(spark, "score-ck")
    s = ST.score_stream(ST.file_stream(spark, src, schema), model)
    ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    return spark.read.parquet(out)


@register("prediction_vs_actual_bucketed", txn_sql("""
SELECT s.transaction_id, round(0.98 - 0.003 * coalesce(s.network_latency, 100.0), 6) AS success_probability,
       f.actual_success
FROM transactions s LEFT JOIN (SELECT transaction_id, CASE WHEN transaction_id % 5 <> 0 THEN result = 'success' END AS actual_success
                               FROM transactions) f USING (transaction_id)"""))
def q_bucketed(spark, d):
    """JN9 with both sides stored bucketed by transaction_id: the join
    reads co-located buckets (no Exchange on either side)."""
    from payscope.operators import features as FE
    tag = uuid.uuid4().hex[:8]
    t = V.transactions(spark, d)
    scored = t.select("transaction_id", X.rnd(F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0)))
                      .alias("success_probability"))
    fb = V.feedback(spark, d).select("transaction_id", F.when(F.col("transaction_id") % 5 != 0, F.col("actual_success")).alias("actual_success"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # what the cluster is sized for
    a = IO.write_bucketed(scored, f"scored_{tag}", scratch(spark, "scored-b"), "transaction_id", buckets)
    b = IO.write_bucketed(fb, f"feedback_{tag}", scratch(spark, "feedback-b"), "transaction_id", buckets)
    return FE.prediction_vs_actual(a, b)


@register("stream_feedback_archive", txn_sql("""
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, actual_success, round(prediction_probability, 6) AS prediction_probability
FROM feedback""", FEEDBACK_CTE))
def q_archive(spark, d):
    """IO6: feedback files consumed by a stream that moves each committed
    file to an archive folder, so every file is read exactly once."""
    fb = V.feedback(spark, d).select(F.col("transaction_id").cast("string").alias("transaction_id"),
                                     "actual_success", "prediction_probability")
    src = scratch(spark, "fb-files")
    for i in range(2):
        fb.where(F.col("transaction_id").cast("long") % 2 == i).write.mode("append") \
          .option("header", True).csv(src)
    out, ck, arch = scratch(spark, "fb-arch-out"), scratch(spark, "fb-arch-ck"), scratch(spark, "fb-archive")
    s = ST.file_stream(spark, src, S.FEEDBACK, fmt="csv", max_files=1, archive_dir=arch)
    ST.run_available(s.writeStream.format("parquet").option("path", out), ck)
    return spark.read.parquet(out).select("transaction_id", "actual_success",
                                          X.rnd("prediction_probability").alias("prediction_probability"))
