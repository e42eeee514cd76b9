"""Monitoring queries (MN1-MN8) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.operators import monitor as MN
from payscope.operators import reports as R
from payscope.plans.q_stats import AB_CTES, _ab_frame
from payscope.plans.registry import FEEDBACK_CTE, LOG_CTE, register, txn_sql
from payscope.sources import views as V


def _fb(spark, d):
    return V.feedback(spark, d)


def _rf(x, p=3):
    d = f"(CASE WHEN trunc({x}) = 0 THEN -CAST(floor(log10(abs({x}))) AS INTEGER) - 1 + {p} ELSE {p} END)"
    return f"(CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} * pow(10.0, {d}), 0) / pow(10.0, {d}) END)"


_EDGES = ", ".join(["lo - (hi - lo) * 0.001"] + [f"CAST({i} AS DOUBLE) * ((hi - lo) / 10) + lo" for i in range(1, 10)]
                   + ["hi"])

CAL_CTES = [
    FEEDBACK_CTE,
    "cst AS (SELECT min(prediction_probability) AS lo, max(prediction_probability) AS hi FROM feedback)",
    f"ced AS (SELECT [{_EDGES}] AS edges FROM cst)",
    "clb AS (SELECT edges, list_transform(edges, lambda x: " + _rf("x") + ") AS le FROM ced)",
    """cb AS (SELECT """ + " + ".join(f"CASE WHEN prediction_probability > edges[{i + 1}] THEN 1 ELSE 0 END"
                                       for i in range(1, 10)) + """ AS bucket, actual_success
          FROM feedback, ced WHERE prediction_probability IS NOT NULL)""",
    """ctab AS (SELECT CAST(bucket AS INTEGER) AS bucket, round((le[bucket + 1] + le[bucket + 2]) / 2, 6) AS midpoint,
                round(avg(CAST(actual_success AS DOUBLE)), 6) AS observed, count(*) AS n
         FROM cb, clb GROUP BY bucket, le)""",
    """cerr AS (SELECT round(sum(abs(midpoint - observed) * n) / sum(n), 6) AS calibration_error, CAST(sum(n) AS BIGINT) AS n
         FROM ctab)""",
]


@register("calibration_table", txn_sql("SELECT * FROM ctab", *CAL_CTES))
def q_cal(spark, d):
    return MN.calibration_table(_fb(spark, d))


@register("calibration_error", txn_sql("SELECT * FROM cerr", *CAL_CTES))
def q_cal_err(spark, d):
    return MN.calibration_error(MN.calibration_table(_fb(spark, d)))


@register("drift_flag", txn_sql("""
SELECT calibration_error, n, CASE WHEN n < 100 THEN NULL ELSE calibration_error > 0.05 END AS drift_detected FROM cerr""",
                                *CAL_CTES))
def q_drift(spark, d):
    return MN.drift_flag(MN.calibration_error(MN.calibration_table(_fb(spark, d))))


_ERRLOG_CTES = [LOG_CTE,
                """ew AS (SELECT * FROM request_log WHERE level = 'ERROR'
                  AND ts > (SELECT max(ts) FROM request_log) - INTERVAL 24 HOURS AND ts <= (SELECT max(ts) FROM request_log))""",
                """es AS (SELECT (SELECT count(*) FROM ew) AS error_count,
                  (SELECT string_agg(message, ' | ' ORDER BY ts, event_id) FROM
                     (SELECT * FROM ew ORDER BY ts, event_id LIMIT 10) x) AS recent_messages)"""]


@register("error_log_summary_24h", txn_sql("SELECT * FROM es", *_ERRLOG_CTES))
def q_errlog(spark, d):
    return MN.error_log_summary(V.request_log(spark, d))


@register("alerts", txn_sql("""
SELECT * FROM (VALUES
  ('service_unhealthy', (SELECT avg(CASE WHEN status = 200 THEN 1 ELSE 0 END) < 0.5 FROM request_log), 'page on-call'),
  ('high_p95_latency', (SELECT quantile_cont(response_time_s, 0.95) > 2.0 FROM request_log), 'scale service'),
  ('model_drift', (SELECT coalesce(CASE WHEN n < 100 THEN NULL ELSE calibration_error > 0.05 END, false) FROM cerr),
   'retrain model'),
  ('error_spike', (SELECT error_count > 10 FROM es), 'inspect errors')) v(alert, triggered, action)""",
                            *CAL_CTES, *_ERRLOG_CTES))
def q_alerts(spark, d):
    log = V.request_log(spark, d)
    drift = MN.drift_flag(MN.calibration_error(MN.calibration_table(_fb(spark, d))))
    return MN.alerts(R.latency_percentiles(log), drift, MN.error_log_summary(log))


@register("calibration_by_strategy", txn_sql("""
SELECT strategy, round(predicted_probability, 6) AS predicted_probability, count(*) AS n,
       round(avg(CAST(success AS INTEGER)), 6) AS success_rate FROM ab GROUP BY 1, 2""", *AB_CTES))
def q_cal_strategy(spark, d):
    return MN.calibration_by_strategy(_ab_frame(spark, d))


@register("concept_drift_daily", txn_sql("""
SELECT m.day, n, auc, precision, recall FROM
 (SELECT CAST(txn_ts AS DATE) AS day, count(*) AS n,
         round(CASE WHEN count(CASE WHEN yhat = 1 THEN 1 END) > 0 THEN count(CASE WHEN yhat = 1 AND y = 1 THEN 1 END)
               / count(CASE WHEN yhat = 1 THEN 1 END) ELSE 0.0 END, 6) AS precision,
         round(CASE WHEN count(CASE WHEN y = 1 THEN 1 END) > 0 THEN count(CASE WHEN yhat = 1 AND y = 1 THEN 1 END)
               / count(CASE WHEN y = 1 THEN 1 END) ELSE 0.0 END, 6) AS recall
  FROM fs GROUP BY 1) m
JOIN (SELECT day, round(sum(pos * (nb - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM
        (SELECT *, sum(neg) OVER (PARTITION BY day ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nb
         FROM (SELECT CAST(txn_ts AS DATE) AS day, p AS score, count(CASE WHEN y = 1 THEN 1 END) AS pos,
                      count(CASE WHEN y = 0 THEN 1 END) AS neg FROM fs GROUP BY 1, 2) c) w GROUP BY day) a
  ON m.day = a.day""", FEEDBACK_CTE,
    """fs AS (SELECT txn_ts, prediction_probability AS p, CAST(actual_success AS INTEGER) AS y,
       CASE WHEN prediction_probability >= 0.5 THEN 1 ELSE 0 END AS yhat FROM feedback)"""))
def q_concept(spark, d):
    return MN.concept_drift_over_time(_fb(spark, d), "prediction_probability", "actual_success", "txn_ts")


@register("retrain_decision", txn_sql("""
SELECT CASE WHEN n < 100 THEN NULL ELSE calibration_error > 0.05 END AS drift_detected,
       coalesce(CASE WHEN n < 100 THEN NULL ELSE calibration_error > 0.05 END, false) AS retrain FROM cerr""", *CAL_CTES))
def q_retrain_decision(spark, d):
    drift = MN.drift_flag(MN.calibration_error(MN.calibration_table(_fb(spark, d))))
    return drift.select("drift_detected", F.coalesce("drift_detected", F.lit(False)).alias("retrain"))


@register("retrain_on_drift")
def q_retrain_on_drift(spark, d):
    """MN8: the drift verdict, and the retrained model's held-out metrics when it says so."""
    from payscope.operators import ml as ML
    from payscope.plans.q_ml import model_table
    fb = _fb(spark, d)
    drift = MN.drift_flag(MN.calibration_error(MN.calibration_table(fb)))
    rows = model_table(spark, d)
    old, new = ML.split(rows, 0.2, seed=7)
    new = new.drop("result_numeric").join(fb.select("transaction_id", "actual_success"), "transaction_id")
    done = MN.retrain_on_drift(drift, lambda: ML.retrain(old, new, "logistic", features=ML.MODEL_FEATURES)[1])
    out = drift.select("drift_detected", F.coalesce("drift_detected", F.lit(False)).alias("retrained"))
    empty = "CAST(NULL AS BIGINT) AS n", "CAST(NULL AS DOUBLE) AS f1"
    return out.selectExpr("*", *empty) if done is None else out.withColumn("_m", done.select(F.struct("n", "f1")).scalar()).select("drift_detected", "retrained", "_m.*")
