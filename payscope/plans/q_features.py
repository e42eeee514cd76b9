"""Feature queries (SC*, JN1, JN4-JN7, JN9, WN1-WN2, WN6, WN8, features table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import features as FE
from payscope.operators import intervals as I
from payscope.operators import reports as R
from payscope.plans.registry import FAIL, OK, register, sales_sql, txn_sql
from payscope.session import cut_lineage
from payscope.sources import schemas as S
from payscope.sources import views as V


def _t(spark, d):
    return V.transactions(spark, d)


# ---- SC1-SC4, SC30, SC31 ------------------------------------------------------------

_TIME_SQL = """SELECT transaction_id, CAST(txn_ts AS DATE) AS date, CAST(hour(txn_ts) AS INTEGER) AS hour,
  CAST(isodow(txn_ts) - 1 AS INTEGER) AS day_of_week, dayname(txn_ts) AS day_name,
  CAST(weekofyear(txn_ts) AS INTEGER) AS week, CAST(month(txn_ts) AS INTEGER) AS month,
  CAST(CASE WHEN isodow(txn_ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CASE WHEN hour(txn_ts) < 6 THEN 'night' WHEN hour(txn_ts) < 12 THEN 'morning'
       WHEN hour(txn_ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
  strftime(txn_ts, '%H:%M') AS hhmm, strftime(txn_ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
  CAST(CASE WHEN isodow(txn_ts) <= 5 AND hour(txn_ts) >= 9 AND hour(txn_ts) < 18 THEN 1 ELSE 0 END AS INTEGER)
    AS is_business_hours,
  CASE WHEN hour(txn_ts) >= 8 AND hour(txn_ts) < 10 THEN 'morning_peak'
       WHEN hour(txn_ts) >= 18 AND hour(txn_ts) < 20 THEN 'evening_peak'
       WHEN hour(txn_ts) >= 22 THEN 'late_night' ELSE 'off_peak' END AS peak_band
FROM transactions"""


@register("time_features", txn_sql(_TIME_SQL))
def q_time(spark, d):
    t = FE.add_time_parts(_t(spark, d))
    return t.select("transaction_id", "date", "hour", "day_of_week", "day_name", "week", "month", "is_weekend",
                    "time_of_day", "hhmm", "ts_text", "is_business_hours", "peak_band")


# ---- SC5-SC10, SC13, SC14, SC21 ---------------------------------------------------------

@register("scalar_features", txn_sql(f"""
SELECT transaction_id, CAST({FAIL} AS INTEGER) AS is_failure, CAST({OK} AS INTEGER) AS result_numeric,
  CAST(regexp_extract(merchant_id, '(\\d+)', 1) AS INTEGER) AS merchant_num,
  concat('C', lpad(CAST(CAST(regexp_extract(customer_id, '(\\d+)', 1) AS INTEGER) AS VARCHAR), 8, '0')) AS customer_code,
  round(ln(1 + payment_amount), 6) AS amount_log,
  CAST(CASE WHEN retry_count > 0 THEN 1 ELSE 0 END AS INTEGER) AS has_retry,
  round(least(greatest(1.2 - network_latency / 200, 0.0), 1.0), 6) AS p_clip,
  CASE WHEN least(greatest(1.2 - network_latency / 200, 0.0), 1.0) > 0.5 THEN 'route' ELSE 'review' END AS action
FROM transactions"""))
def q_scalar(spark, d):
    t = _t(spark, d)
    p = X.clip01(F.lit(1.2) - F.col("network_latency") / 200)
    return t.select("transaction_id", X.is_failure("result").alias("is_failure"),
                    X.is_success("result").alias("result_numeric"),
                    X.digits_of_id("merchant_id").alias("merchant_num"),
                    X.make_id("C", X.digits_of_id("customer_id"), 8).alias("customer_code"),
                    X.rnd(X.log1p("payment_amount")).alias("amount_log"),
                    X.has_retry("retry_count").alias("has_retry"), X.rnd(p).alias("p_clip"),
                    X.action(p).alias("action"))


_AMOUNT_BIN_FIXED = """CASE WHEN payment_amount >= 0 AND payment_amount <= 50 THEN '$0-50'
  WHEN payment_amount > 50 AND payment_amount <= 100 THEN '$50-100' WHEN payment_amount > 100 AND payment_amount <= 200 THEN '$100-200'
  WHEN payment_amount > 200 AND payment_amount <= 300 THEN '$200-300' WHEN payment_amount > 300 AND payment_amount <= 400 THEN '$300-400'
  WHEN payment_amount > 400 AND payment_amount <= 500 THEN '$400-500' WHEN payment_amount > 500 AND payment_amount <= 900 THEN '$500-900' END"""
_AMOUNT_BIN_OPEN = """CASE WHEN payment_amount > 0 AND payment_amount <= 50 THEN '<$50'
  WHEN payment_amount > 50 AND payment_amount <= 100 THEN '$50-100' WHEN payment_amount > 100 AND payment_amount <= 200 THEN '$100-200'
  WHEN payment_amount > 200 AND payment_amount <= 500 THEN '$200-500' WHEN payment_amount > 500 AND payment_amount <= 1000 THEN '$500-1000'
  WHEN payment_amount > 1000 THEN '>$1000' END"""


@register("amount_bins_fixed_open", txn_sql(f"""
SELECT transaction_id, {_AMOUNT_BIN_FIXED} AS amount_bin_fixed, {_AMOUNT_BIN_OPEN} AS amount_bin_open FROM transactions"""))
def q_bins(spark, d):
    return _t(spark, d).select("transaction_id", X.amount_bin_fixed().alias("amount_bin_fixed"),
                               X.amount_bin_open().alias("amount_bin_open"))


# ---- SC11 / SC12 quantile bins and ordinal codes -------------------------------------------

def _qcase(x, e, labels):
    parts = []
    for i, lab in enumerate(labels):
        lower = f"{x} >= {e}[1]" if i == 0 else f"{x} > {e}[{i + 1}]"
        parts.append(f"WHEN {lower} AND {x} <= {e}[{i + 2}] THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _ordcase(c, labels):
    return "CAST(CASE " + " ".join(f"WHEN {c} = '{lab}' THEN {i + 1}" for i, lab in enumerate(labels)) + " END AS INTEGER)"


_QBIN_CTES = [
    "qa AS (SELECT quantile_cont(payment_amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM transactions)",
    "ql AS (SELECT quantile_cont(network_latency, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM transactions)",
    f"""qb AS (SELECT transaction_id, {_qcase('payment_amount', 'qa.e', S.AMOUNT_QBIN_LABELS)} AS amount_bin,
  {_qcase('network_latency', 'ql.e', S.LATENCY_QBIN_LABELS)} AS latency_bin FROM transactions, qa, ql)""",
]


@register("quantile_bins", txn_sql(f"""
SELECT transaction_id, amount_bin, latency_bin, {_ordcase('amount_bin', S.AMOUNT_QBIN_LABELS)} AS amount_bin_encoded,
       {_ordcase('latency_bin', S.LATENCY_QBIN_LABELS)} AS latency_bin_encoded FROM qb""", *_QBIN_CTES))
def q_qbins(spark, d):
    t = FE.qbins(_t(spark, d), {"payment_amount": (S.AMOUNT_QBIN_LABELS, "amount_bin"), "network_latency": (S.LATENCY_QBIN_LABELS, "latency_bin")})
    return t.select("transaction_id", "amount_bin", "latency_bin",
                    X.ordinal("amount_bin", S.AMOUNT_QBIN_LABELS).alias("amount_bin_encoded"),
                    X.ordinal("latency_bin", S.LATENCY_QBIN_LABELS).alias("latency_bin_encoded"))


# ---- SC15 / SC18 / JN7 ------------------------------------------------------------------------

_ERR_VALUES = ", ".join(f"('{c}', '{t}')" for c, t in S.ERROR_CODES)
_PROC_VALUES = ", ".join(f"('{p}', '{n}', {f}, {s}, {r})" for p, n, f, s, r in S.PROCESSORS)
_PM_VALUES = ", ".join(f"('{m}', {s}, {f})" for m, s, f in S.PAYMENT_METHODS)


@register("failed_with_error_text", txn_sql(f"""
SELECT transaction_id, error_code, failure_reason FROM transactions
LEFT JOIN (VALUES {_ERR_VALUES}) e(error_code, failure_reason) USING (error_code)
WHERE result = 'failure'"""))
def q_error_text(spark, d):
    t = R.with_failure_reason(_t(spark, d), V.error_dim(spark))
    return t.where(F.col("result") == "failure").select("transaction_id", "error_code", "failure_reason")


@register("lookup_dims", txn_sql(f"""
SELECT transaction_id, base_failure_rate, processor_name, reliability, failure_reason FROM transactions
LEFT JOIN (VALUES {_PM_VALUES}) pm(payment_method, traffic_share, base_failure_rate) USING (payment_method)
LEFT JOIN (VALUES {_PROC_VALUES}) pr(processor_id, processor_name, processor_failure_rate, avg_speed, reliability) USING (processor_id)
LEFT JOIN (VALUES {_ERR_VALUES}) e(error_code, failure_reason) USING (error_code)"""))
def q_lookup(spark, d):
    pm, err, proc = S.dim_frames(spark)
    t = FE.lookup_dims(_t(spark, d), pm, proc, err.withColumnRenamed("error_description", "failure_reason"))
    return t.select("transaction_id", "base_failure_rate", "processor_name", "reliability", "failure_reason")


# ---- SC16 / SC17 / SC28 / SC29 ------------------------------------------------------------------

@register("filter_dashboard_default", txn_sql("""
SELECT transaction_id, txn_ts, payment_method, customer_location FROM transactions
WHERE CAST(txn_ts AS DATE) >= (SELECT max(CAST(txn_ts AS DATE)) FROM transactions) - INTERVAL 6 DAY
  AND CAST(txn_ts AS DATE) <= (SELECT max(CAST(txn_ts AS DATE)) FROM transactions)
  AND payment_method IN ('credit_card', 'USSD') AND customer_location IN ('urban')"""))
def q_filter_default(spark, d):
    t = FE.filter_dashboard(_t(spark, d), methods=["credit_card", "USSD"], locations=["urban"])
    return t.select("transaction_id", "txn_ts", "payment_method", "customer_location")


@register("filter_dashboard_range", txn_sql("""
SELECT transaction_id, txn_ts, payment_method, customer_location FROM transactions
WHERE txn_ts >= TIMESTAMP '2024-01-10' AND txn_ts < TIMESTAMP '2024-01-15' AND payment_method IN ('mobile_money')"""))
def q_filter_range(spark, d):
    t = FE.filter_dashboard(_t(spark, d), "2024-01-10", "2024-01-14", methods=["mobile_money"])
    return t.select("transaction_id", "txn_ts", "payment_method", "customer_location")


@register("filter_summary", txn_sql("""
SELECT count(CASE WHEN payment_method IN ('credit_card', 'USSD') THEN 1 END) AS shown, count(*) AS total FROM transactions"""))
def q_filter_summary(spark, d):
    return FE.filter_summary(_t(spark, d), F.col("payment_method").isin("credit_card", "USSD"))


@register("renamed_columns", txn_sql("""
SELECT transaction_id AS id, payment_amount AS amount, CASE WHEN result = 'success' THEN 1 ELSE 0 END AS is_successful
FROM transactions"""))
def q_rename(spark, d):
    t = _t(spark, d).select("transaction_id", "payment_amount",
                            (F.col("result") == "success").cast("int").alias("result_numeric"))
    return t.withColumnsRenamed({"transaction_id": "id", "payment_amount": "amount", "result_numeric": "is_successful"})


@register("date_spine_daily", txn_sql("""
SELECT CAST(d AS DATE) AS date, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT unnest(generate_series(CAST(min(txn_ts) AS DATE), CAST(max(txn_ts) AS DATE), INTERVAL 1 DAY)) AS d
      FROM transactions) s
LEFT JOIN (SELECT CAST(txn_ts AS DATE) AS date, count(*) AS n FROM transactions GROUP BY 1) c ON CAST(s.d AS DATE) = c.date"""))
def q_spine(spark, d):
    return FE.date_spine(_t(spark, d))


# ---- SC22-SC26 -------------------------------------------------------------------------------------

@register("minmax_scaled", txn_sql("""
SELECT transaction_id,
  round(CASE WHEN a1 = a0 THEN 0.0 ELSE (payment_amount - a0) / (a1 - a0) END, 6) AS payment_amount_minmax,
  round(CASE WHEN l1 = l0 THEN 0.0 ELSE (network_latency - l0) / (l1 - l0) END, 6) AS network_latency_minmax,
  round(CASE WHEN r1 = r0 THEN 0.0 ELSE (retry_count - r0) / (r1 - r0) END, 6) AS retry_count_minmax
FROM transactions, (SELECT min(payment_amount) a0, max(payment_amount) a1, min(network_latency) l0, max(network_latency) l1,
                           min(retry_count) r0, max(retry_count) r1 FROM transactions) s"""))
def q_minmax(spark, d):
    cols = ["payment_amount", "network_latency", "retry_count"]
    t = FE.minmax(_t(spark, d), cols)
    return t.select("transaction_id", *[X.rnd(f"{c}_minmax").alias(f"{c}_minmax") for c in cols])


@register("standardized", txn_sql("""
SELECT transaction_id, round((payment_amount - am) / CASE WHEN asd = 0 THEN 1 ELSE asd END, 6) AS payment_amount_scaled,
       round((network_latency - lm) / CASE WHEN lsd = 0 THEN 1 ELSE lsd END, 6) AS network_latency_scaled
FROM transactions, (SELECT avg(payment_amount) am, stddev_pop(payment_amount) asd, avg(network_latency) lm,
                           stddev_pop(network_latency) lsd FROM transactions) s"""))
def q_standardize(spark, d):
    cols = ["payment_amount", "network_latency"]
    t = FE.standardize(_t(spark, d), cols)
    return t.select("transaction_id", *[X.rnd(f"{c}_scaled").alias(f"{c}_scaled") for c in cols])


@register("robust_scaled", txn_sql("""
SELECT transaction_id, round((payment_amount - q[2]) / CASE WHEN q[3] - q[1] = 0 THEN 1 ELSE q[3] - q[1] END, 6)
       AS payment_amount_robust
FROM transactions, (SELECT quantile_cont(payment_amount, [0.25, 0.5, 0.75]) AS q FROM transactions) s"""))
def q_robust(spark, d):
    t = FE.robust_scale(_t(spark, d), ["payment_amount"])
    return t.select("transaction_id", X.rnd("payment_amount_robust").alias("payment_amount_robust"))


_METHODS_SORTED = sorted(m for m, _, _ in S.PAYMENT_METHODS)


@register("one_hot_method", txn_sql("SELECT transaction_id, " + ", ".join(
    f"CAST(CASE WHEN payment_method = '{m}' THEN 1 ELSE 0 END AS INTEGER) AS payment_method_{m}" for m in _METHODS_SORTED)
    + " FROM transactions"))
def q_one_hot(spark, d):
    t = FE.one_hot(_t(spark, d), "payment_method", _METHODS_SORTED)
    return t.select("transaction_id", *[f"payment_method_{m}" for m in _METHODS_SORTED])


@register("label_encode_device", txn_sql("""
SELECT transaction_id, device_type, CAST(idx AS INTEGER) AS device_type_index FROM transactions
LEFT JOIN (SELECT device_type, row_number() OVER (ORDER BY count(*) DESC, device_type) - 1 AS idx
           FROM transactions WHERE device_type IS NOT NULL GROUP BY device_type) i USING (device_type)"""))
def q_label_encode(spark, d):
    return FE.label_encode(_t(spark, d), "device_type").select("transaction_id", "device_type", "device_type_index")


_TRAIN_SQL = "CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|42'), 1, 7))::BIGINT % 100 AS INTEGER) < 80"


@register("target_encode_merchant", txn_sql(f"""
SELECT transaction_id, merchant_id, round(m, 6) AS merchant_id_target_mean FROM transactions
LEFT JOIN (SELECT merchant_id, avg(CAST({OK} AS DOUBLE)) AS m FROM transactions
           WHERE {_TRAIN_SQL} AND merchant_id IS NOT NULL GROUP BY 1) s USING (merchant_id)"""))
def q_target_encode(spark, d):
    t = _t(spark, d).withColumn("ok", X.is_success("result"))
    t = FE.target_encode(t, "merchant_id", "ok", X.hash_bucket("transaction_id") < 80)
    return t.select("transaction_id", "merchant_id", X.rnd("merchant_id_target_mean").alias("merchant_id_target_mean"))


# ---- SC19 ----------------------------------------------------------------------------------------------

@register("display_rows", txn_sql("""
SELECT strftime(txn_ts, '%Y-%m-%d %H:%M:%S') AS "Timestamp", merchant_id AS "Merchant Id", payment_method AS "Payment Method",
       '$' || format('{:,.2f}', payment_amount) AS "Payment Amount",
       format('{:,.1f}', network_latency) || ' ms' AS "Network Latency",
       upper(substr(result, 1, 1)) || lower(substr(result, 2)) AS "Result"
FROM transactions"""))
def q_display(spark, d):
    return FE.display_rows(_t(spark, d))


# ---- JN1 / JN4 ---------------------------------------------------------------------------------------

_GS_COLS = ["merchant_transaction_count", "merchant_success_rate", "hourly_transaction_volume", "hourly_success_rate",
            "processor_success_rate", "device_success_rate", "latency_bin_success_rate", "location_success_rate",
            "payment_location_success_rate"]


def _win_stat(expr, keys):
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"CASE WHEN {nn} THEN {expr} OVER (PARTITION BY {', '.join(keys)}) END"


@register("group_stats", txn_sql(f"""
SELECT transaction_id,
  {_win_stat('count(*)', ['merchant_id'])} AS merchant_transaction_count,
  round({_win_stat('avg(ok)', ['merchant_id'])}, 6) AS merchant_success_rate,
  {_win_stat('count(*)', ['hour'])} AS hourly_transaction_volume,
  round({_win_stat('avg(ok)', ['hour'])}, 6) AS hourly_success_rate,
  round({_win_stat('avg(ok)', ['processor_id'])}, 6) AS processor_success_rate,
  round({_win_stat('avg(ok)', ['device_type'])}, 6) AS device_success_rate,
  round({_win_stat('avg(ok)', ['latency_bin'])}, 6) AS latency_bin_success_rate,
  round({_win_stat('avg(ok)', ['customer_location'])}, 6) AS location_success_rate,
  round({_win_stat('avg(ok)', ['payment_method', 'customer_location'])}, 6) AS payment_location_success_rate
FROM (SELECT t.*, CAST({OK} AS DOUBLE) AS ok, CAST(hour(txn_ts) AS INTEGER) AS hour, qb.latency_bin
      FROM transactions t JOIN qb USING (transaction_id)) s""", *_QBIN_CTES))
def q_group_stats(spark, d):
    t = _t(spark, d).withColumn("result_numeric", X.is_success("result")).withColumn("hour", F.hour("txn_ts").cast("int"))
    t = FE.qbins(t, {"network_latency": (S.LATENCY_QBIN_LABELS, "latency_bin")})
    t = FE.attach_group_stats(t)
    return t.select("transaction_id", *[F.col(c) if c.endswith(("count", "volume")) else X.rnd(c).alias(c)
                                        for c in _GS_COLS])


@register("is_peak_hour", txn_sql("""
SELECT transaction_id, CAST(hour(txn_ts) AS INTEGER) AS hour,
       CAST(CASE WHEN hour(txn_ts) IN (SELECT h FROM hv WHERE vol > (SELECT quantile_cont(vol, 0.75) FROM hv)) THEN 1 ELSE 0 END
            AS INTEGER) AS is_peak_hour
FROM transactions""", "hv AS (SELECT hour(txn_ts) AS h, count(*) AS vol FROM transactions GROUP BY 1)"))
def q_peak(spark, d):
    return FE.is_peak_hour(_t(spark, d)).select("transaction_id", "hour", "is_peak_hour")


# ---- JN5 / JN6 calendar ------------------------------------------------------------------------------

def _cal_values():
    rows = []
    for i, (name, kind, s, e, methods, vf, ff) in enumerate(S.TEST_CALENDAR):
        prio = (0 if kind == "regional" else 1000) + i
        ms = "NULL" if methods is None else "[" + ", ".join(f"'{m}'" for m in methods) + "]"
        rows.append(f"('{name}', '{kind}', DATE '{s}', DATE '{e}', {ms}, {float(vf)}, {float(ff)}, {prio})")
    return ", ".join(rows)


CAL_CTES = [
    f"""cal AS (SELECT * FROM (VALUES {_cal_values()})
  v(name, kind, start_date, end_date, affected_payment_methods, volume_factor, failure_factor, priority))""",
    """cal_days AS (SELECT cal.*, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM cal)""",
]


@register("tag_event", txn_sql("""
SELECT transaction_id, regional_event FROM transactions t
LEFT JOIN (SELECT date, arg_min(name, priority) AS regional_event FROM cal_days GROUP BY date) c
  ON CAST(t.txn_ts AS DATE) = c.date""", *CAL_CTES))
def q_tag_event(spark, d):
    return FE.tag_event(_t(spark, d), V.event_calendar(spark)).select("transaction_id", "regional_event")


_INCIDENTS = f"""inc AS (SELECT processor_id AS incident, CAST(txn_ts AS DATE) AS day, min(txn_ts) AS opened, max(txn_ts) AS closed
  FROM transactions WHERE {OK} = 0 AND processor_id IS NOT NULL GROUP BY 1, 2)"""


@register("incident_exposure", txn_sql(f"""
SELECT incident, day, opened, closed, count(*) AS n, CAST(sum(CASE WHEN {OK} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM inc JOIN transactions ON txn_ts BETWEEN opened AND closed GROUP BY 1, 2, 3, 4""", _INCIDENTS))
def q_incidents(spark, d):
    """JN5 with times: per processor and day, from the first to the last failure, the transactions (of all processors) in between."""
    t = _t(spark, d).withColumn("failed", X.is_failure("result"))
    inc = (t.where((F.col("failed") == 1) & F.col("processor_id").isNotNull()).groupBy(F.col("processor_id").alias("incident"), F.to_date("txn_ts").alias("day"))
           .agg(F.min("txn_ts").alias("opened"), F.max("txn_ts").alias("closed")))
    j = I.interval_join(t.select("txn_ts", "failed"), cut_lineage(inc), "txn_ts", "opened", "closed")
    return j.groupBy("incident", "day", "opened", "closed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("failed", F.lit(0))).cast("bigint").alias("failures"))


@register("event_factor", txn_sql("""
SELECT transaction_id, t.payment_method, greatest(coalesce(r.f, 1.0), coalesce(c.f, 0.0)) AS event_factor
FROM transactions t
LEFT JOIN (SELECT date, arg_min(failure_factor, priority) AS f FROM cal_days WHERE kind = 'regional' GROUP BY date) r
  ON CAST(t.txn_ts AS DATE) = r.date
LEFT JOIN (SELECT date, m AS payment_method, max(failure_factor) AS f
           FROM (SELECT date, unnest(affected_payment_methods) AS m, failure_factor FROM cal_days WHERE kind = 'custom') x
           GROUP BY 1, 2) c
  ON CAST(t.txn_ts AS DATE) = c.date AND t.payment_method = c.payment_method""", *CAL_CTES))
def q_event_factor(spark, d):
    return FE.event_factor(_t(spark, d), V.event_calendar(spark)).select("transaction_id", "payment_method",
                                                                         "event_factor")


# ---- JN9 ---------------------------------------------------------------------------------------------------

@register("prediction_vs_actual", txn_sql("""
SELECT s.transaction_id, round(0.98 - 0.003 * coalesce(s.network_latency, 100.0), 6) AS success_probability,
       f.actual_success
FROM transactions s LEFT JOIN (SELECT transaction_id, CASE WHEN transaction_id % 5 <> 0 THEN result = 'success' END AS actual_success
                               FROM transactions) f USING (transaction_id)"""))
def q_pred_actual(spark, d):
    scored = _t(spark, d).select("transaction_id", X.rnd(F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0)))
                                 .alias("success_probability"))
    # the outcome of every fifth prediction is not back yet
    fb = V.feedback(spark, d).select("transaction_id", F.when(F.col("transaction_id") % 5 != 0, F.col("actual_success")).alias("actual_success"))
    return FE.prediction_vs_actual(scored, fb)


# ---- WN1 / WN2 / WN6 / WN8 ------------------------------------------------------------------------------------

@register("merchant_rolling_avg_amount", txn_sql("""
SELECT transaction_id, merchant_id, round(CASE WHEN count(payment_amount) OVER w >= 1 THEN avg(payment_amount) OVER w END, 6)
       AS merchant_rolling_avg_amount
FROM transactions WINDOW w AS (PARTITION BY merchant_id ORDER BY txn_ts, transaction_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def q_wn1(spark, d):
    t = FE.merchant_rolling_avg_amount(_t(spark, d))
    return t.select("transaction_id", "merchant_id", X.rnd("merchant_rolling_avg_amount").alias("merchant_rolling_avg_amount"))


@register("payment_method_rolling_success", txn_sql(f"""
SELECT transaction_id, payment_method, round(CASE WHEN count(ok) OVER w >= 5 THEN avg(ok) OVER w END, 6)
       AS payment_method_rolling_success
FROM (SELECT *, {OK} AS ok FROM transactions) s
WINDOW w AS (PARTITION BY payment_method ORDER BY txn_ts, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""))
def q_wn2(spark, d):
    t = FE.payment_method_rolling_success(_t(spark, d))
    return t.select("transaction_id", "payment_method",
                    X.rnd("payment_method_rolling_success").alias("payment_method_rolling_success"))


@register("payment_method_rolling_success_window", txn_sql(f"""
SELECT transaction_id, payment_method, round(CASE WHEN count(ok) OVER w >= 5 THEN avg(ok) OVER w END, 6)
       AS payment_method_rolling_success
FROM (SELECT *, {OK} AS ok FROM transactions) s
WINDOW w AS (PARTITION BY payment_method ORDER BY txn_ts, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""))
def q_wn2_window(spark, d):
    t = FE.payment_method_rolling_success(_t(spark, d), method="window")
    return t.select("transaction_id", "payment_method",
                    X.rnd("payment_method_rolling_success").alias("payment_method_rolling_success"))


@register("previous_failures", txn_sql(f"""
SELECT transaction_id, customer_id, CAST(coalesce(sum({FAIL}) OVER (PARTITION BY customer_id ORDER BY txn_ts, transaction_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS previous_failures FROM transactions"""))
def q_wn6(spark, d):
    return FE.previous_failures(_t(spark, d)).select("transaction_id", "customer_id", "previous_failures")


@register("repeat_customer_rate", txn_sql("""
SELECT merchant_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_customers, round((sum(c) - count(*)) / sum(c), 6) AS repeat_rate
FROM (SELECT merchant_id, customer_id, count(*) AS c FROM transactions GROUP BY 1, 2) g GROUP BY merchant_id"""))
def q_wn8(spark, d):
    return FE.repeat_customer_rate(_t(spark, d))


# ---- the feature table ------------------------------------------------------------------------------------------

_TIME_OF_DAY = "CASE " + " ".join(f"WHEN hour >= {lo} AND hour < {hi} THEN '{lab}'" for lo, hi, lab in S.TIME_OF_DAY) + " END"


@register("features_table", txn_sql(f"""
SELECT transaction_id, amount_bin, latency_bin, count(*) OVER (PARTITION BY merchant_id) AS merchant_transaction_count,
  round(avg(ok) OVER (PARTITION BY merchant_id), 6) AS merchant_success_rate,
  round(avg(payment_amount) OVER (PARTITION BY merchant_id ORDER BY txn_ts, transaction_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6)
    AS merchant_rolling_avg_amount,
  round(CASE WHEN count(ok) OVER w >= 5 THEN avg(ok) OVER w END, 6) AS payment_method_rolling_success,
  count(*) OVER (PARTITION BY hour) AS hourly_transaction_volume,
  CAST(CASE WHEN count(*) OVER (PARTITION BY hour) > (SELECT quantile_cont(n, 0.75) FROM (SELECT count(*) AS n FROM transactions GROUP BY hour(txn_ts)) v)
       THEN 1 ELSE 0 END AS INTEGER) AS is_peak_hour,
  {_TIME_OF_DAY} AS time_of_day, {_ordcase('amount_bin', S.AMOUNT_QBIN_LABELS)} AS amount_bin_encoded,
  {_ordcase('latency_bin', S.LATENCY_QBIN_LABELS)} AS latency_bin_encoded,
  round((network_latency - (SELECT avg(network_latency) FROM transactions)) / (SELECT stddev_pop(network_latency) FROM transactions), 6)
    AS network_latency_scaled,
  round(ln(1 + payment_amount), 6) AS amount_log
FROM (SELECT t.*, CAST({OK} AS DOUBLE) AS ok, CAST(hour(txn_ts) AS INTEGER) AS hour, qb.amount_bin, qb.latency_bin
      FROM transactions t JOIN qb USING (transaction_id)) s
WINDOW w AS (PARTITION BY payment_method ORDER BY txn_ts, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", *_QBIN_CTES))
def q_features(spark, d):
    t = FE.features(_t(spark, d))
    rounded = ["merchant_success_rate", "merchant_rolling_avg_amount", "payment_method_rolling_success", "network_latency_scaled", "amount_log"]
    return t.select("transaction_id", "amount_bin", "latency_bin", "merchant_transaction_count", "hourly_transaction_volume", "is_peak_hour",
                    "time_of_day", "amount_bin_encoded", "latency_bin_encoded", *[X.rnd(c).alias(c) for c in rounded])


# ---- WN2 at scale: 5 order priorities over the star join (the skew case) ---------------------

_SALES_ORDER = ["txn_ts", "l_orderkey", "l_linenumber", "l_partkey", "merchant_key", "payment_amount"]


def _sales_rolling(spark, d, method):
    from payscope.operators import windows as W
    s = V.sales(spark, d).withColumn("f", X.is_failure("result"))
    # the input is a 6-table join: materialise it once for the multi-pass prefix plan
    r = W.rolling_rows(s, ["payment_method"], _SALES_ORDER, "f", 50, 5, "rolling_failure_rate", method=method,
                       materialize=(method == "prefix"))
    return r.select("payment_method", *_SALES_ORDER[1:], X.rnd("rolling_failure_rate").alias("rolling_failure_rate"))


_SALES_ROLL_SQL = sales_sql(f"""
SELECT payment_method, l_orderkey, l_linenumber, l_partkey, merchant_key, payment_amount,
       round(CASE WHEN count(f) OVER w >= 5 THEN avg(f) OVER w END, 6) AS rolling_failure_rate
FROM (SELECT *, {FAIL} AS f FROM sales) s
WINDOW w AS (PARTITION BY payment_method ORDER BY {', '.join(_SALES_ORDER)} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")


@register("sales_priority_rolling_failure", _SALES_ROLL_SQL)
def q_sales_roll(spark, d):
    return _sales_rolling(spark, d, "prefix")


@register("sales_priority_rolling_failure_window", _SALES_ROLL_SQL)
def q_sales_roll_window(spark, d):
    return _sales_rolling(spark, d, "window")
