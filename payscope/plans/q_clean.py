"""Profiling and cleaning queries (PR*, CL*) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import clean as C
from payscope.operators import reports as R
from payscope.plans.registry import ERR_CTE, FAIL, register, txn_sql
from payscope.sources import views as V

_TXN_COLS = ["transaction_id", "txn_ts", "merchant_id", "customer_id", "customer_location", "payment_amount",
             "payment_method", "device_type", "network_latency", "result", "processor_id", "error_code",
             "retry_count"]


def _t(spark, d):
    return V.transactions(spark, d)


def _tr(spark, d):
    return R.with_failure_reason(V.transactions(spark, d), V.error_dim(spark))


# ---- PR1-PR6 -------------------------------------------------------------------

@register("shape", txn_sql("SELECT count(*) AS n_rows, 13 AS n_cols FROM transactions"))
def q_shape(spark, d):
    return C.shape_types(_t(spark, d))


@register("missing_profile", txn_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM transactions" for c in _TXN_COLS)))
def q_missing(spark, d):
    return C.missing_profile(_t(spark, d))


@register("missing_patterns", txn_sql(
    "SELECT concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _TXN_COLS)
    + ") AS pattern, count(*) AS n FROM transactions GROUP BY 1"))
def q_missing_patterns(spark, d):
    return C.missing_patterns(_t(spark, d))


_DESC_COLS = ["payment_amount", "network_latency", "retry_count"]


@register("describe_numeric", txn_sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
  FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM transactions) s""" for c in _DESC_COLS)))
def q_describe(spark, d):
    return C.describe_numeric(_t(spark, d), _DESC_COLS)


@register("duplicate_count", txn_sql("""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS n_rows
FROM (SELECT *, count(*) AS n FROM transactions GROUP BY ALL) g"""))
def q_dups(spark, d):
    return C.duplicate_count(_t(spark, d))


@register("label_distribution", txn_sql(f"""
SELECT result, n, round(n / sum(n) OVER (), 6) AS share,
       round(sum(f) OVER () * 100.0 / sum(n) OVER (), 2) AS overall_failure_rate
FROM (SELECT result, count(*) AS n, sum({FAIL}) AS f FROM transactions GROUP BY result) g"""))
def q_label_dist(spark, d):
    return C.label_distribution(_t(spark, d))


# ---- CL1-CL3 ----------------------------------------------------------------------

@register("fill_sentinels", txn_sql("""
SELECT transaction_id, coalesce(error_code, 'no_error') AS error_code,
       coalesce(failure_reason, 'no_failure') AS failure_reason FROM txr""", ERR_CTE))
def q_fill_sentinels(spark, d):
    return C.fill_sentinels(_tr(spark, d)).select("transaction_id", "error_code", "failure_reason")


@register("fill_median_latency", txn_sql("""
SELECT transaction_id, round(coalesce(network_latency, (SELECT quantile_cont(network_latency, 0.5) FROM transactions)), 6)
       AS network_latency FROM transactions"""))
def q_fill_median(spark, d):
    t = C.fill_median(_t(spark, d), ["network_latency"])
    return t.select("transaction_id", X.rnd("network_latency").alias("network_latency"))


@register("impute_mean_latency", txn_sql("""
SELECT transaction_id, round(coalesce(network_latency, (SELECT avg(network_latency) FROM transactions)), 6)
       AS network_latency FROM transactions"""))
def q_impute_mean(spark, d):
    t = C.impute(_t(spark, d), ["network_latency"], "mean")
    return t.select("transaction_id", X.rnd("network_latency").alias("network_latency"))


@register("impute_most_frequent_error", txn_sql("""
SELECT transaction_id, coalesce(error_code, (SELECT error_code FROM transactions WHERE error_code IS NOT NULL
  GROUP BY error_code ORDER BY count(*) DESC, error_code LIMIT 1)) AS error_code FROM transactions"""))
def q_impute_mode(spark, d):
    return C.impute(_t(spark, d), ["error_code"], "most_frequent").select("transaction_id", "error_code")


@register("impute_zero_latency", txn_sql("""
SELECT transaction_id, coalesce(network_latency, 0.0) AS network_latency FROM transactions"""))
def q_impute_zero(spark, d):
    return C.impute(_t(spark, d), ["network_latency"], "zero").select("transaction_id", "network_latency")


# ---- CL4-CL7 -----------------------------------------------------------------------

_Q = "(SELECT quantile_cont(payment_amount, 0.25) AS q1, quantile_cont(payment_amount, 0.75) AS q3 FROM transactions)"


@register("outliers_iqr_amount", txn_sql(f"""
SELECT transaction_id, payment_amount FROM transactions, {_Q} q
WHERE payment_amount < q1 - 1.5 * (q3 - q1) OR payment_amount > q3 + 1.5 * (q3 - q1)"""))
def q_out_iqr(spark, d):
    t = C.flag_outliers(_t(spark, d), "payment_amount", "iqr")
    return t.where("is_outlier").select("transaction_id", "payment_amount")


@register("outliers_zscore_amount", txn_sql("""
SELECT transaction_id, payment_amount FROM transactions,
  (SELECT avg(payment_amount) AS m, stddev_samp(payment_amount) AS s FROM transactions) z
WHERE abs((payment_amount - m) / s) > 3"""))
def q_out_z(spark, d):
    t = C.flag_outliers(_t(spark, d), "payment_amount", "zscore", 3.0)
    return t.where("is_outlier").select("transaction_id", "payment_amount")


@register("outlier_report", txn_sql(" UNION ALL ".join(f"""
SELECT '{c}' AS column, CAST(count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS BIGINT)
  AS outliers, round(count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) * 100.0 / count(*), 2)
  AS outlier_pct
FROM transactions, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM transactions) q"""
                                                       for c in ["payment_amount", "network_latency"])))
def q_out_report(spark, d):
    return C.outlier_report(_t(spark, d), ["payment_amount", "network_latency"])


@register("cap_outliers_amount", txn_sql(f"""
SELECT transaction_id, round(CASE WHEN payment_amount < q1 - 1.5 * (q3 - q1) OR payment_amount > q3 + 1.5 * (q3 - q1)
  THEN cap ELSE payment_amount END, 6) AS payment_amount
FROM transactions, {_Q} q, (SELECT quantile_cont(payment_amount, 0.99) AS cap FROM transactions) c"""))
def q_cap(spark, d):
    t = C.cap_outliers(_t(spark, d), "payment_amount", 0.99, mode="reference")
    return t.select("transaction_id", X.rnd("payment_amount").alias("payment_amount"))


@register("winsorize_amount", txn_sql(f"""
SELECT transaction_id, round(CASE WHEN payment_amount < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
  WHEN payment_amount > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE payment_amount END, 6) AS payment_amount
FROM transactions, {_Q} q"""))
def q_winsor(spark, d):
    t = C.cap_outliers(_t(spark, d), "payment_amount", mode="winsor")
    return t.select("transaction_id", X.rnd("payment_amount").alias("payment_amount"))


# ---- CL8 / CL9 ----------------------------------------------------------------------

@register("standardize_text", txn_sql("""
SELECT transaction_id, lower(trim(payment_method)) AS payment_method, lower(trim(device_type)) AS device_type
FROM (SELECT transaction_id, concat('  ', upper(payment_method), ' ') AS payment_method,
             concat(upper(device_type), '   ') AS device_type FROM transactions) s"""))
def q_std_text(spark, d):
    t = _t(spark, d).select("transaction_id", F.concat(F.lit("  "), F.upper("payment_method"), F.lit(" ")).alias("payment_method"),
                            F.concat(F.upper("device_type"), F.lit("   ")).alias("device_type"))
    return C.standardize_text(t)


@register("parse_ts", txn_sql("""
SELECT transaction_id, strptime(strftime(txn_ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed_ts FROM transactions"""))
def q_parse_ts(spark, d):
    t = _t(spark, d).select("transaction_id", X.format_ts("txn_ts").alias("parsed_ts"))
    return C.parse_timestamps(t, "parsed_ts", "yyyy-MM-dd HH:mm:ss")


# ---- CL10-CL12 ------------------------------------------------------------------------

@register("box_stats_amount_by_method", txn_sql("""
SELECT q.payment_method, round(mn, 6) AS min, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(mx, 6) AS max, round(wl, 6) AS whisker_low, round(wh, 6) AS whisker_high, CAST(no AS BIGINT) AS n_outliers
FROM (SELECT payment_method, min(payment_amount) AS mn, quantile_cont(payment_amount, 0.25) AS q1,
             quantile_cont(payment_amount, 0.5) AS med, quantile_cont(payment_amount, 0.75) AS q3, max(payment_amount) AS mx
      FROM transactions WHERE payment_method IS NOT NULL AND payment_amount IS NOT NULL GROUP BY 1) q
JOIN (SELECT t.payment_method,
             min(CASE WHEN payment_amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN payment_amount END) AS wl,
             max(CASE WHEN payment_amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN payment_amount END) AS wh,
             count(CASE WHEN NOT (payment_amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS no
      FROM transactions t JOIN (SELECT payment_method, quantile_cont(payment_amount, 0.25) AS q1,
                                       quantile_cont(payment_amount, 0.75) AS q3 FROM transactions GROUP BY 1) qq
        ON t.payment_method = qq.payment_method
      WHERE payment_amount IS NOT NULL GROUP BY 1) w ON q.payment_method = w.payment_method"""))
def q_box(spark, d):
    return C.box_stats(_t(spark, d), "payment_method", "payment_amount")


@register("histogram_amount_by_result", txn_sql("""
SELECT result, bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, count(*) AS n
FROM (SELECT result, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((payment_amount - lo) / w), 29) END AS INTEGER) AS bin, lo, w
      FROM transactions, (SELECT min(payment_amount) AS lo, (max(payment_amount) - min(payment_amount)) / 30 AS w
                          FROM transactions) s
      WHERE payment_amount IS NOT NULL AND result IS NOT NULL) b
GROUP BY result, bin, lo, w"""))
def q_hist(spark, d):
    return C.histogram(_t(spark, d), "payment_amount", 30, by="result")


_KDE_CTES = [
    """st AS (SELECT min(payment_amount) AS lo, max(payment_amount) AS hi, count(payment_amount) AS n,
              stddev_samp(payment_amount) * pow(count(payment_amount), -0.2) AS bw FROM transactions)""",
    """h AS (SELECT CAST(least(floor((payment_amount - lo) / ((hi - lo) / 512)), 511) AS INTEGER) AS bin, count(*) AS cnt
      FROM transactions, st WHERE payment_amount IS NOT NULL GROUP BY 1)""",
    "g AS (SELECT range AS g FROM range(0, 200))",
]


@register("kde_amount", txn_sql("""
SELECT CAST(g AS INTEGER) AS grid_index, round(lo - 3 * bw + g * ((hi + 3 * bw) - (lo - 3 * bw)) / 199, 6) AS x,
       round(sum(cnt * exp(-0.5 * pow(((lo - 3 * bw + g * ((hi + 3 * bw) - (lo - 3 * bw)) / 199)
             - (lo + (bin + 0.5) * ((hi - lo) / 512))) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM h, g, st GROUP BY g, lo, hi, bw, n""", *_KDE_CTES))
def q_kde(spark, d):
    return C.kde(_t(spark, d), "payment_amount")


_QP1 = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
_QP2 = [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@register("exact_quantiles_amount_by_method", txn_sql(" UNION ALL ".join(
    f"SELECT payment_method, {p} AS p, round(quantile_cont(payment_amount, {p}), 6) AS value FROM transactions "
    "WHERE payment_method IS NOT NULL AND payment_amount IS NOT NULL GROUP BY payment_method" for p in _QP1)))
def q_exact_quantiles(spark, d):
    """Exact per-group quantiles computed without a single-task merge of
    distinct values (windows.exact_quantiles)."""
    from payscope.operators.windows import exact_quantiles
    q = exact_quantiles(_t(spark, d).where(F.col("payment_method").isNotNull()), "payment_amount",
                        _QP1, keys=["payment_method"])
    return q.select("payment_method", "p", X.rnd("value").alias("value"))


@register("exact_quantiles_latency", txn_sql(" UNION ALL ".join(
    f"SELECT {p} AS p, round(quantile_cont(network_latency, {p}), 6) AS value FROM transactions "
    "WHERE network_latency IS NOT NULL" for p in _QP2)))
def q_exact_quantiles_global(spark, d):
    from payscope.operators.windows import exact_quantiles
    q = exact_quantiles(_t(spark, d), "network_latency", _QP2)
    return q.select("p", X.rnd("value").alias("value"))
