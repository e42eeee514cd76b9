"""Report queries (AG*, TK*, WN3-WN4, WN9-WN10, JN2-JN3, ST*) over the
transactions and sales views."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import reports as R
from payscope.plans.registry import ERR_CTE, FAIL, LOG_CTE, OK, register, sales_sql, txn_sql
from payscope.sources import views as V


def _t(spark, d):
    return V.transactions(spark, d)


def _tr(spark, d):
    return R.with_failure_reason(V.transactions(spark, d), V.error_dim(spark))


# ---- derived key columns, Spark side and SQL side ---------------------------

_KEY_SPARK = {
    "hour": lambda: F.hour("txn_ts").cast("int"),
    "day_name": lambda: X.day_name("txn_ts"),
    "date": lambda: F.to_date("txn_ts"),
    "amount_bin": lambda: X.amount_bin_fixed("payment_amount"),
    "amount_bin_open": lambda: X.amount_bin_open("payment_amount"),
}

_AMOUNT_BIN_SQL = """CASE WHEN payment_amount >= 0 AND payment_amount <= 50 THEN '$0-50'
  WHEN payment_amount > 50 AND payment_amount <= 100 THEN '$50-100'
  WHEN payment_amount > 100 AND payment_amount <= 200 THEN '$100-200'
  WHEN payment_amount > 200 AND payment_amount <= 300 THEN '$200-300'
  WHEN payment_amount > 300 AND payment_amount <= 400 THEN '$300-400'
  WHEN payment_amount > 400 AND payment_amount <= 500 THEN '$400-500'
  WHEN payment_amount > 500 AND payment_amount <= 900 THEN '$500-900' END"""

_AMOUNT_BIN_OPEN_SQL = """CASE WHEN payment_amount > 0 AND payment_amount <= 50 THEN '<$50'
  WHEN payment_amount > 50 AND payment_amount <= 100 THEN '$50-100'
  WHEN payment_amount > 100 AND payment_amount <= 200 THEN '$100-200'
  WHEN payment_amount > 200 AND payment_amount <= 500 THEN '$200-500'
  WHEN payment_amount > 500 AND payment_amount <= 1000 THEN '$500-1000'
  WHEN payment_amount > 1000 THEN '>$1000' END"""

_KEY_SQL = {
    "hour": "CAST(hour(txn_ts) AS INTEGER)",
    "day_name": "dayname(txn_ts)",
    "date": "CAST(txn_ts AS DATE)",
    "amount_bin": _AMOUNT_BIN_SQL,
    "amount_bin_open": _AMOUNT_BIN_OPEN_SQL,
}


def _with_keys(df, keys):
    for k in keys:
        if k in _KEY_SPARK:
            df = df.withColumn(k, _KEY_SPARK[k]())
    return df


def _key_select_sql(keys):
    return ", ".join(f"{_KEY_SQL.get(k, k)} AS {k}" for k in keys)


def _fr_sql(keys, source="transactions"):
    ks = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    body = f"""SELECT {ks}, count(*) AS total_transactions, CAST(sum(f) AS BIGINT) AS failed_transactions,
  round(100.0 * CAST(sum(f) AS DOUBLE) / count(*), 2) AS failure_rate
FROM (SELECT {_key_select_sql(keys)}, {FAIL} AS f FROM {source}) s WHERE {nn} GROUP BY {ks}"""
    return body


def _sr_sql(keys, source="transactions"):
    ks = ", ".join(keys)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT {ks}, count(*) AS n, round(avg(ok) * 100.0, 2) AS success_rate
FROM (SELECT {_key_select_sql(keys)}, {OK} AS ok FROM {source}) s WHERE {nn} GROUP BY {ks}"""


# ---- AG1: failure rate by one query per key set -----------------------------

_AG1_KEYS = {
    "payment_method": ["payment_method"],
    "processor": ["processor_id"],
    "location": ["customer_location"],
    "hour": ["hour"],
    "day": ["day_name"],
    "amount_bin": ["amount_bin"],
    "date": ["date"],
    "merchant": ["merchant_id"],
    "method_merchant": ["payment_method", "merchant_id"],
    "method_hour": ["payment_method", "hour"],
    "method_amount_bin": ["payment_method", "amount_bin"],
}


def _mk_fr(keys):
    def q(spark, d):
        return R.failure_rate_by(_with_keys(_t(spark, d), keys), keys)
    return q


for _name, _keys in _AG1_KEYS.items():
    register(f"failure_rate_by_{_name}", txn_sql(_fr_sql(_keys)))(_mk_fr(_keys))


# ---- AG2: success rate -------------------------------------------------------

_AG2_KEYS = {
    "payment_method": ["payment_method"],
    "device": ["device_type"],
    "amount_bin_open": ["amount_bin_open"],
    "hour": ["hour"],
    "day": ["day_name"],
    "location": ["customer_location"],
    "location_device": ["customer_location", "device_type"],
    "date": ["date"],
    "retry_count": ["retry_count"],
}


def _mk_sr(keys):
    def q(spark, d):
        return R.success_rate_by(_with_keys(_t(spark, d), keys), keys)
    return q


for _name, _keys in _AG2_KEYS.items():
    register(f"success_rate_by_{_name}", txn_sql(_sr_sql(_keys)))(_mk_sr(_keys))


# ---- scale versions over the sales view --------------------------------------

@register("sales_failure_rate_by_priority_region",
          sales_sql(_fr_sql(["payment_method", "customer_location"], source="sales")))
def sales_failure_rate(spark, d):
    return R.failure_rate_by(V.sales(spark, d), ["payment_method", "customer_location"])


@register("sales_merchant_volume_top", sales_sql("""
SELECT merchant_key, count(*) AS n, round(sum(payment_amount), 4) AS total_amount,
       round(avg(CASE WHEN result = 'success' THEN 1 ELSE 0 END) * 100.0, 2) AS success_rate
FROM sales GROUP BY merchant_key ORDER BY n DESC, merchant_key LIMIT 10"""))
def sales_merchant_top(spark, d):
    s = V.sales(spark, d)
    g = s.groupBy("merchant_key").agg(F.count(F.lit(1)).alias("n"), X.rnd(F.sum("payment_amount"), 4).alias("total_amount"),
                                      F.round(F.avg(X.is_success("result")) * 100.0, 2).alias("success_rate"))
    return g.orderBy(F.desc("n"), "merchant_key").limit(10)


# ---- AG3 / AG15 / AG27 --------------------------------------------------------

@register("kpis", txn_sql("""
SELECT CASE WHEN gid = 3 THEN 'all' WHEN gid = 1 THEN 'payment_method' ELSE 'device_type' END AS dimension,
       CASE WHEN gid = 3 THEN 'all' WHEN gid = 1 THEN payment_method ELSE device_type END AS key,
       n, success_rate, avg_amount, avg_latency, total_volume
FROM (SELECT payment_method, device_type, grouping(payment_method, device_type) AS gid, count(*) AS n,
             round(avg(ok) * 100.0, 2) AS success_rate, round(avg(payment_amount), 6) AS avg_amount,
             round(avg(network_latency), 6) AS avg_latency, round(sum(payment_amount), 4) AS total_volume
      FROM (SELECT *, """ + OK + """ AS ok FROM transactions) s
      GROUP BY GROUPING SETS ((), (payment_method), (device_type))) g"""))
def q_kpis(spark, d):
    return R.kpis(_t(spark, d))


@register("daily_avg_count", txn_sql("""
SELECT round(avg(n), 4) AS avg_daily_count, count(*) AS n_days
FROM (SELECT CAST(txn_ts AS DATE) AS date, count(*) AS n FROM transactions GROUP BY 1) d"""))
def q_daily_avg(spark, d):
    return R.daily_avg_count(_t(spark, d))


@register("date_bounds", txn_sql("""
SELECT CAST(min(txn_ts) AS DATE) AS first_date, CAST(max(txn_ts) AS DATE) AS last_date FROM transactions"""))
def q_date_bounds(spark, d):
    return R.date_bounds(_t(spark, d))


# ---- AG4 / TK1 / AG26 / AG5 / AG6 / AG8 ------------------------------------------

_ERR_TABLE_SQL = """err AS (SELECT error_code, count(*) AS n, min(failure_reason) AS failure_reason
  FROM txr WHERE result IN ('failure', 'failed') AND error_code IS NOT NULL GROUP BY error_code),
errt AS (SELECT error_code, n, failure_reason, round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (), 1) AS share_pct FROM err)"""


@register("error_table", txn_sql("SELECT * FROM errt", ERR_CTE, _ERR_TABLE_SQL))
def q_error_table(spark, d):
    return R.error_table(_tr(spark, d))


@register("top_errors", txn_sql("SELECT * FROM errt ORDER BY n DESC, error_code LIMIT 3", ERR_CTE, _ERR_TABLE_SQL))
def q_top_errors(spark, d):
    return R.top_errors(_tr(spark, d), 3)


@register("combined_error_share", txn_sql("""
SELECT round(sum(CASE WHEN error_code IN ('E002', 'E005') THEN share_pct ELSE 0.0 END), 1) AS combined_share_pct
FROM errt""", ERR_CTE, _ERR_TABLE_SQL))
def q_combined_error_share(spark, d):
    return R.combined_error_share(_tr(spark, d))


_CODES = [f"E{i:03d}" for i in range(1, 11)]


@register("error_share_by_method", txn_sql(
    "SELECT payment_method, " + ", ".join(
        f"round(CAST(count(CASE WHEN error_code = '{c}' THEN 1 END) AS DOUBLE) * 100.0 / count(*), 4) AS {c}"
        for c in _CODES)
    + " FROM transactions WHERE result IN ('failure', 'failed') AND error_code IS NOT NULL"
      " AND payment_method IS NOT NULL GROUP BY payment_method"))
def q_error_share_by_method(spark, d):
    return R.error_share_by_method(_t(spark, d))


@register("contingency_method_result", txn_sql("""
SELECT payment_method, count(CASE WHEN result = 'failure' THEN 1 END) AS failure,
       count(CASE WHEN result = 'success' THEN 1 END) AS success
FROM transactions WHERE payment_method IS NOT NULL AND result IS NOT NULL GROUP BY payment_method"""))
def q_contingency(spark, d):
    return R.contingency(_t(spark, d), "payment_method", "result", ["failure", "success"])


@register("error_share_by_processor", txn_sql("""
SELECT processor_id, failure_reason, n, round(n * 100.0 / sum(n) OVER (PARTITION BY processor_id), 1) AS share_pct
FROM (SELECT processor_id, failure_reason, count(*) AS n FROM txr
      WHERE result IN ('failure', 'failed') AND failure_reason IS NOT NULL GROUP BY 1, 2) g""", ERR_CTE))
def q_error_share_by_processor(spark, d):
    return R.error_share_by_processor(_tr(spark, d))


# ---- AG7 heatmaps ---------------------------------------------------------------

def _heat_sql(row_key_sql, row_key):
    cols = ", ".join(
        f"round(avg(CASE WHEN h = {h} THEN f END) * 100.0, 2) AS h{h}" for h in range(24))
    return txn_sql(f"""SELECT {row_key}, {cols}
FROM (SELECT {row_key_sql} AS {row_key}, hour(txn_ts) AS h, {FAIL} AS f FROM transactions) s
WHERE {row_key} IS NOT NULL GROUP BY {row_key}""")


@register("heatmap_day_hour", _heat_sql("dayname(txn_ts)", "day_name"))
def q_heat_day(spark, d):
    return R.heatmap_pivot(_t(spark, d).withColumn("day_name", X.day_name("txn_ts")), "day_name")


@register("heatmap_method_hour", _heat_sql("payment_method", "payment_method"))
def q_heat_method(spark, d):
    return R.heatmap_pivot(_t(spark, d), "payment_method")


# ---- AG9 / AG10 / AG11 --------------------------------------------------------------

@register("processor_scorecard", txn_sql("""
SELECT processor_id, count(*) AS n, round(avg(""" + FAIL + """) * 100.0, 2) AS failure_rate,
       round(avg(payment_amount), 6) AS avg_amount,
       round(avg(CASE WHEN lower(trim(customer_location)) = 'urban' THEN 1 ELSE 0 END) * 100.0, 2) AS urban_pct,
       count(CASE WHEN payment_method = 'credit_card' THEN 1 END) AS n_credit_card,
       count(CASE WHEN payment_method = 'debit_card' THEN 1 END) AS n_debit_card,
       count(CASE WHEN payment_method = 'mobile_money' THEN 1 END) AS n_mobile_money,
       count(CASE WHEN payment_method = 'USSD' THEN 1 END) AS n_ussd,
       count(CASE WHEN payment_method = 'bank_transfer' THEN 1 END) AS n_bank_transfer
FROM transactions WHERE processor_id IS NOT NULL GROUP BY processor_id"""))
def q_processor_scorecard(spark, d):
    return R.processor_scorecard(_t(spark, d))


@register("slot_profile", txn_sql("""
SELECT hour, day_of_week, is_weekend, count(*) AS n, round(avg(f), 6) AS failure_mean,
       round(avg(payment_amount), 6) AS avg_amount
FROM (SELECT CAST(hour(txn_ts) AS INTEGER) AS hour, CAST(isodow(txn_ts) - 1 AS INTEGER) AS day_of_week,
             CAST(CASE WHEN isodow(txn_ts) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
             """ + FAIL + """ AS f, payment_amount FROM transactions) s
GROUP BY 1, 2, 3"""))
def q_slot_profile(spark, d):
    return R.slot_profile(_t(spark, d))


def _gmc_sql(key):
    return txn_sql(f"""SELECT {key}, round(avg({OK}), 6) AS mean, count(*) AS count
FROM transactions WHERE {key} IS NOT NULL GROUP BY {key}""")


@register("group_mean_count_processor", _gmc_sql("processor_id"))
def q_gmc_proc(spark, d):
    return R.group_mean_count(_t(spark, d), "processor_id")


@register("group_mean_count_method", _gmc_sql("payment_method"))
def q_gmc_method(spark, d):
    return R.group_mean_count(_t(spark, d), "payment_method")


# ---- AG12 / AG13 / AG14 / JN3 / AG22 / ST3 -----------------------------------------------

_MERCH_SQL = """ms AS (SELECT merchant_id, count(*) AS n, round(sum(payment_amount), 4) AS total_amount,
  round(avg(""" + OK + """) * 100.0, 2) AS success_rate FROM transactions WHERE merchant_id IS NOT NULL GROUP BY merchant_id)"""


@register("merchant_volume_top", txn_sql("SELECT * FROM ms ORDER BY n DESC, merchant_id LIMIT 10", _MERCH_SQL))
def q_merchant_top(spark, d):
    return R.merchant_volume_top(_t(spark, d), 10)


@register("merchant_lowest", txn_sql(
    "SELECT * FROM ms WHERE n >= 10 ORDER BY success_rate, merchant_id LIMIT 10", _MERCH_SQL))
def q_merchant_lowest(spark, d):
    return R.merchant_lowest(_t(spark, d), 10, 10)


@register("mix_location_method", txn_sql("""
SELECT customer_location, payment_method, count(*) AS n FROM transactions
WHERE customer_location IS NOT NULL AND payment_method IS NOT NULL GROUP BY 1, 2"""))
def q_mix_loc(spark, d):
    return R.mix_counts(_t(spark, d), "customer_location", "payment_method")


@register("mix_merchant_method", txn_sql("""
SELECT merchant_id, payment_method, count(*) AS n FROM transactions
WHERE merchant_id IS NOT NULL AND payment_method IS NOT NULL GROUP BY 1, 2"""))
def q_mix_merchant(spark, d):
    return R.mix_counts(_t(spark, d), "merchant_id", "payment_method")


@register("semi_top_merchants", txn_sql("""
SELECT payment_method, count(*) AS n, round(sum(payment_amount), 4) AS amount FROM transactions
WHERE merchant_id IN (SELECT merchant_id FROM ms ORDER BY n DESC, merchant_id LIMIT 5)
GROUP BY payment_method""", _MERCH_SQL))
def q_semi_top(spark, d):
    rows = R.semi_top_merchants(_t(spark, d), 5)
    return rows.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n"),
                                              X.rnd(F.sum("payment_amount"), 4).alias("amount"))


@register("distinct_processors", txn_sql(
    "SELECT count(DISTINCT processor_id) AS n_distinct_processor_id FROM transactions"))
def q_distinct_proc(spark, d):
    return R.distinct_count(_t(spark, d), "processor_id")


@register("distinct_methods", txn_sql(
    "SELECT DISTINCT payment_method FROM transactions WHERE payment_method IS NOT NULL ORDER BY 1"))
def q_distinct_methods(spark, d):
    return R.distinct_values(_t(spark, d), "payment_method")


# ---- AG17-AG19 -----------------------------------------------------------------------

_CORR_COLS = ["payment_amount", "network_latency", "retry_count", "hour", "is_failure"]


def _corr_frame(spark, d):
    return _t(spark, d).select("payment_amount", "network_latency", "retry_count",
                               F.hour("txn_ts").alias("hour"), X.is_failure("result").alias("is_failure"))


_CORR_SRC = f"""cs AS (SELECT payment_amount, network_latency, CAST(retry_count AS DOUBLE) AS retry_count,
  CAST(hour(txn_ts) AS DOUBLE) AS hour, CAST({FAIL} AS DOUBLE) AS is_failure FROM transactions)"""


def _corr_pairs_sql(where=""):
    pairs = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]
    sel = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM cs" for a, b in pairs)
    return f"SELECT * FROM ({sel}) p {where}"


@register("corr_matrix", txn_sql(_corr_pairs_sql(), _CORR_SRC))
def q_corr(spark, d):
    return R.corr_long(_corr_frame(spark, d), _CORR_COLS)


@register("high_corr_pairs", txn_sql(_corr_pairs_sql("WHERE abs(corr) > 0.7"), _CORR_SRC))
def q_high_corr(spark, d):
    return R.high_corr_pairs(_corr_frame(spark, d), _CORR_COLS, 0.7)


@register("corr_with_target", txn_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, is_failure), 6) AS corr FROM cs" for c in _CORR_COLS[:-1]), _CORR_SRC))
def q_corr_target(spark, d):
    return R.corr_with_target(_corr_frame(spark, d), _CORR_COLS[:-1], "is_failure")


# ---- AG20 / AG21 -----------------------------------------------------------------------------

@register("latency_percentiles", "WITH " + LOG_CTE + """
SELECT count(*) AS n, round(avg(response_time_s), 6) AS mean_s,
       round(quantile_cont(response_time_s, 0.95), 6) AS p95_s,
       round(quantile_cont(response_time_s, 0.99), 6) AS p99_s,
       round(avg(CASE WHEN status = 200 THEN 1 ELSE 0 END), 6) AS success_share FROM request_log""")
def q_latency_pct(spark, d):
    return R.latency_percentiles(V.request_log(spark, d))


@register("unpivot_method_metrics", txn_sql("""
SELECT payment_method, metric, value FROM (
  SELECT payment_method, CAST(count(*) AS DOUBLE) AS n, round(avg(ok) * 100.0, 2) AS success_rate,
         round(avg(payment_amount), 6) AS avg_amount
  FROM (SELECT *, """ + OK + """ AS ok FROM transactions) s GROUP BY payment_method) g
UNPIVOT (value FOR metric IN (n, success_rate, avg_amount))"""))
def q_unpivot(spark, d):
    g = _t(spark, d).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(X.is_success("result")) * 100.0, 2).alias("success_rate"),
        X.rnd(F.avg("payment_amount")).alias("avg_amount"))
    return R.unpivot_metrics(g, "payment_method", ["n", "success_rate", "avg_amount"])


# ---- AG25: CI of a mean -------------------------------------------------------------------------

@register("mean_ci_normal_method", txn_sql("""
SELECT payment_method, count(*) AS n, round(avg(ok), 6) AS mean,
       round(avg(ok) - 1.959963984540054 * stddev_samp(ok) / sqrt(count(*)), 6) AS ci_low,
       round(avg(ok) + 1.959963984540054 * stddev_samp(ok) / sqrt(count(*)), 6) AS ci_high
FROM (SELECT payment_method, CAST(""" + OK + """ AS DOUBLE) AS ok FROM transactions) s
WHERE payment_method IS NOT NULL AND ok IS NOT NULL GROUP BY payment_method"""))
def q_ci_normal(spark, d):
    return R.mean_ci_normal(_t(spark, d).withColumn("ok", X.is_success("result")), "payment_method", "ok")


@register("mean_ci_bootstrap_method")
def q_ci_boot(spark, d):
    return R.mean_ci_bootstrap(_t(spark, d).withColumn("ok", X.is_success("result")),
                               "payment_method", "ok", "transaction_id")


# ---- TK2-TK7 ----------------------------------------------------------------------------------

def _fr_cte(name, keys):
    return f"{name} AS ({_fr_sql(keys)})"


def _extreme_sql(src, key):
    return f"""SELECT arg_min({key}, struct_pack(a := -failure_rate, b := {key})) AS worst_key, max(failure_rate) AS worst_rate,
       arg_min({key}, struct_pack(a := failure_rate, b := {key})) AS best_key, min(failure_rate) AS best_rate,
       round(max(failure_rate) / min(failure_rate), 4) AS max_min_ratio FROM {src} WHERE failure_rate IS NOT NULL"""


for _dim, _keys in [("payment_method", ["payment_method"]), ("processor", ["processor_id"]),
                    ("location", ["customer_location"]), ("merchant", ["merchant_id"])]:
    def _mk_ext(keys):
        def q(spark, d):
            return R.extremes(R.failure_rate_by(_t(spark, d), keys), keys[0], "failure_rate")
        return q
    register(f"extremes_{_dim}", txn_sql(_extreme_sql("fr", _keys[0]), _fr_cte("fr", _keys)))(_mk_ext(_keys))


@register("peak_hours", txn_sql("SELECT * FROM fr ORDER BY failure_rate DESC, hour LIMIT 3",
                                _fr_cte("fr", ["hour"])))
def q_peak_hours(spark, d):
    return R.top_by(R.failure_rate_by(_with_keys(_t(spark, d), ["hour"]), ["hour"]), "failure_rate", "hour", 3)


@register("peak_days", txn_sql("SELECT * FROM fr ORDER BY failure_rate DESC, day_name LIMIT 2",
                               _fr_cte("fr", ["day_name"])))
def q_peak_days(spark, d):
    return R.top_by(R.failure_rate_by(_with_keys(_t(spark, d), ["day_name"]), ["day_name"]),
                    "failure_rate", "day_name", 2)


@register("hours_above_q75", txn_sql("""
SELECT hour, failure_rate FROM fr WHERE failure_rate >= (SELECT quantile_cont(failure_rate, 0.75) FROM fr)""",
                                     _fr_cte("fr", ["hour"])))
def q_hours_q75(spark, d):
    return R.hours_above_q(R.failure_rate_by(_with_keys(_t(spark, d), ["hour"]), ["hour"]))


@register("value_counts_method", txn_sql("""
SELECT payment_method, count(*) AS count FROM transactions WHERE payment_method IS NOT NULL GROUP BY 1"""))
def q_value_counts(spark, d):
    return R.value_counts(_t(spark, d), "payment_method")


@register("sort_by_weekday", txn_sql(_fr_sql(["day_name"]) + """
ORDER BY CASE day_name WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2 WHEN 'Thursday' THEN 3
  WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 ELSE 6 END"""))
def q_sort_weekday(spark, d):
    return R.sort_by_weekday(R.failure_rate_by(_with_keys(_t(spark, d), ["day_name"]), ["day_name"]))


@register("find_summary", txn_sql("""
SELECT 'top_error' AS finding, error_code AS key, share_pct AS value FROM (SELECT * FROM errt ORDER BY n DESC, error_code LIMIT 1) a
UNION ALL SELECT 'worst_method', worst_key, worst_rate FROM (""" + _extreme_sql("frm", "payment_method") + """) b
UNION ALL SELECT 'best_method', best_key, best_rate FROM (""" + _extreme_sql("frm", "payment_method") + """) b2
UNION ALL SELECT 'worst_processor', worst_key, worst_rate FROM (""" + _extreme_sql("frp", "processor_id") + """) c
UNION ALL SELECT 'worst_location', worst_key, worst_rate FROM (""" + _extreme_sql("frl", "customer_location") + """) d
UNION ALL SELECT 'peak_hour', CAST(hour AS VARCHAR), failure_rate FROM (SELECT * FROM frh ORDER BY failure_rate DESC, hour LIMIT 1) e
UNION ALL SELECT 'peak_day', day_name, failure_rate FROM (SELECT * FROM frd ORDER BY failure_rate DESC, day_name LIMIT 1) f
UNION ALL SELECT 'worst_amount_bin', worst_key, worst_rate FROM (""" + _extreme_sql("fra", "amount_bin") + """) g
UNION ALL SELECT 'worst_merchant', worst_key, worst_rate FROM (""" + _extreme_sql("frme", "merchant_id") + """) h
UNION ALL SELECT 'combined_e002_e005', 'E002+E005', sum(CASE WHEN error_code IN ('E002', 'E005') THEN share_pct ELSE 0.0 END) FROM errt""",
    ERR_CTE, _ERR_TABLE_SQL, _fr_cte("frm", ["payment_method"]), _fr_cte("frp", ["processor_id"]),
    _fr_cte("frl", ["customer_location"]), _fr_cte("frh", ["hour"]), _fr_cte("frd", ["day_name"]),
    _fr_cte("fra", ["amount_bin"]), _fr_cte("frme", ["merchant_id"])))
def q_find_summary(spark, d):
    """TK7 from one GROUPING SETS scan (operators.reports.key_findings)."""
    t = _with_keys(_t(spark, d), ["hour", "day_name", "amount_bin"])
    return R.key_findings(t)


@register("head_10", txn_sql("""
SELECT transaction_id, merchant_id, payment_amount, result FROM transactions ORDER BY transaction_id LIMIT 10"""))
def q_head(spark, d):
    return R.head(_t(spark, d).select("transaction_id", "merchant_id", "payment_amount", "result"), 10)


@register("sample_rows_100", txn_sql("""
SELECT transaction_id, merchant_id, payment_amount, result FROM transactions
ORDER BY md5(CAST(transaction_id AS VARCHAR) || '|42') LIMIT 100"""))
def q_sample(spark, d):
    return R.sample_rows(_t(spark, d).select("transaction_id", "merchant_id", "payment_amount", "result"), 100)


# ---- WN3 / WN4 / WN9 / WN10 -------------------------------------------------------------------------

@register("rolling_7d_failure", txn_sql("""
SELECT *, CASE WHEN count(*) OVER w >= 7 THEN round(avg(failure_rate) OVER w, 4) END AS rolling_failure_rate
FROM fr WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", _fr_cte("fr", ["date"])))
def q_rolling7(spark, d):
    return R.rolling_daily_failure(_t(spark, d), 7)


@register("share_of_group_location_method", txn_sql("""
SELECT customer_location, payment_method, n, round(n / sum(n) OVER (PARTITION BY customer_location), 6) AS share
FROM (SELECT customer_location, payment_method, count(*) AS n FROM transactions
      WHERE customer_location IS NOT NULL AND payment_method IS NOT NULL GROUP BY 1, 2) g"""))
def q_share_group(spark, d):
    return R.share_of_group(R.mix_counts(_t(spark, d), "customer_location", "payment_method"),
                            "customer_location", "n")


@register("period_over_period_week", txn_sql("""
SELECT period_start, n, success_rate, avg_amount, n - lag(n) OVER w AS n_change,
       round(success_rate - lag(success_rate) OVER w, 2) AS success_rate_change,
       round(avg_amount - lag(avg_amount) OVER w, 6) AS avg_amount_change
FROM (SELECT CAST(date_trunc('week', txn_ts) AS DATE) AS period_start, count(*) AS n,
             round(avg(""" + OK + """) * 100.0, 2) AS success_rate, round(avg(payment_amount), 6) AS avg_amount
      FROM transactions GROUP BY 1) g WINDOW w AS (ORDER BY period_start)"""))
def q_pop(spark, d):
    return R.period_over_period(_t(spark, d), "week")


@register("latest_10", txn_sql("""
SELECT transaction_id, txn_ts, merchant_id, payment_amount, result FROM transactions
ORDER BY txn_ts DESC, transaction_id DESC LIMIT 10"""))
def q_latest(spark, d):
    return R.latest_k(_t(spark, d).select("transaction_id", "txn_ts", "merchant_id", "payment_amount", "result"), 10)


# ---- ST1 / ST4 ----------------------------------------------------------------------------------------

@register("union_training_feedback", txn_sql("""
SELECT transaction_id, payment_amount, result, NULL::BOOLEAN AS actual_success FROM transactions
UNION ALL
SELECT transaction_id, NULL::DOUBLE AS payment_amount, NULL::VARCHAR AS result, actual_success FROM feedback""",
                                                  "feedback AS (SELECT transaction_id, result = 'success' AS actual_success FROM transactions)"))
def q_union(spark, d):
    t = _t(spark, d).select("transaction_id", "payment_amount", "result")
    fb = V.feedback(spark, d).select("transaction_id", "actual_success")
    return R.union_files(t, fb)


@register("rows_without_label", txn_sql("""
SELECT merchant_id, payment_amount, payment_method FROM transactions"""))
def q_drop(spark, d):
    return R.rows_without(_t(spark, d).select("transaction_id", "merchant_id", "payment_amount", "payment_method", "result"),
                          "transaction_id", "result", "not_there")


# ---- AG16 / TK9 / SC27 -----------------------------------------------------------------------

@register("class_weights", txn_sql(f"""
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight,
       round(n_c / sum(n_c) OVER (), 6) AS share
FROM (SELECT CAST({OK} AS INTEGER) AS label, count(*) AS n_c FROM transactions WHERE {OK} IS NOT NULL GROUP BY 1) g"""))
def q_class_weights(spark, d):
    return R.class_weights(_t(spark, d).withColumn("label", X.is_success("result")), "label")


@register("sort_by_time", txn_sql("SELECT transaction_id, txn_ts, payment_amount FROM transactions"))
def q_sort_by_time(spark, d):
    return R.sort_by_time(_t(spark, d).select("transaction_id", "txn_ts", "payment_amount"))


_COLUMNS = ["transaction_id", "txn_ts", "merchant_id", "customer_id", "customer_location", "payment_amount", "payment_method", "device_type",
            "network_latency", "result", "processor_id", "error_code", "retry_count"]


@register("columns_by_type", txn_sql("SELECT kind, column_name, n FROM (" + " UNION ALL ".join(
    f"""SELECT CASE WHEN any_value(typeof({c})) IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric' ELSE 'categorical' END AS kind, '{c}' AS column_name, count({c}) AS n FROM transactions""" for c in _COLUMNS) + ") x"))
def q_columns_by_type(spark, d):
    """The columns of each kind with their non-NULL rows (one aggregation)."""
    from payscope.operators.clean import columns_by_type
    t = _t(spark, d)
    kinds = {c: kind for kind in ("numeric", "categorical") for c in columns_by_type(t, kind)}
    row = t.agg(*[F.count(c).alias(c) for c in kinds])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column_name"), F.col(c).alias("n"))
                                          for c, k in kinds.items()])).alias("r")).select("r.*")
