"""Statistical tests, A/B tables and business formulas (HT*, RO15-RO17, AG24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import features as FE
from payscope.operators import stats as ST
from payscope.plans.registry import FAIL, LOG_CTE, OK, register, txn_sql
from payscope.sources import views as V

HASH_SQL = "CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|42'), 1, 7))::BIGINT % 100 AS INTEGER)"


def _ab_frame(spark, d):
    t = V.transactions(spark, d)
    t = FE.previous_failures(t)
    t = t.withColumn("model_probability", F.lit(0.98) - 0.003 * F.col("network_latency"))
    return ST.ab_outcomes(t)


AB_CTES = [
    f"""pf AS (SELECT *, coalesce(sum({FAIL}) OVER (PARTITION BY customer_id ORDER BY txn_ts, transaction_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_failures,
       0.98 - 0.003 * network_latency AS model_probability,
       CASE WHEN {HASH_SQL} < 50 THEN 'new' ELSE 'old' END AS assigned_arm FROM transactions)""",
    """pr AS (SELECT *, assigned_arm = 'new' AND model_probability IS NOT NULL AS use_model,
       CASE WHEN payment_amount > 1000 THEN 0.5 WHEN previous_failures > 0 THEN 0.4 ELSE 0.7 END AS rule_probability,
       CASE WHEN payment_amount > 1000 THEN 'review' WHEN previous_failures > 0 THEN 'review' ELSE 'route' END AS rule_action
     FROM pf)""",
    """pd AS (SELECT *, CASE WHEN use_model THEN model_probability ELSE rule_probability END AS p,
       CASE WHEN use_model THEN (CASE WHEN model_probability > 0.5 THEN 'route' ELSE 'review' END) ELSE rule_action END AS act
     FROM pr)""",
    """ab AS (SELECT transaction_id, assigned_arm, CASE WHEN use_model THEN 'new' ELSE 'old' END AS served_by,
       assigned_arm AS strategy, act AS recommended_action, p AS predicted_probability,
       CASE WHEN act = 'review' AND p < 0.6 THEN least(0.9, p + 0.3) WHEN act = 'route' AND p > 0.7 THEN p
            ELSE greatest(0.1, p - 0.1) END AS adjusted_probability,
       result = 'success' AS success, network_latency / 100.0 AS processing_time FROM pd)""",
]


@register("ab_outcomes", txn_sql("""
SELECT transaction_id, assigned_arm, served_by, strategy, recommended_action, round(predicted_probability, 6) AS predicted_probability,
       round(adjusted_probability, 6) AS adjusted_probability, success, round(processing_time, 6) AS processing_time FROM ab""",
                                 *AB_CTES))
def q_ab_outcomes(spark, d):
    o = _ab_frame(spark, d)
    return o.select("transaction_id", "assigned_arm", "served_by", "strategy", "recommended_action",
                    X.rnd("predicted_probability").alias("predicted_probability"),
                    X.rnd("adjusted_probability").alias("adjusted_probability"), "success",
                    X.rnd("processing_time").alias("processing_time"))


@register("rule_routing", txn_sql("""
SELECT transaction_id, CAST(previous_failures AS BIGINT) AS previous_failures, rule_probability, rule_action FROM pr""",
                                  *AB_CTES[:2]))
def q_rule_routing(spark, d):
    t = FE.previous_failures(V.transactions(spark, d))
    return ST.rule_routing(t).select("transaction_id", "previous_failures", "rule_probability", "rule_action")


@register("ab_strategy_summary", txn_sql("""
SELECT strategy, count(*) AS n, round(avg(CAST(success AS INTEGER)), 6) AS success_rate,
       round(avg(processing_time), 6) AS mean_processing_time FROM ab GROUP BY strategy""", *AB_CTES))
def q_ab_summary(spark, d):
    return ST.strategy_summary(_ab_frame(spark, d))


@register("ab_lift", txn_sql("""
SELECT round(c, 6) AS control_rate, round(t, 6) AS treatment_rate, round(t - c, 6) AS abs_lift, round((t - c) / c, 6) AS rel_lift
FROM (SELECT max(CASE WHEN strategy = 'old' THEN r END) AS c, max(CASE WHEN strategy = 'new' THEN r END) AS t
      FROM (SELECT strategy, avg(CAST(success AS INTEGER)) AS r FROM ab GROUP BY 1) s) x""", *AB_CTES))
def q_ab_lift(spark, d):
    return ST.lift(_ab_frame(spark, d))


def _chi2_sql(a, b, src):
    return [
        f"cells AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS o FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)",
        "c2 AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c, sum(o) OVER () AS n FROM cells)",
        "rr AS (SELECT count(*) AS nr, sum(1.0 / r) AS ir FROM (SELECT DISTINCT a, r FROM c2) x)",
        "cc AS (SELECT count(*) AS nc, sum(1.0 / c) AS ic FROM (SELECT DISTINCT b, c FROM c2) y)",
        "s AS (SELECT max(n) AS n, sum(o * o / (r * c)) AS q, max(abs(o - r * c / n)) AS dev FROM c2)",
    ]


_CHI2_BODY = """SELECT round(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN pow(greatest(dev - 0.5, 0.0), 2) * n * ir * ic
                     ELSE n * (q - 1.0) END, 6) AS chi2,
       CAST((nr - 1) * (nc - 1) AS INTEGER) AS dof, CAST(n AS BIGINT) AS n FROM s, rr, cc"""


@register("ab_chi2", txn_sql(_CHI2_BODY, *AB_CTES, *_chi2_sql("strategy", "success", "ab")))
def q_ab_chi2(spark, d):
    return ST.chi2_contingency(_ab_frame(spark, d), "strategy", "success")


@register("chi2_method_failure", txn_sql(_CHI2_BODY, *_chi2_sql("payment_method", "result", "transactions")))
def q_chi2_method(spark, d):
    return ST.chi2_contingency(V.transactions(spark, d), "payment_method", "result")


@register("ab_chi2_pvalue")
def q_ab_chi2_p(spark, d):
    return ST.chi2_contingency(_ab_frame(spark, d), "strategy", "success", with_p=True)


@register("chi2_method_failure_pvalue")
def q_chi2_method_p(spark, d):
    return ST.chi2_contingency(V.transactions(spark, d), "payment_method", "result", with_p=True)


@register("ab_ttest_processing_time", txn_sql("""
SELECT round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t_stat,
       CAST(n0 + n1 - 2 AS BIGINT) AS dof, round(m0, 6) AS mean_first, round(m1, 6) AS mean_second
FROM (SELECT max(CASE WHEN strategy = 'old' THEN n END) n0, max(CASE WHEN strategy = 'old' THEN m END) m0,
             max(CASE WHEN strategy = 'old' THEN v END) v0, max(CASE WHEN strategy = 'new' THEN n END) n1,
             max(CASE WHEN strategy = 'new' THEN m END) m1, max(CASE WHEN strategy = 'new' THEN v END) v1
      FROM (SELECT strategy, count(*) AS n, avg(processing_time) AS m, var_samp(processing_time) AS v FROM ab
            WHERE processing_time IS NOT NULL GROUP BY 1) g) x""", *AB_CTES))
def q_ab_ttest(spark, d):
    return ST.ttest_ind(_ab_frame(spark, d), "strategy", "processing_time", "old", "new")


@register("ab_ttest_pvalue")
def q_ab_ttest_p(spark, d):
    return ST.ttest_ind(_ab_frame(spark, d), "strategy", "processing_time", "old", "new", with_p=True)


@register("impact_roi", txn_sql("""
SELECT round(dc * (proj - cur), 4) AS extra_daily_successes, round(dc * av * proj - dc * av * cur, 4) AS daily_volume_increase,
       round((dc * av * proj - dc * av * cur) * 365, 4) AS annual_increase,
       round(((dc * av * proj - dc * av * cur) * 365 * 0.2 - 250000.0) / 250000.0 * 100.0, 4) AS roi_pct,
       round(250000.0 / ((dc * av * proj - dc * av * cur) * 365 * 0.2 / 12.0), 4) AS payback_months
FROM (SELECT avg(payment_amount) AS av, round(avg(""" + OK + """) * 100.0, 2) / 100.0 AS cur,
             (round(avg(""" + OK + """) * 100.0, 2) + 3.5) / 100.0 AS proj,
             (SELECT avg(n) FROM (SELECT CAST(txn_ts AS DATE), count(*) AS n FROM transactions GROUP BY 1) dd) AS dc
      FROM transactions) k"""))
def q_roi(spark, d):
    return ST.impact_roi(V.transactions(spark, d))


@register("target_gap", txn_sql("""
SELECT round(sr, 6) AS success_rate, 0.95 AS success_target, round(round(sr, 6) - 0.95, 6) AS success_gap,
       round(sr, 6) >= 0.95 AS meets_success_target, round(rt, 6) AS avg_response_s, 0.5 AS response_target_s,
       rt <= 0.5 AS meets_response_target
FROM (SELECT avg(""" + OK + """) AS sr, (SELECT avg(response_time_s) FROM request_log) AS rt FROM transactions) x""", LOG_CTE))
def q_target_gap(spark, d):
    return ST.target_gap(V.transactions(spark, d), V.request_log(spark, d))


@register("cost_of_failures", txn_sql("""
SELECT round(10000 * (1 - b), 4) AS baseline_daily_failures,
       round(10000 * b * fnr + 10000 * (1 - b) * (1 - fpr), 4) AS model_daily_failures,
       round((10000 * (1 - b) - (10000 * b * fnr + 10000 * (1 - b) * (1 - fpr))) * 5.0, 4) AS daily_savings,
       round((10000 * (1 - b) - (10000 * b * fnr + 10000 * (1 - b) * (1 - fpr))) * 5.0 * 365, 4) AS annual_savings
FROM (SELECT (SELECT avg(y) FROM sc WHERE train) AS b,
             CAST(count(CASE WHEN NOT train AND yhat = 1 AND y = 0 THEN 1 END) AS DOUBLE)
               / count(CASE WHEN NOT train AND y = 0 THEN 1 END) AS fpr,
             CAST(count(CASE WHEN NOT train AND yhat = 0 AND y = 1 THEN 1 END) AS DOUBLE)
               / count(CASE WHEN NOT train AND y = 1 THEN 1 END) AS fnr FROM sc) x""",
    f"""sc AS (SELECT {HASH_SQL} < 80 AS train, {OK} AS y,
       CASE WHEN 0.98 - 0.003 * coalesce(network_latency, 100.0) > 0.5 THEN 1 ELSE 0 END AS yhat FROM transactions)"""))
def q_cost(spark, d):
    t = V.transactions(spark, d).select(
        (X.hash_bucket("transaction_id") < 80).alias("train"), X.is_success("result").alias("y"),
        ((F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0))) > 0.5).cast("int").alias("yhat"))
    b = t.where("train").select(F.avg("y")).scalar()
    test = t.where(~F.col("train"))
    cm = test.agg(F.count_if((F.col("yhat") == 1) & (F.col("y") == 0)).cast("double").alias("fp"),
                  F.count_if((F.col("yhat") == 0) & (F.col("y") == 0)).cast("double").alias("tn"),
                  F.count_if((F.col("yhat") == 0) & (F.col("y") == 1)).cast("double").alias("fn"),
                  F.count_if((F.col("yhat") == 1) & (F.col("y") == 1)).cast("double").alias("tp"))
    cm = cm.withColumn("_b", b)  # bind the scalar once
    return ST.cost_of_failures(F.col("_b"), F.col("fp"), F.col("tn"), F.col("fn"), F.col("tp"), frame=cm)
