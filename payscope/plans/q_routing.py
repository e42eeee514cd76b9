"""Routing queries (RO*, WN5, WN7, AG23, HT4, JN8) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import features as FE
from payscope.operators import routing as RT
from payscope.plans.q_features import CAL_CTES, _QBIN_CTES
from payscope.plans.registry import OK, register, txn_sql
from payscope.session import cut_lineage
from payscope.sources import schemas as S
from payscope.sources import views as V


def _hu(tag: str) -> str:
    """DuckDB text of expr.hash_uniform(transaction_id, tag, seed=42)."""
    return (f"(CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|{tag}|42'), 1, 13))::BIGINT AS DOUBLE)"
            " / 4503599627370496.0)")


ROUTE_CTES = _QBIN_CTES + [
    f"""rt AS (SELECT t.*, CAST({OK} AS INTEGER) AS result_numeric, qb.latency_bin FROM transactions t JOIN qb USING (transaction_id))""",
    """rb AS (SELECT *, CASE latency_bin WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'very_high' THEN 4 END
           AS latency_bin_encoded,
         CASE WHEN merchant_id IS NOT NULL THEN avg(result_numeric) OVER (PARTITION BY merchant_id) END AS merchant_success_rate,
         CASE WHEN count(result_numeric) OVER w >= 5 THEN avg(result_numeric) OVER w END AS payment_method_rolling_success
       FROM rt WINDOW w AS (PARTITION BY payment_method ORDER BY txn_ts, transaction_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""",
    "pr AS (SELECT processor_id AS arm, avg(result_numeric) AS rate FROM rb WHERE processor_id IS NOT NULL GROUP BY 1)",
    "arms AS (SELECT list(arm ORDER BY arm) AS l, count(*) AS k FROM pr)",
    """sc AS (SELECT rb.transaction_id, pr.arm, least(greatest(pr.rate + 0.05 * (coalesce(merchant_success_rate, 0.85) - 0.85)
         + 0.03 * (coalesce(payment_method_rolling_success, 0.85) - 0.85)
         - 0.04 * (coalesce(CAST(latency_bin_encoded AS DOUBLE), 0.0) / 4.0), 0.0), 1.0) AS score FROM rb, pr)""",
    """best AS (SELECT transaction_id, arm AS best_processor FROM
       (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, arm) AS rn FROM sc) x WHERE rn = 1)""",
    """static AS (SELECT arm AS route_static FROM pr ORDER BY rate DESC, arm LIMIT 1)""",
    """cnt AS (SELECT date_trunc('hour', txn_ts) AS bucket, processor_id AS arm, count(*) AS n, sum(result_numeric) AS s
       FROM rb WHERE processor_id IS NOT NULL GROUP BY 1, 2)""",
    """grid AS (SELECT b.bucket, pr.arm FROM (SELECT DISTINCT date_trunc('hour', txn_ts) AS bucket FROM rb) b, pr)""",
    """st AS (SELECT bucket, arm, CAST(coalesce(sum(coalesce(n, 0)) OVER w, 0) AS BIGINT) AS trials,
         CAST(coalesce(sum(coalesce(s, 0)) OVER w, 0) AS BIGINT) AS successes
       FROM grid LEFT JOIN cnt USING (bucket, arm)
       WINDOW w AS (PARTITION BY arm ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """exploit AS (SELECT bucket, arm AS exploit_arm FROM (SELECT *, row_number() OVER (PARTITION BY bucket
         ORDER BY CASE WHEN trials > 0 THEN successes / trials ELSE 0.0 END DESC, arm) AS rn FROM st) x WHERE rn = 1)""",
    """ucbv AS (SELECT bucket, arm, sum(trials) OVER (PARTITION BY bucket) AS total,
         CASE WHEN trials > 0 THEN successes / trials + 1.0 * sqrt(ln(sum(trials) OVER (PARTITION BY bucket)) / trials)
              ELSE CAST('inf' AS DOUBLE) END AS v FROM st)""",
    """ucbb AS (SELECT bucket, arm AS ucb_arm, total FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, arm)
         AS rn FROM ucbv) x WHERE rn = 1)""",
    f"""pol AS (SELECT rb.transaction_id, rb.txn_ts, rb.payment_method, rb.device_type, rb.processor_id, rb.result_numeric,
         best.best_processor AS route_simple, static.route_static,
         CASE WHEN {_hu('explore')} < 0.1 THEN arms.l[CAST(floor({_hu('pick')} * arms.k) AS INTEGER) + 1] ELSE exploit.exploit_arm END
           AS route_epsilon_greedy,
         CASE WHEN ucbb.total = 0 THEN arms.l[CAST(floor({_hu('pick')} * arms.k) AS INTEGER) + 1] ELSE ucbb.ucb_arm END AS route_ucb
       FROM rb JOIN best USING (transaction_id) CROSS JOIN static CROSS JOIN arms
       LEFT JOIN exploit ON exploit.bucket = date_trunc('hour', rb.txn_ts)
       LEFT JOIN ucbb ON ucbb.bucket = date_trunc('hour', rb.txn_ts))""",
    """lng AS (SELECT p.*, sc.score AS expected_success FROM (
         SELECT transaction_id, txn_ts, payment_method, device_type, processor_id, result_numeric, 'simple' AS strategy, route_simple AS routed_processor FROM pol
         UNION ALL SELECT transaction_id, txn_ts, payment_method, device_type, processor_id, result_numeric, 'static', route_static FROM pol
         UNION ALL SELECT transaction_id, txn_ts, payment_method, device_type, processor_id, result_numeric, 'epsilon_greedy', route_epsilon_greedy FROM pol
         UNION ALL SELECT transaction_id, txn_ts, payment_method, device_type, processor_id, result_numeric, 'ucb', route_ucb FROM pol
         UNION ALL SELECT transaction_id, txn_ts, payment_method, device_type, processor_id, result_numeric, 'actual', processor_id FROM pol) p
       LEFT JOIN sc ON sc.transaction_id = p.transaction_id AND sc.arm = p.routed_processor)""",
]

_LIGHT_POLICIES = ["route_simple", "route_static", "route_epsilon_greedy", "route_ucb", "processor_id"]


def _scored(spark, d):
    txn = V.transactions(spark, d)
    arms = RT.arms_of(txn)  # the processor dimension, read from the narrow raw view
    base = RT.routing_base(txn)
    t = RT.processor_scores(base, arms)
    t = RT.best_processor(t).withColumn("route_simple", F.col("best_processor"))
    return RT.static_baseline(t), arms


def _light(spark, d):
    """Policies SQL can replay: argmax, static, epsilon-greedy, UCB."""
    t, arms = _scored(spark, d)
    t = cut_lineage(t)
    stats = cut_lineage(RT.running_arm_stats(t, arms))  # a row per bucket and processor: its size is known to the join
    state = RT.bucket_state(stats, arms)
    return RT.bandit_decisions(t, state, arms), arms


def _logged(spark, d):
    """What bandit state needs: time, processor, result of the raw rows."""
    t = V.transactions(spark, d).select("transaction_id", "txn_ts", "payment_method", "processor_id", X.is_success("result").alias("result_numeric"))
    return t, RT.arms_of(t)


def _bandits(spark, d):
    t, arms = _logged(spark, d)
    return RT.bandit_decisions(t, RT.bucket_state(cut_lineage(RT.running_arm_stats(t, arms)), arms), arms)


def _long(spark, d):
    t, _ = _light(spark, d)
    return RT.decisions_long(t, _LIGHT_POLICIES)


@register("processor_scores", txn_sql("SELECT transaction_id, arm, round(score, 6) AS score FROM sc", *ROUTE_CTES[:8]))
def q_scores(spark, d):
    t, _ = _scored(spark, d)
    e = t.select("transaction_id", F.explode("scores").alias("e"))
    return e.select("transaction_id", F.col("e.arm").alias("arm"), X.rnd("e.score").alias("score"))


@register("best_processor", txn_sql("""
SELECT transaction_id, best_processor, CAST(CASE WHEN processor_id = best_processor THEN 1 ELSE 0 END AS INTEGER)
       AS optimal_processor_selected FROM rb JOIN best USING (transaction_id)""", *ROUTE_CTES[:9]))
def q_best(spark, d):
    t, _ = _scored(spark, d)
    return t.select("transaction_id", "best_processor", "optimal_processor_selected")


@register("running_arm_stats", txn_sql("SELECT bucket, arm, trials, successes FROM st", *ROUTE_CTES[:13]))
def q_wn7(spark, d):
    t, arms = _logged(spark, d)
    return RT.running_arm_stats(t, arms)


@register("thompson_posterior", txn_sql("""
SELECT bucket, arm, trials, successes, round((successes + 1.0) / (trials + 2.0), 6) AS posterior_mean,
       round((successes + 1.0) * (trials - successes + 1.0) / ((trials + 2.0) * (trials + 2.0) * (trials + 3.0)), 6) AS posterior_var
FROM st""", *ROUTE_CTES[:13]))
def q_thompson_post(spark, d):
    t, arms = _logged(spark, d)
    return RT.thompson_samples(RT.running_arm_stats(t, arms)).drop("sample")


@register("route_thompson")
def q_thompson(spark, d):
    t, arms = _logged(spark, d)
    stats = RT.running_arm_stats(t, arms)
    return RT.thompson(t, RT.thompson_samples(stats), arms).select("transaction_id", "route_thompson")


@register("route_epsilon_greedy", txn_sql("SELECT transaction_id, route_epsilon_greedy FROM pol", *ROUTE_CTES[:17]))
def q_eps(spark, d):
    return _bandits(spark, d).select("transaction_id", "route_epsilon_greedy")


@register("route_ucb", txn_sql("SELECT transaction_id, route_ucb FROM pol", *ROUTE_CTES[:17]))
def q_ucb(spark, d):
    return _bandits(spark, d).select("transaction_id", "route_ucb")


def _capped_ctes(rounds: int = 5, ratio: str = "0.3") -> list[str]:
    """The rounds one after the other: who asks, and who is accepted."""
    out = ["""csc AS (SELECT rb.transaction_id, date_trunc('hour', txn_ts) AS bucket, pr.arm, least(greatest(pr.rate + (0.05 * (coalesce(merchant_success_rate, 0.85) - 0.85)
         + 0.03 * (coalesce(payment_method_rolling_success, 0.85) - 0.85)
         - 0.04 * (coalesce(CAST(latency_bin_encoded AS DOUBLE), 0.0) / 4.0)), 0.0), 1.0) AS score FROM rb, pr)""",
           "prf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY score DESC, arm) AS rk FROM csc)",
           f"cap AS (SELECT bucket, floor(count(*) * {ratio}) AS cap FROM prf WHERE rk = 1 GROUP BY 1)",
           "acc0 AS (SELECT transaction_id, bucket, arm FROM prf WHERE false)"]
    for r in range(1, rounds + 1):
        out.append(f"""acc{r} AS MATERIALIZED (SELECT * FROM acc{r - 1} UNION ALL SELECT transaction_id, bucket, arm FROM (
          SELECT p.transaction_id, p.bucket, p.arm, cap - coalesce(used, 0) AS room, row_number() OVER (PARTITION BY p.bucket, p.arm ORDER BY score DESC, p.transaction_id) AS rn
          FROM prf p JOIN cap ON p.bucket = cap.bucket ANTI JOIN acc{r - 1} a ON a.transaction_id = p.transaction_id
          LEFT JOIN (SELECT bucket, arm, count(*) AS used FROM acc{r - 1} GROUP BY 1, 2) u ON u.bucket = p.bucket AND u.arm = p.arm WHERE rk = {r}) x WHERE rn <= room)""")
    return out


@register("route_capped", txn_sql("""
SELECT p.transaction_id, coalesce(a.arm, p.arm) AS route_capped FROM prf p LEFT JOIN acc5 a USING (transaction_id) WHERE p.rk = 1""",
                                  *ROUTE_CTES[:7], *_capped_ctes()))
def q_capped(spark, d):
    t, arms = _scored(spark, d)
    return RT.route_capped(t, arms, 0.3).select("transaction_id", "route_capped")


@register("static_baseline", txn_sql("""
SELECT routed_processor AS route_static, round(avg(expected_success), 6) AS expected_success FROM lng WHERE strategy = 'static' GROUP BY 1""",
                                     *ROUTE_CTES))
def q_static(spark, d):
    long = _long(spark, d).where(F.col("strategy") == "static")
    return long.groupBy(F.col("routed_processor").alias("route_static")).agg(
        X.rnd(F.avg("expected_success")).alias("expected_success"))


@register("load_distribution", txn_sql("""
SELECT strategy, routed_processor, n, round(n / sum(n) OVER (PARTITION BY strategy), 6) AS share
FROM (SELECT strategy, routed_processor, count(*) AS n FROM lng GROUP BY 1, 2) g""", *ROUTE_CTES))
def q_load(spark, d):
    return RT.load_distribution(_long(spark, d))


@register("policy_eval", txn_sql("""
SELECT strategy, routed_processor, count(*) AS n, round(avg(expected_success), 6) AS expected_success
FROM lng GROUP BY 1, 2""", *ROUTE_CTES))
def q_policy_eval(spark, d):
    return RT.policy_eval(_long(spark, d))


@register("expected_success_vs_static", txn_sql("""
SELECT strategy, success_rate, round((success_rate - (SELECT success_rate FROM g WHERE strategy = 'static')) /
       (SELECT success_rate FROM g WHERE strategy = 'static') * 100.0, 4) AS improvement_pct,
       CAST(strategy = (SELECT strategy FROM g ORDER BY success_rate DESC, strategy LIMIT 1) AS INTEGER) AS is_best
FROM g""", *ROUTE_CTES, "g AS (SELECT strategy, round(avg(expected_success), 6) AS success_rate FROM lng GROUP BY 1)"))
def q_expected(spark, d):
    return RT.expected_success(_long(spark, d), "static")


@register("actual_vs_routed", txn_sql("""
SELECT round(avg(result_numeric), 6) AS actual_rate, round(avg(expected_success), 6) AS routed_rate,
       round((round(avg(expected_success), 6) - round(avg(result_numeric), 6)) / round(avg(result_numeric), 6) * 100.0, 4)
       AS improvement_pct FROM lng WHERE strategy = 'simple'""", *ROUTE_CTES))
def q_actual_routed(spark, d):
    return RT.actual_vs_routed(_long(spark, d), "simple")


@register("ips_value", txn_sql("""
SELECT strategy, round(avg(CASE WHEN routed_processor = l.processor_id THEN 1.0 / propensity ELSE 0.0 END * result_numeric), 6)
       AS ips_value,
       round(sum(CASE WHEN routed_processor = l.processor_id THEN 1 ELSE 0 END) / count(*), 6) AS match_rate
FROM lng l LEFT JOIN (SELECT payment_method, processor_id, c / sum(c) OVER (PARTITION BY payment_method) AS propensity
                      FROM (SELECT payment_method, processor_id, count(*) AS c FROM lng WHERE strategy = 'actual' GROUP BY 1, 2) x) p
  ON l.payment_method = p.payment_method AND l.processor_id = p.processor_id
GROUP BY strategy""", *ROUTE_CTES))
def q_ips(spark, d):
    t, _ = _light(spark, d)
    return RT.ips_value_of(t, _LIGHT_POLICIES)


def _seg_sql(seg):
    return txn_sql(f"""
SELECT {seg}, round(avg(result_numeric), 6) AS actual_rate, round(avg(expected_success), 6) AS routed_rate,
       round((round(avg(expected_success), 6) - round(avg(result_numeric), 6)) / round(avg(result_numeric), 6) * 100.0, 4)
       AS improvement_pct FROM lng WHERE strategy = 'simple' AND {seg} IS NOT NULL GROUP BY 1""", *ROUTE_CTES)


@register("rate_by_method_routed", _seg_sql("payment_method"))
def q_seg_method(spark, d):
    return RT.rate_by_segment(_long(spark, d), "payment_method")


@register("rate_by_device_routed", _seg_sql("device_type"))
def q_seg_device(spark, d):
    return RT.rate_by_segment(_long(spark, d), "device_type")


@register("moving_success_500", txn_sql("""
SELECT transaction_id, strategy, round(avg(expected_success) OVER w, 6) AS moving_success
FROM lng WINDOW w AS (PARTITION BY strategy ORDER BY txn_ts, transaction_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)
QUALIFY count(expected_success) OVER w >= 500""",
                                        *ROUTE_CTES))
def q_moving(spark, d):
    t, _ = _light(spark, d)
    m = RT.moving_success_of(t, _LIGHT_POLICIES, 500)
    return m.select("transaction_id", "strategy", X.rnd("moving_success").alias("moving_success"))


@register("compare_decisions_simple_vs_actual", txn_sql("""
SELECT count(*) AS n, round(avg(CASE WHEN route_simple = processor_id THEN 1 ELSE 0 END), 6) AS agreement FROM pol""",
                                                        *ROUTE_CTES[:17]))
def q_compare(spark, d):
    t, _ = _scored(spark, d)
    a = t.select("transaction_id", F.col("route_simple").alias("decision_a"))
    b = t.select("transaction_id", F.col("processor_id").alias("decision_b"))
    return FE.compare_decisions(a, b)


@register("routing_all_policies_summary")
def q_all(spark, d):
    t, _ = RT.route_all(V.transactions(spark, d))
    long = RT.decisions_long(t, RT.POLICIES)
    return RT.expected_success(long, "static")


@register("risk_rate_by_method", txn_sql("""
SELECT t.payment_method, count(*) AS n,
       round(avg(pm.base_failure_rate *
         CASE WHEN hour(txn_ts) < 6 THEN 1.2 WHEN hour(txn_ts) < 9 THEN 1.1 WHEN hour(txn_ts) < 17 THEN 0.9
              WHEN hour(txn_ts) < 22 THEN 1.0 ELSE 1.2 END *
         CASE WHEN isodow(txn_ts) <= 5 THEN 0.95 ELSE 1.05 END *
         greatest(coalesce(r.f, 1.0), coalesce(c.f, 0.0))), 6) AS expected_failure_rate,
       round(avg(CASE WHEN result = 'failure' THEN 1 ELSE 0 END), 6) AS observed_failure_rate
FROM transactions t JOIN (VALUES """ + ", ".join(f"('{m}', {f})" for m, _, f in S.PAYMENT_METHODS) + """) pm(payment_method, base_failure_rate)
  ON t.payment_method = pm.payment_method
LEFT JOIN (SELECT date, arg_min(failure_factor, priority) AS f FROM cal_days WHERE kind = 'regional' GROUP BY date) r
  ON CAST(t.txn_ts AS DATE) = r.date
LEFT JOIN (SELECT date, m AS payment_method, max(failure_factor) AS f
           FROM (SELECT date, unnest(affected_payment_methods) AS m, failure_factor FROM cal_days WHERE kind = 'custom') x
           GROUP BY 1, 2) c ON CAST(t.txn_ts AS DATE) = c.date AND t.payment_method = c.payment_method
GROUP BY t.payment_method""", *CAL_CTES))
def q_risk(spark, d):
    pm, _, _ = S.dim_frames(spark)
    return RT.risk_rate(V.transactions(spark, d), pm, V.event_calendar(spark))


@register("volume_expectation", txn_sql("""
SELECT CAST(s.d AS DATE) AS date,
       CAST(floor(floor(b.n / b.days * greatest(coalesce(v.vf, 1.0), 1.0)) * CASE WHEN isodow(s.d) <= 5 THEN 1.2 ELSE 0.8 END)
            AS BIGINT) AS expected,
       CAST(coalesce(o.observed, 0) AS BIGINT) AS observed
FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM bnd) s CROSS JOIN bnd b
LEFT JOIN (SELECT date, max(volume_factor) AS vf FROM cal_days WHERE kind = 'regional' GROUP BY 1) v ON CAST(s.d AS DATE) = v.date
LEFT JOIN daily o ON CAST(s.d AS DATE) = o.date""", *CAL_CTES,
    "daily AS (SELECT CAST(txn_ts AS DATE) AS date, count(*) AS observed FROM transactions GROUP BY 1)",
    "bnd AS (SELECT min(date) AS lo, max(date) AS hi, sum(observed) AS n, datediff('day', min(date), max(date)) + 1 AS days FROM daily)"))
def q_volume(spark, d):
    return RT.volume_expectation(V.transactions(spark, d), V.event_calendar(spark))


@register("state_vector")
def q_state_vector(spark, d):
    """RO14 over the full feature table."""
    t = FE.features(V.transactions(spark, d))
    s = RT.state_vector(t)
    return s.select("transaction_id", *[F.col("state")[i].alias(f"s{i}") for i in range(8)])
