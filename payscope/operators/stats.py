"""Statistical tests, A/B experiment tables and business formulas
(HT*, RO15-RO17, AG24).

Tests are computed from aggregated tables (cell counts, per-arm moments);
raw rows never leave their partitions and only the one-row result meets
Python, for the p-value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.functions import pvalues as P
from payscope.sources import schemas as S


# -- HT1 chi-square test of independence ----------------------------------------------

def chi2_contingency(df: DataFrame, a: str, b: str, correction: bool = True, with_p: bool = False) -> DataFrame:
    """Pearson chi-square of the a x b contingency table: chi2, dof, n.

    Uses chi2 = N * (sum O^2 / (R C) - 1), which needs only the observed
    (non-empty) cells.  With dof = 1 (2 x 2) the Yates correction moves
    every cell by min(0.5, |O - E|) towards E; in a 2 x 2 table |O - E| is
    the same for all four cells, d, and chi2 = d^2 N sum(1 / R) sum(1 / C)
    gives it."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = t.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    # windows over the cells of a row or a column: totals, and how many cells
    # each has, so that one pass over the cells gives every statistic
    cells = cells.select(a, b, "_o", F.sum("_o").over(wa).alias("_r"), F.sum("_o").over(wb).alias("_c"),
                         F.count(F.lit(1)).over(wa).alias("_ka"), F.count(F.lit(1)).over(wb).alias("_kb"))
    s = cells.agg(F.sum("_o").alias("_n"), F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_q"),
                  F.count_distinct(a).alias("_nr"), F.sum(1.0 / (F.col("_r") * F.col("_ka"))).alias("_ir"),
                  F.count_distinct(b).alias("_nc"), F.sum(1.0 / (F.col("_c") * F.col("_kb"))).alias("_ic"))
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    plain = F.col("_n") * (F.col("_q") - 1.0)
    scale = F.col("_n") * F.col("_ir") * F.col("_ic")
    dev = F.sqrt(F.greatest(plain, F.lit(0.0)) / scale)
    yates = F.pow(F.greatest(dev - 0.5, F.lit(0.0)), 2) * scale
    stat = F.when(dof == 1, yates).otherwise(plain) if correction else plain
    out = s.select(X.rnd(stat).alias("chi2"), dof.cast("int").alias("dof"), F.col("_n").cast("bigint").alias("n"))
    if with_p:
        out = out.withColumn("p_value", X.rnd(P.chi2_pvalue(F.col("chi2"), F.col("dof").cast("double"))))
    return out


# -- HT2 pooled two-sample t-test --------------------------------------------------------

def ttest_ind(df: DataFrame, group: str, value: str, first: str, second: str, with_p: bool = False) -> DataFrame:
    """Equal-variance t statistic of ``first`` minus ``second``."""
    g = (df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
         .groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")))
    row = g.agg(*[F.max(F.when(F.col(group) == lab, F.col(c))).alias(f"{c}{i}")
                  for i, lab in enumerate([first, second]) for c in ("n", "m", "v")])
    dof = F.col("n0") + F.col("n1") - 2
    sp2 = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / dof
    t = (F.col("m0") - F.col("m1")) / F.sqrt(sp2 * (1.0 / F.col("n0") + 1.0 / F.col("n1")))
    out = row.select(X.rnd(t).alias("t_stat"), dof.cast("bigint").alias("dof"),
                     X.rnd(F.col("m0")).alias("mean_first"), X.rnd(F.col("m1")).alias("mean_second"))
    if with_p:
        out = out.withColumn("p_value", X.rnd(P.t_pvalue(F.col("t_stat"), F.col("dof").cast("double"))))
    return out


# -- RO15-RO17, AG24, HT3: the A/B experiment on logged rows -------------------------------

def ab_assign(df: DataFrame, id_col: str = "transaction_id", share_new: int = 50, seed: int = 42) -> DataFrame:
    """RO16: stable 50/50 arm by hash of the id (no RNG state, replayable)."""
    return df.withColumn("assigned_arm", F.when(X.hash_bucket(id_col, seed) < share_new, "new").otherwise("old"))


def rule_routing(df: DataFrame) -> DataFrame:
    """RO15: the old rule over amount and earlier failures (needs
    ``previous_failures``, see features.previous_failures)."""
    p = (F.when(F.col("payment_amount") > 1000, 0.5).when(F.col("previous_failures") > 0, 0.4).otherwise(0.7))
    a = (F.when(F.col("payment_amount") > 1000, "review").when(F.col("previous_failures") > 0, "review")
         .otherwise("route"))
    return df.withColumn("rule_probability", p).withColumn("rule_action", a)


def adjusted_probability(p, action) -> "F.Column":
    """RO17: review & p < .6 -> min(.9, p + .3); route & p > .7 -> p;
    otherwise max(.1, p - .1)."""
    p, action = X._c(p), X._c(action)
    return (F.when((action == "review") & (p < 0.6), F.least(F.lit(0.9), p + 0.3))
            .when((action == "route") & (p > 0.7), p)
            .otherwise(F.greatest(F.lit(0.1), p - 0.1)))


def ab_outcomes(df: DataFrame, model_p: str = "model_probability") -> DataFrame:
    """One outcome row per transaction (F6) from LOGGED data: arm by hash,
    decision by the arm's policy (the model, or the rule when the model has
    no score - the reference's fallback), success = the logged result.
    ``assigned_arm`` and ``served_by`` stay two columns (T20)."""
    t = rule_routing(ab_assign(df))
    use_model = (F.col("assigned_arm") == "new") & F.col(model_p).isNotNull()
    p = F.when(use_model, F.col(model_p)).otherwise(F.col("rule_probability"))
    act = F.when(use_model, X.action(model_p)).otherwise(F.col("rule_action"))
    return t.select(
        "transaction_id", "assigned_arm",
        F.when(use_model, "new").otherwise("old").alias("served_by"),
        F.col("assigned_arm").alias("strategy"),
        act.alias("recommended_action"), p.alias("predicted_probability"),
        adjusted_probability(p, act).alias("adjusted_probability"),
        (F.col("result") == "success").alias("success"),
        (F.col("network_latency") / 100.0).alias("processing_time"))


def strategy_summary(outcomes: DataFrame) -> DataFrame:
    """AG24: n, success mean and mean processing time per strategy."""
    return outcomes.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), X.rnd(F.avg(F.col("success").cast("int"))).alias("success_rate"),
        X.rnd(F.avg("processing_time")).alias("mean_processing_time"))


def lift(outcomes: DataFrame, control: str = "old", treatment: str = "new") -> DataFrame:
    """HT3: absolute and relative change of the success rate."""
    s = outcomes.groupBy("strategy").agg(F.avg(F.col("success").cast("int")).alias("r"))
    row = s.agg(F.max(F.when(F.col("strategy") == control, F.col("r"))).alias("c"),
                F.max(F.when(F.col("strategy") == treatment, F.col("r"))).alias("t"))
    return row.select(X.rnd("c").alias("control_rate"), X.rnd("t").alias("treatment_rate"),
                      X.rnd(F.col("t") - F.col("c")).alias("abs_lift"),
                      X.rnd(F.try_divide(F.col("t") - F.col("c"), F.col("c"))).alias("rel_lift"))


# -- HT4 ------------------------------------------------------------------------------------

def improvement_over_baseline(rates: DataFrame, baseline: str, name: str = "strategy",
                              rate: str = "success_rate") -> DataFrame:
    """(rate - base) / base * 100 per strategy, and the best strategy."""
    r = rates.withColumn("_base", rates.where(F.col(name) == baseline).select(F.max(rate)).scalar())
    base = F.col("_base")
    r = r.withColumn("improvement_pct", X.rnd(F.try_divide(F.col(rate) - base, base) * 100.0, 4)).drop("_base")
    top = rates.select(F.min_by(F.col(name), F.struct(-F.col(rate), F.col(name)))).scalar()
    return r.withColumn("is_best", (F.col(name) == top).cast("int"))


# -- HT5 / HT6 / HT8 business formulas --------------------------------------------------------

def cost_of_failures(baseline_success_rate, fp, tn, fn, tp, per_day: int = 10000, cost: float = 5.0,
                     frame: DataFrame = None) -> DataFrame:
    """Daily failures now vs. with the model, and savings x365 (the
    reference's formula, kept as is)."""
    b = baseline_success_rate
    fpr = fp / (fp + tn)
    fnr = fn / (fn + tp)
    base_fail = per_day * (1 - b)
    model_fail = per_day * b * fnr + per_day * (1 - b) * (1 - fpr)
    daily = (base_fail - model_fail) * cost
    return frame.select(X.rnd(base_fail, 4).alias("baseline_daily_failures"),
                        X.rnd(model_fail, 4).alias("model_daily_failures"),
                        X.rnd(daily, 4).alias("daily_savings"), X.rnd(daily * 365, 4).alias("annual_savings"))


def impact_roi(df: DataFrame, uplift_pts: float = 3.5, margin: float = 0.2, cost: float = 250000.0) -> DataFrame:
    """Projected impact of +uplift points of success rate: extra successes
    and volume per day, annual revenue, ROI % and payback months."""
    daily = df.groupBy(F.to_date("txn_ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    k = df.agg(F.avg("payment_amount").alias("avg_value"),
               (F.round(F.avg(X.is_success("result")) * 100.0, 2)).alias("success_pct"))
    k = k.withColumn("_dc", daily.select(F.avg("n")).scalar())
    daily_count = F.col("_dc")
    cur = F.col("success_pct") / 100.0
    proj = (F.col("success_pct") + uplift_pts) / 100.0
    vol = daily_count * F.col("avg_value")
    inc = vol * proj - vol * cur
    annual = inc * 365
    benefit = annual * margin
    return k.select(X.rnd(daily_count * (proj - cur), 4).alias("extra_daily_successes"),
                    X.rnd(inc, 4).alias("daily_volume_increase"), X.rnd(annual, 4).alias("annual_increase"),
                    X.rnd((benefit - cost) / cost * 100.0, 4).alias("roi_pct"),
                    X.rnd(cost / (benefit / 12.0), 4).alias("payback_months"))


def target_gap(txn: DataFrame, log: DataFrame) -> DataFrame:
    """Success rate vs the 95 % target and mean response time vs 0.5 s."""
    rt = F.col("_rt")
    return txn.agg(X.rnd(F.avg(X.is_success("result")), 6).alias("success_rate")).withColumn(
        "_rt", log.select(F.avg("response_time_s")).scalar()).select(
        "success_rate", F.lit(S.SUCCESS_RATE_TARGET).alias("success_target"),
        X.rnd(F.col("success_rate") - S.SUCCESS_RATE_TARGET).alias("success_gap"),
        (F.col("success_rate") >= S.SUCCESS_RATE_TARGET).alias("meets_success_target"),
        X.rnd(rt).alias("avg_response_s"), F.lit(S.RESPONSE_TIME_TARGET_S).alias("response_target_s"),
        (rt <= S.RESPONSE_TIME_TARGET_S).alias("meets_response_target"))
