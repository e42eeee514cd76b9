"""Monitoring and drift (MN1-MN8) over feedback, request and error logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.sources import schemas as S

NBINS = 10


def _round_frac(x: Column, p: Column) -> Column:
    """pandas' label rounding: ``precision`` significant places below 1,
    decimals above; numpy's around = rint(x * 10^d) / 10^d."""
    whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    d = F.when(whole == 0, -F.floor(F.log10(F.abs(x))).cast("int") - 1 + p).otherwise(p)
    scale = F.pow(F.lit(10.0), d)
    return F.when(x == 0, x).otherwise(F.rint(x * scale) / scale)


def calibration_edges(fb: DataFrame, prob: str = "prediction_probability", bins: int = NBINS) -> DataFrame:
    """One row: the ``pd.cut(bins=10)`` edges (equal width over min..max,
    first edge lowered by 0.1 % of the range) and the rounded label edges."""
    st = fb.agg(F.min(prob).alias("lo0"), F.max(prob).alias("hi0"), F.count(prob).alias("n"))
    same = F.col("lo0") == F.col("hi0")
    # a zero range is widened by 0.1 % on both sides (0 -> +-0.001), as pandas does
    lo = F.when(same, F.when(F.col("lo0") == 0, F.lit(-0.001)).otherwise(F.col("lo0") - 0.001 * F.abs("lo0"))) \
          .otherwise(F.col("lo0"))
    hi = F.when(same, F.when(F.col("hi0") == 0, F.lit(0.001)).otherwise(F.col("hi0") + 0.001 * F.abs("hi0"))) \
          .otherwise(F.col("hi0"))
    st = st.withColumn("lo", lo).withColumn("hi", hi)
    step = (F.col("hi") - F.col("lo")) / bins
    first = F.when(same, F.col("lo")).otherwise(F.col("lo") - (F.col("hi") - F.col("lo")) * 0.001)
    edges = F.array(*[first if i == 0 else
                      (F.col("hi") if i == bins else F.lit(float(i)) * step + F.col("lo")) for i in range(bins + 1)])
    t = st.withColumn("edges", edges)
    labels = lambda p: F.transform("edges", lambda e: _round_frac(e, p))
    prec = F.filter(F.sequence(F.lit(3), F.lit(19)), lambda p: F.size(F.array_distinct(labels(p))) == bins + 1)
    t = t.withColumn("precision", F.coalesce(F.get(prec, 0), F.lit(3)))
    return t.withColumn("label_edges", labels(F.col("precision")))


def calibration_table(fb: DataFrame, prob: str = "prediction_probability", label: str = "actual_success",
                      bins: int = NBINS) -> DataFrame:
    """MN1: bucket, midpoint, observed success mean, n (empty buckets are
    absent and contribute nothing)."""
    e = calibration_edges(fb, prob, bins)
    t = fb.withColumn("_edges", e.select("edges").scalar())  # one subquery, bound once
    edges = F.col("_edges")
    x = F.col(prob)
    bucket = sum((F.when(x > edges[i], 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    g = (t.where(x.isNotNull()).groupBy(bucket.alias("bucket"))
         .agg(F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n")))
    mids = e.select(F.posexplode(F.slice("label_edges", 1, bins)).alias("bucket", "left"),
                    F.col("label_edges").alias("_le"))
    mids = mids.select("bucket", ((F.col("left") + F.element_at("_le", F.col("bucket") + 2)) / 2).alias("midpoint"))
    return g.join(F.broadcast(mids), "bucket").select(
        "bucket", X.rnd("midpoint").alias("midpoint"), X.rnd("observed").alias("observed"), "n")


def calibration_error(table: DataFrame) -> DataFrame:
    """MN2: sum |mid - observed| * n / N."""
    return table.agg(X.rnd(F.sum(F.abs(F.col("midpoint") - F.col("observed")) * F.col("n")) / F.sum("n"))
                     .alias("calibration_error"), F.sum("n").cast("bigint").alias("n"))


def drift_flag(err: DataFrame, limit: float = S.CALIBRATION_ERROR_LIMIT, min_rows: int = S.CALIBRATION_MIN_ROWS):
    """MN3: fewer than 100 rows -> NULL (no verdict); error > limit -> drift."""
    return err.withColumn("drift_detected", F.when(F.col("n") < min_rows, F.lit(None).cast("boolean"))
                          .otherwise(F.col("calibration_error") > limit))


def error_log_summary(log: DataFrame, hours: int = 24, k: int = 10, newest: bool = False) -> DataFrame:
    """MN4: ERROR lines in the last ``hours`` up to the latest log time: count
    and the first ``k`` messages in log order (``newest``: the last ``k``,
    latest first) - a top-k, then one small string."""
    end = F.col("_end")
    w = log.withColumn("_end", log.select(F.max("ts")).scalar())
    w = w.where((F.col("level") == "ERROR") & (F.col("ts") > end - F.expr(f"INTERVAL {hours} HOURS")) &
                (F.col("ts") <= end)).drop("_end")
    n = w.select(F.count(F.lit(1))).scalar()
    top = w.orderBy(*([F.desc("ts"), F.desc("event_id")] if newest else ["ts", "event_id"])).limit(k)
    msgs = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "message")), not newest),
                                            lambda s: s["message"]), " | ").alias("recent_messages"))
    return msgs.select(n.cast("bigint").alias("error_count"), "recent_messages")


def alerts(latency: DataFrame, drift: DataFrame, errors: DataFrame) -> DataFrame:
    """MN5: one row per alert rule with its verdict and action."""
    spark = latency.sparkSession
    one = spark.range(1).withColumns({"_lat": latency.select(F.struct("success_share", "p95_s")).scalar(),
                                      "_dr": drift.select("drift_detected").scalar(),
                                      "_er": errors.select("error_count").scalar()})
    lat, dr, er = F.col("_lat"), F.col("_dr"), F.col("_er")
    def rule(name, cond, act):
        return F.struct(F.lit(name).alias("alert"), cond.alias("triggered"), F.lit(act).alias("action"))

    rules = one.select(F.explode(F.array(
        rule("service_unhealthy", lat["success_share"] < 0.5, "page on-call"),
        rule("high_p95_latency", lat["p95_s"] > S.P95_ALERT_S, "scale service"),
        rule("model_drift", F.coalesce(dr, F.lit(False)), "retrain model"),
        rule("error_spike", er > S.ERROR_COUNT_LIMIT, "inspect errors"))).alias("a"))
    return rules.select("a.alert", "a.triggered", "a.action")


def calibration_by_strategy(outcomes: DataFrame) -> DataFrame:
    """MN6: mean success by strategy and predicted probability."""
    return outcomes.groupBy("strategy", X.rnd("predicted_probability").alias("predicted_probability")).agg(
        F.count(F.lit(1)).alias("n"), X.rnd(F.avg(F.col("success").cast("int"))).alias("success_rate"))


def concept_drift_over_time(scored: DataFrame, prob: str, label: str, ts: str, threshold: float = 0.5) -> DataFrame:
    """MN7: daily AUC, precision and recall of logged predictions."""
    from payscope.operators.ml import binary_metrics, roc_auc
    t = scored.withColumn("day", F.to_date(ts))
    m = binary_metrics(t, prob, label, threshold, keys=["day"])
    a = roc_auc(t, prob, label, keys=["day"])
    return m.join(a, "day").select("day", "n", "auc", "precision", "recall")


def retrain_on_drift(drift: DataFrame, retrain):
    """MN8: call ``retrain()`` when drift was detected; its result, or None."""
    return retrain() if retrain_decision(drift) else None


def retrain_decision(drift: DataFrame) -> bool:
    """MN8: the driver-side branch: retrain when drift was detected."""
    v = drift.select("drift_detected").first()
    return bool(v and v[0])
