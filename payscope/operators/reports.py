"""Report tables: rates by dimension, crosstabs, top-k, extremes, KPIs.

Every aggregation is one ``groupBy`` with partial (map-side) aggregation, so
a hot key costs one row per task before the shuffle, never a skewed
partition.  Windows run only over aggregated tables (days, hours, groups),
never over raw rows without a partition key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.sources import schemas as S


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas drops NULL group keys; Spark keeps them.  Filter first."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


# -- AG1 / AG2 / JN2 ----------------------------------------------------------

def failure_rate_by(df: DataFrame, keys) -> DataFrame:
    """n, failed and failure % (2 dp) per key set."""
    keys = _keys(keys)
    return (_not_null(df, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.sum(X.is_failure("result")).cast("bigint").alias("failed_transactions"))
            .withColumn("failure_rate", X.pct("failed_transactions", "total_transactions")))


def success_rate_by(df: DataFrame, keys) -> DataFrame:
    """Success % (2 dp) and count per key set.  The dashboard computed the
    rate and the count in two group-bys and joined them (JN2); one
    aggregation gives both."""
    keys = _keys(keys)
    return (_not_null(df, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(X.is_success("result")) * 100.0, 2).alias("success_rate")))


join_counts = success_rate_by


# -- AG3 / AG15 / AG27 ---------------------------------------------------------

def kpis(df: DataFrame) -> DataFrame:
    """Overall, per-method and per-device KPIs in one pass (GROUPING SETS)."""
    t = df.select("payment_method", "device_type", "payment_amount", "network_latency",
                  X.is_success("result").alias("ok"))
    g = (t.groupingSets([[], [F.col("payment_method")], [F.col("device_type")]], "payment_method", "device_type")
         .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
              F.round(F.avg("ok") * 100.0, 2).alias("success_rate"),
              X.rnd(F.avg("payment_amount")).alias("avg_amount"),
              X.rnd(F.avg("network_latency")).alias("avg_latency"),
              X.rnd(F.sum("payment_amount"), 4).alias("total_volume")))
    # gid: 3 = (), 1 = (method), 2 = (device)
    return g.select(
        F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "payment_method").otherwise("device_type").alias("dimension"),
        F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.col("payment_method"))
         .otherwise(F.col("device_type")).alias("key"),
        "n", "success_rate", "avg_amount", "avg_latency", "total_volume")


def daily_counts(df: DataFrame, ts: str = "txn_ts") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"))


def daily_avg_count(df: DataFrame, ts: str = "txn_ts") -> DataFrame:
    """Mean of the per-day counts (two-level aggregation)."""
    return daily_counts(df, ts).agg(X.rnd(F.avg("n"), 4).alias("avg_daily_count"),
                                    F.count(F.lit(1)).alias("n_days"))


def date_bounds(df: DataFrame, ts: str = "txn_ts") -> DataFrame:
    return df.agg(F.to_date(F.min(ts)).alias("first_date"), F.to_date(F.max(ts)).alias("last_date"))


# -- AG4 / AG5 / AG6 / AG8 / AG26 / TK1 ----------------------------------------

def with_failure_reason(df: DataFrame, err_dim: DataFrame) -> DataFrame:
    """SC15: code -> description by a broadcast join with the 10-row error
    dimension (fixed size, so broadcasting it is always safe)."""
    return df.join(F.broadcast(err_dim), "error_code", "left")


def error_table(df: DataFrame) -> DataFrame:
    """Failed rows per error code: count, share % (1 dp), one description; most frequent first."""
    f = df.where(X.is_failure("result") == 1).where(F.col("error_code").isNotNull())
    g = f.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"), F.min("failure_reason").alias("failure_reason"))
    tot = F.sum("n").over(Window.partitionBy())  # over the aggregated table (<= #codes rows)
    return g.withColumn("share_pct", F.round(F.col("n").cast("double") * 100.0 / tot, 1)).orderBy(F.desc("n"), "error_code")


def top_errors(df: DataFrame, k: int = 3) -> DataFrame:
    return error_table(df).orderBy(F.desc("n"), "error_code").limit(k)


def combined_error_share(df: DataFrame, codes=("E002", "E005")) -> DataFrame:
    e = error_table(df)
    return e.agg(F.round(F.sum(F.when(F.col("error_code").isin(*codes), F.col("share_pct")).otherwise(0.0)), 1)
                 .alias("combined_share_pct"))


def error_share_by_method(df: DataFrame, codes=None) -> DataFrame:
    """Crosstab method x error code of failed rows, normalised by row x100.
    The code list is fixed (the error dimension), so the pivot needs no
    extra job to discover its columns."""
    codes = [c for c, _ in S.ERROR_CODES] if codes is None else list(codes)
    f = df.where(X.is_failure("result") == 1).where(F.col("error_code").isNotNull() & F.col("payment_method").isNotNull())
    p = f.groupBy("payment_method").pivot("error_code", codes).count().na.fill(0, codes)
    tot = sum((F.col(c) for c in codes), F.lit(0))
    return p.select("payment_method", *[F.round(F.col(c) * 100.0 / tot, 4).alias(c) for c in codes])


def contingency(df: DataFrame, a: str, b: str, b_values: Sequence) -> DataFrame:
    """Counts crosstab, 0 for absent cells; columns of ``b`` are given
    (a bounded list), so no value-discovery job and no unbounded width."""
    t = _not_null(df, [a, b])
    p = t.groupBy(a).pivot(b, list(b_values)).count()
    names = [str(v) for v in b_values]
    return p.na.fill(0, names).select(a, *[F.col(n).cast("bigint").alias(n) for n in names])


def error_share_by_processor(df: DataFrame) -> DataFrame:
    """(processor, reason) count and share of the processor total (1 dp)."""
    f = df.where(X.is_failure("result") == 1).where(F.col("failure_reason").isNotNull())
    g = f.groupBy("processor_id", "failure_reason").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("processor_id")
    return g.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 1))


def share_of_group(df: DataFrame, group: str, value: str, out: str = "share") -> DataFrame:
    """WN4: value / total of its group, on an aggregated table."""
    return df.withColumn(out, X.rnd(F.col(value) / F.sum(value).over(Window.partitionBy(group))))


# -- AG7 heatmaps ---------------------------------------------------------------

def heatmap_pivot(df: DataFrame, row_key: str) -> DataFrame:
    """Row key x hour failure-rate matrix (columns h0..h23), days in weekday order."""
    t = df.select(row_key, F.hour("txn_ts").alias("hour"), X.is_failure("result").alias("f"))
    p = (t.where(F.col(row_key).isNotNull()).groupBy(row_key)
         .pivot("hour", list(range(24))).agg(F.round(F.avg("f") * 100.0, 2)))
    p = p.select(row_key, *[F.col(str(h)).alias(f"h{h}") for h in range(24)])
    return sort_by_weekday(p, row_key) if row_key == "day_name" else p.orderBy(row_key)


# -- AG9 / AG10 / AG11 ----------------------------------------------------------

def processor_scorecard(df: DataFrame) -> DataFrame:
    methods = [m for m, _, _ in S.PAYMENT_METHODS]
    t = df.where(F.col("processor_id").isNotNull())
    return t.groupBy("processor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(X.is_failure("result")) * 100.0, 2).alias("failure_rate"),
        X.rnd(F.avg("payment_amount")).alias("avg_amount"),
        F.round(F.avg((X.standardize_text("customer_location") == "urban").cast("int")) * 100.0, 2).alias("urban_pct"),
        *[F.count_if(F.col("payment_method") == m).alias(f"n_{m.lower()}") for m in methods])


def slot_profile(df: DataFrame) -> DataFrame:
    t = df.select(F.hour("txn_ts").cast("int").alias("hour"), X.weekday("txn_ts").alias("day_of_week"),
                  X.is_weekend("txn_ts").alias("is_weekend"), X.is_failure("result").alias("f"), "payment_amount")
    return t.groupBy("hour", "day_of_week", "is_weekend").agg(
        F.count(F.lit(1)).alias("n"), X.rnd(F.avg("f")).alias("failure_mean"),
        X.rnd(F.avg("payment_amount")).alias("avg_amount"))


def group_mean_count(df: DataFrame, key: str) -> DataFrame:
    """Mean success and count per key, highest first."""
    return (_not_null(df, [key]).groupBy(key)
            .agg(X.rnd(F.avg(X.is_success("result"))).alias("mean"), F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("mean"), key))


# -- AG12 / AG13 / AG14 / JN3 / AG22 --------------------------------------------

def merchant_stats(df: DataFrame) -> DataFrame:
    return (_not_null(df, ["merchant_id"]).groupBy("merchant_id")
            .agg(F.count(F.lit(1)).alias("n"), X.rnd(F.sum("payment_amount"), 4).alias("total_amount"),
                 F.round(F.avg(X.is_success("result")) * 100.0, 2).alias("success_rate")))


def merchant_volume_top(df: DataFrame, n: int = 10) -> DataFrame:
    return merchant_stats(df).orderBy(F.desc("n"), "merchant_id").limit(n)


def merchant_lowest(df: DataFrame, min_n: int = 10, n: int = 10) -> DataFrame:
    return (merchant_stats(df).where(F.col("n") >= min_n)
            .orderBy("success_rate", "merchant_id").limit(n))


def mix_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return _not_null(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def semi_top_merchants(df: DataFrame, k: int = 5) -> DataFrame:
    """Rows of the top-k merchants by volume: a left-semi join against a
    k-row table (broadcast by size, k is the bound)."""
    top = merchant_stats(df).orderBy(F.desc("n"), "merchant_id").limit(k).select("merchant_id")
    return df.join(F.broadcast(top), "merchant_id", "left_semi")


def distinct_count(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_distinct(c).alias(f"n_distinct_{c}"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


# -- AG16 ----------------------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * n_c) per class (balanced weights) and the raw ratio n_c / n."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    tot, k = F.sum("n_c").over(w), F.count(F.lit(1)).over(w)
    return g.select(label, "n_c", X.rnd(tot / (k * F.col("n_c"))).alias("weight"),
                    X.rnd(F.col("n_c") / tot).alias("share"))


# -- AG17-AG19 correlations ------------------------------------------------------

def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete) in ONE
    aggregation, returned long: (a, b, corr) for a < b in column order."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"c{i}_{j}")
                   for i, j in pairs])
    stack = ", ".join(f"'{cols[i]}', '{cols[j]}', {i}, {j}, c{i}_{j}" for i, j in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stack}) AS (a, b, i, j, corr)") \
              .select("a", "b", X.rnd("corr").alias("corr"))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    return corr_long(df, cols).where(F.abs("corr") > threshold)


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, corr)") \
              .select("feature", X.rnd("corr").alias("corr"))


# -- AG20 -----------------------------------------------------------------------

def latency_percentiles(log: DataFrame) -> DataFrame:
    base = [F.count(F.lit(1)).alias("n"), X.rnd(F.avg("response_time_s")).alias("mean_s"),
            X.rnd(F.avg((F.col("status") == 200).cast("int"))).alias("success_share")]
    row = log.agg(*base).withColumn("_q", X.quantile_stat(log, "response_time_s", [0.95, 0.99]))
    q = F.col("_q")
    return row.select("n", "mean_s", X.rnd(q[0]).alias("p95_s"), X.rnd(q[1]).alias("p99_s"), "success_share")


# -- AG21 ------------------------------------------------------------------------

def unpivot_metrics(df: DataFrame, id_col: str, metrics: Sequence[str]) -> DataFrame:
    return df.select(id_col, *[F.col(m).cast("double").alias(m) for m in metrics]) \
             .unpivot(id_col, list(metrics), "metric", "value")


# -- AG25 -------------------------------------------------------------------------

_POISSON1_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898508033253]


def _poisson1(u):
    out = F.when(u < _POISSON1_CDF[0], 0)
    for i, c in enumerate(_POISSON1_CDF[1:], start=1):
        out = out.when(u < c, i)
    return out.otherwise(len(_POISSON1_CDF))


def mean_ci_bootstrap(df: DataFrame, by: str, value: str, id_col: str, replicates: int = 200,
                      blocks: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap 95 % CI of a mean per group, Spark-style.

    Rows are first aggregated into ``blocks`` hash blocks per group (sum,
    count); each replicate draws a Poisson(1) weight per block from a hash
    (block bootstrap of iid blocks).  Work after the first aggregation is
    groups x blocks x replicates, independent of the row count, and no
    group is ever collected.
    """
    b = (df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
         .groupBy(by, X.hash_bucket(id_col, seed, blocks).alias("blk"))
         .agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("c")))
    reps = b.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.withColumn("w", _poisson1(X.hash_uniform(by, "blk", "r", seed=seed)))
    m = (reps.groupBy(by, "r").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m")))
    return m.groupBy(by).agg(X.rnd(X.small_quantile("m", 0.025)).alias("ci_low"),
                             X.rnd(X.small_quantile("m", 0.975)).alias("ci_high"))


def mean_ci_normal(df: DataFrame, by: str, value: str, z: float = 1.959963984540054) -> DataFrame:
    """Normal-approximation 95 % CI of a mean per group."""
    t = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    g = t.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("m"),
                          F.stddev_samp(F.col(value).cast("double")).alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return g.select(by, "n", X.rnd("m").alias("mean"), X.rnd(F.col("m") - half).alias("ci_low"),
                    X.rnd(F.col("m") + half).alias("ci_high"))


# -- TK2-TK6 -------------------------------------------------------------------------

def extremes(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """Worst/best key by rate (ties -> smallest key), and max/min ratio."""
    r = rates.where(F.col(rate).isNotNull())
    return r.agg(
        F.min_by(F.col(key), F.struct(-F.col(rate), F.col(key))).alias("worst_key"),
        F.max(rate).alias("worst_rate"),
        F.min_by(F.col(key), F.struct(F.col(rate), F.col(key))).alias("best_key"),
        F.min(rate).alias("best_rate"),
        X.rnd(F.max(rate) / F.min(rate), 4).alias("max_min_ratio"))


def top_by(df: DataFrame, order_col: str, key: str, k: int, ascending: bool = False) -> DataFrame:
    o = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    return df.where(F.col(order_col).isNotNull()).orderBy(o, F.col(key).asc()).limit(k)


def hours_above_q(rates: DataFrame, key: str = "hour", rate: str = "failure_rate", q: float = 0.75) -> DataFrame:
    """Keys whose rate >= the q-quantile of rates (scalar subquery, no join)."""
    thr = rates.select(X.small_quantile(rate, q)).scalar()
    return rates.where(F.col(rate) >= thr).select(key, rate)


def sort_by_weekday(df: DataFrame, name_col: str = "day_name") -> DataFrame:
    return df.orderBy(X.ordinal(name_col, S.WEEKDAY_NAMES, base=0))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return _not_null(df, [c]).groupBy(c).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), c)


# -- WN3 / WN9 / WN10 / TK8 / TK9 ------------------------------------------------------

def rolling_daily_failure(df: DataFrame, window_days: int = 7) -> DataFrame:
    """Daily failure rate with a 7-row trailing mean, over the DAILY table
    (days << rows; the single window partition is tiny by construction)."""
    d = failure_rate_by(df.withColumn("date", F.to_date("txn_ts")), ["date"])
    w = Window.orderBy("date").rowsBetween(-(window_days - 1), 0)
    cnt = F.count(F.lit(1)).over(w)
    return d.withColumn("rolling_failure_rate",
                        F.when(cnt >= window_days, F.round(F.avg("failure_rate").over(w), 4)))


def period_over_period(df: DataFrame, period: str = "week") -> DataFrame:
    """KPIs per period vs the previous period (lag over the period table)."""
    p = F.date_trunc(period, "txn_ts").cast("date").alias("period_start")
    g = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"),
                          F.round(F.avg(X.is_success("result")) * 100.0, 2).alias("success_rate"),
                          X.rnd(F.avg("payment_amount")).alias("avg_amount"))
    w = Window.orderBy("period_start")
    return g.select("period_start", "n", "success_rate", "avg_amount",
                    (F.col("n") - F.lag("n").over(w)).alias("n_change"),
                    F.round(F.col("success_rate") - F.lag("success_rate").over(w), 2).alias("success_rate_change"),
                    X.rnd(F.col("avg_amount") - F.lag("avg_amount").over(w)).alias("avg_amount_change"))


def latest_k(df: DataFrame, k: int = 10, ts: str = "txn_ts", id_col: str = "transaction_id") -> DataFrame:
    """k most recent rows: a TakeOrdered (per-task top-k, then merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(k)


def head(df: DataFrame, n: int, id_col: str = "transaction_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def sample_rows(df: DataFrame, n: int, id_col: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Seeded sample of n rows: order by md5(id|seed), take n (TakeOrdered)."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def sort_by_time(df: DataFrame, ts: str = "txn_ts", id_col: str = "transaction_id",
                 partitions: int | None = None) -> DataFrame:
    """Globally time-ordered output for files: range partitioning + a sort
    inside each partition (no single-task global sort)."""
    r = df.repartitionByRange(partitions, ts, id_col) if partitions else df.repartitionByRange(ts, id_col)
    return r.sortWithinPartitions(ts, id_col)


# -- ST1-ST4 -------------------------------------------------------------------------

def union_files(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def feature_intersection_or_union(a: DataFrame, b: DataFrame, min_size: int = 10, top: int = 10) -> DataFrame:
    """Features chosen by both selections; if fewer than ``min_size``, the
    union of both top-``top`` lists.  Inputs: (feature, rank)."""
    both = a.select("feature").intersect(b.select("feature"))
    alt = (a.where(F.col("rank") <= top).select("feature")
           .union(b.where(F.col("rank") <= top).select("feature")).distinct())
    n_both = both.select(F.count(F.lit(1))).scalar()
    return (both.withColumn("source", F.lit("intersection")).where(n_both >= min_size)
            .unionByName(alt.withColumn("source", F.lit("union")).where(n_both < min_size)))


def rows_without(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


# -- TK7: all findings from one scan ---------------------------------------------------------

FINDING_KEYS = ["payment_method", "processor_id", "customer_location", "hour", "day_name", "amount_bin",
                "merchant_id", "error_code"]


def key_findings(df: DataFrame, combined_codes=("E002", "E005")) -> DataFrame:
    """The ten findings (worst/best method, worst processor, location,
    amount bin and merchant, peak hour and day, top error, combined share of
    two codes) from ONE GROUPING SETS scan: failure counts for every key set
    at once, then small per-dimension reductions."""
    keys = FINDING_KEYS
    g = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"),
        F.sum(X.is_failure("result")).cast("bigint").alias("f"))
    dim = key = None
    gids = {}
    for i, k in enumerate(keys):
        gid = sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        gids[k] = gid
        cond = F.col("_gid") == gid
        dim = F.when(cond, k) if dim is None else dim.when(cond, k)
        key = F.when(cond, F.col(k).cast("string")) if key is None else key.when(cond, F.col(k).cast("string"))
    num = F.when(F.col("_gid") == gids["hour"], F.col("hour").cast("int"))  # hours sort as numbers
    g = g.select(dim.alias("dim"), key.alias("key"), num.alias("_num"), "n", "f").where(F.col("key").isNotNull())
    g = g.withColumn("rate", X.pct("f", "n"))
    # one row per (key set, value): small; materialised once because the
    # findings below read it four times (else four scans of the input)
    from payscope.session import cut_lineage
    g = cut_lineage(g)
    rates = g.where(F.col("dim") != "error_code")
    ext = rates.groupBy("dim").agg(
        F.min_by("key", F.struct(-F.col("rate"), F.coalesce("_num", F.lit(0)), F.col("key"))).alias("worst_key"),
        F.max("rate").alias("worst_rate"),
        F.min_by("key", F.struct(F.col("rate"), F.col("key"))).alias("best_key"), F.min("rate").alias("best_rate"))
    names = {"payment_method": "worst_method", "processor_id": "worst_processor", "customer_location": "worst_location",
             "amount_bin": "worst_amount_bin", "merchant_id": "worst_merchant", "hour": "peak_hour", "day_name": "peak_day"}
    tag = None
    for k, v in names.items():
        tag = F.when(F.col("dim") == k, v) if tag is None else tag.when(F.col("dim") == k, v)
    worst = ext.select(tag.alias("finding"), F.col("worst_key").alias("key"), F.col("worst_rate").alias("value"))
    best = ext.where(F.col("dim") == "payment_method").select(F.lit("best_method").alias("finding"),
                                                             F.col("best_key").alias("key"),
                                                             F.col("best_rate").alias("value"))
    err = g.where((F.col("dim") == "error_code") & (F.col("f") > 0))
    share = F.round(F.col("f").cast("double") * 100.0 / F.sum("f").over(Window.partitionBy()), 1)  # <= #codes rows
    err = err.withColumn("share_pct", share)
    top = err.orderBy(F.desc("f"), "key").limit(1).select(F.lit("top_error").alias("finding"), "key",
                                                          F.col("share_pct").alias("value"))
    comb = err.agg(F.sum(F.when(F.col("key").isin(*combined_codes), F.col("share_pct")).otherwise(0.0)).alias("value")) \
              .select(F.lit("combined_e002_e005").alias("finding"), F.lit("+".join(combined_codes)).alias("key"), "value")
    return worst.unionByName(best).unionByName(top).unionByName(comb)
