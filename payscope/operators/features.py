"""Feature engineering (SC*, JN1, JN4-JN9, WN1-WN2, WN6, WN8).

Design rules
* Group statistics are computed for ALL key sets in one scan with
  GROUPING SETS, then joined back; the stats table has one row per group,
  so AQE turns these joins into broadcast joins by measured size and the
  big side is never shuffled for them.  Only key sets with a fixed domain
  (hour, bins) get an explicit ``broadcast`` hint.
* Row-order features (rolling means, earlier failures) use the skew-safe
  prefix form of ``operators.windows``.
* Calendar lookups never join the big table against date ranges: the tiny
  calendar is expanded to one row per day first, then equi-joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import intervals as I
from payscope.operators import windows as W
from payscope.session import cut_lineage
from payscope.sources import schemas as S

BOUNDED_KEYS = {"hour", "day_of_week", "time_of_day", "amount_bin", "latency_bin", "is_weekend", "month"}


# -- SC1-SC4, SC30, SC31 ----------------------------------------------------------

def add_time_parts(df: DataFrame, ts: str = "txn_ts") -> DataFrame:
    return df.withColumns({
        "date": F.to_date(ts), "hour": F.hour(ts).cast("int"), "day_of_week": X.weekday(ts),
        "day_name": X.day_name(ts), "week": F.weekofyear(ts).cast("int"), "month": F.month(ts).cast("int"),
        "is_weekend": X.is_weekend(ts), "time_of_day": X.time_of_day(ts), "hhmm": X.hhmm(ts),
        "ts_text": X.format_ts(ts), "is_business_hours": X.is_business_hours(ts), "peak_band": X.peak_band(ts),
    })


# -- SC11 quantile bins ----------------------------------------------------------------

def _bin_case(c: str, edges: Column, labels: Sequence[str]) -> Column:
    """The label of the bin of ``c`` between ascending ``edges``; an error where an edge repeats."""
    x, case = F.col(c), None
    for i, lab in enumerate(labels):
        lower = (x >= edges[0]) if i == 0 else (x > edges[i])
        cond = lower & (x <= edges[i + 1])
        case = F.when(cond, lab) if case is None else case.when(cond, lab)
    dup = F.size(F.array_distinct(edges)) < len(labels) + 1
    return F.when(dup & x.isNotNull(), F.raise_error(F.lit(f"Bin edges must be unique for {c}"))).otherwise(case).cast("string")


def _bin_probs(labels: Sequence[str]) -> list[float]:
    return [i / len(labels) for i in range(len(labels) + 1)]


def qbin(df: DataFrame, c: str, labels: Sequence[str], out: str) -> DataFrame:
    """``pd.qcut``: edges at equal quantiles (linear interpolation), bins
    right-closed with the lowest edge included; duplicate edges raise."""
    # bind the statistic to a column ONCE: every reference to a scalar
    # subquery would otherwise be evaluated (and scan the input) separately
    t = df.withColumn("_edges", X.quantile_stat(df, c, _bin_probs(labels)))
    return t.withColumn(out, _bin_case(c, F.col("_edges"), labels)).drop("_edges")


def qbins(df: DataFrame, specs: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    """``qbin`` of several columns (column -> labels, new column) that share their scans.  The edges are read here (a few
    numbers a column) and become constants of the plan, so that a plan that reads its input more than once does not find
    them again."""
    stats = df.select(*[F.col(c) for c in specs])
    row = stats.sparkSession.range(1).select(X.quantile_struct(stats, {c: (c, _bin_probs(labels)) for c, (labels, _) in specs.items()}).alias("q")).first()["q"]
    out = df
    for c, (labels, name) in specs.items():
        edges = row[c] if row is not None and row[c] is not None else [None] * (len(labels) + 1)
        out = out.withColumn(name, _bin_case(c, F.array(*[F.lit(e).cast("double") for e in edges]), labels))
    return out


# -- SC22-SC26 scaling and encoding -------------------------------------------------------

def minmax(df: DataFrame, cols: Sequence[str], suffix: str = "_minmax") -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0 (not 0.5)."""
    t = df.withColumn("_st", df.select(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                                                  for c in cols])).scalar())
    out = {}
    for c in cols:
        lo, hi = F.col("_st")[c]["lo"], F.col("_st")[c]["hi"]
        out[c + suffix] = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))
    return t.withColumns(out).drop("_st")


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled", ddof: int = 0) -> DataFrame:
    """(x - mean) / std with ddof 0 (scikit-learn StandardScaler); std 0 -> 1."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    t = df.withColumn("_st", df.select(F.struct(*[F.struct(F.avg(c).alias("m"), sd(c).alias("s")).alias(c)
                                                  for c in cols])).scalar())
    st = F.col("_st")
    out = {}
    for c in cols:
        s = F.when((st[c]["s"] == 0) | st[c]["s"].isNull(), F.lit(1.0)).otherwise(st[c]["s"])
        out[c + suffix] = (F.col(c) - st[c]["m"]) / s
    return t.withColumns(out).drop("_st")


def robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_robust") -> DataFrame:
    """(x - median) / IQR; IQR 0 -> 1 (scikit-learn RobustScaler)."""
    t = df.withColumn("_q", X.quantile_struct(df, {f"q{i}": (c, [0.25, 0.5, 0.75]) for i, c in enumerate(cols)}))
    out = {}
    for i, c in enumerate(cols):
        q = F.col("_q")[f"q{i}"]
        iqr = F.when(q[2] - q[0] == 0, F.lit(1.0)).otherwise(q[2] - q[0])
        out[c + suffix] = (F.col(c) - q[1]) / iqr
    return t.withColumns(out).drop("_q")


def one_hot(df: DataFrame, c: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per given level; unknown -> all 0.  For a column whose
    levels are not known use ``one_hot_vector``."""
    return df.withColumns({f"{c}_{v}": (F.col(c) == F.lit(v)).cast("int") for v in levels})


def one_hot_vector(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """One sparse 0/1 vector over the levels found (any number of them);
    NULL -> all 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    stages = [StringIndexer(inputCol=c, outputCol="_ix", handleInvalid="keep"),
              OneHotEncoder(inputCol="_ix", outputCol=out or f"{c}_onehot", dropLast=True)]  # the last is "no level"
    return Pipeline(stages=stages).fit(df).transform(df).drop("_ix")


def label_encode(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """StringIndexer order: most frequent first (ties alphabetical), 0-based.
    The ranking runs over the distinct-value table, then joins back."""
    out = out or f"{c}_index"
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    # numbered in ranges of (count, value) that Spark cuts to even sizes, whatever the values look like
    ordered = g.withColumn("_o", -F.col("_n")).repartitionByRange("_o", c).withColumn("_range", F.spark_partition_id())
    ranked = W.row_index(cut_lineage(ordered), [], ["_o", c], "_r", slice_col=F.col("_range"))
    idx = ranked.select(c, (F.col("_r") - 1).cast("int").alias(out))
    return df.join(idx, c, "left")


def target_encode(df: DataFrame, c: str, target: str, train_mask: Column | None = None,
                  out: str | None = None) -> DataFrame:
    """Mean target per level, learned on the training rows only (no leak)."""
    out = out or f"{c}_target_mean"
    train = df if train_mask is None else df.where(train_mask)
    m = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.avg(F.col(target).cast("double")).alias(out))
    return df.join(m, c, "left")


# -- SC16 / SC17 / SC29 --------------------------------------------------------------------

def filter_dashboard(df: DataFrame, start: str | None = None, end: str | None = None,
                     methods: Sequence[str] = (), locations: Sequence[str] = (), ts: str = "txn_ts",
                     default_days: int = 7) -> DataFrame:
    """Inclusive date range and IN lists (empty list = no filter).  Without
    dates: the last ``default_days`` days up to the latest date."""
    if start is None and end is None:
        # the column itself against one computed bound, so the scan can use it
        first = F.date_sub(F.to_date(df.select(F.max(ts)).scalar()), default_days - 1)
        cond = F.col(ts) >= first.cast(df.schema[ts].dataType)
    else:
        cond = F.lit(True)
        if start is not None:
            cond = cond & (F.col(ts) >= F.to_timestamp_ntz(F.lit(start)))
        if end is not None:
            cond = cond & (F.col(ts) < F.to_timestamp_ntz(F.date_add(F.to_date(F.lit(end)), 1)))
    if methods:
        cond = cond & F.col("payment_method").isin(list(methods))
    if locations:
        cond = cond & F.col("customer_location").isin(list(locations))
    return df.where(cond)


def filter_summary(df: DataFrame, cond: Column) -> DataFrame:
    return df.agg(F.count_if(cond).alias("shown"), F.count(F.lit(1)).alias("total"))


def date_spine(df: DataFrame, ts: str = "txn_ts") -> DataFrame:
    """One row per day from the first to the last date (zero-filled counts):
    the spine is generated from two scalars, then left-joined to the daily
    aggregate (both tables are one row per day)."""
    b = df.select(F.struct(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))).scalar()
    one = df.sparkSession.range(1).withColumn("_b", b)
    spine = one.select(F.explode(F.sequence(F.col("_b.lo"), F.col("_b.hi"), F.expr("INTERVAL 1 DAY"))).alias("date"))
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(daily, "date", "left").select("date", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def display_rows(df: DataFrame) -> DataFrame:
    """SC19: dollar and millisecond text, title-case headers."""
    t = df.select(X.format_ts("txn_ts").alias("timestamp"), "merchant_id", "payment_method",
                  F.concat(F.lit("$"), F.format_number("payment_amount", 2)).alias("payment_amount"),
                  F.concat(F.format_number("network_latency", 1), F.lit(" ms")).alias("network_latency"),
                  F.initcap("result").alias("result"))
    return t.toDF(*[c.replace("_", " ").title() for c in t.columns])


# -- JN1: all group statistics in one pass ---------------------------------------------------

GROUP_STATS = [
    ("merchant", ["merchant_id"], {"merchant_transaction_count": "count", "merchant_success_rate": "mean"}),
    ("hour", ["hour"], {"hourly_transaction_volume": "count", "hourly_success_rate": "mean"}),
    ("processor", ["processor_id"], {"processor_success_rate": "mean"}),
    ("device", ["device_type"], {"device_success_rate": "mean"}),
    ("latency_bin", ["latency_bin"], {"latency_bin_success_rate": "mean"}),
    ("location", ["customer_location"], {"location_success_rate": "mean"}),
    ("method_location", ["payment_method", "customer_location"], {"payment_location_success_rate": "mean"}),
]


def group_stats_table(df: DataFrame, specs=GROUP_STATS, label: str = "result_numeric") -> DataFrame:
    """ONE aggregation over all key sets (GROUPING SETS): gid, keys, n, mean.
    pandas drops NULL keys from groupby, so a NULL key gets no statistic."""
    keys = sorted({k for _, ks, _ in specs for k in ks})
    sets = [[F.col(k) for k in ks] for _, ks, _ in specs]
    g = df.groupingSets(sets, *keys).agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n"),
                                          F.avg(F.col(label).cast("double")).alias("_mean"))
    return g


def attach_group_stats(df: DataFrame, specs=GROUP_STATS, label: str = "result_numeric",
                       materialize: bool = True, stats_from: DataFrame | None = None) -> DataFrame:
    """Left-join every group statistic (of ``stats_from``, the rows without
    columns not needed for it) back to the rows.  The stats table
    (one row per group and key set) is materialised once into the checkpoint
    folder: the joins below then read that small table instead of each
    re-running the aggregation (self-joins defeat exchange reuse)."""
    keys_all = sorted({k for _, ks, _ in specs for k in ks})
    g = group_stats_table(df if stats_from is None else stats_from, specs, label)
    if materialize and len(specs) > 1:
        g = cut_lineage(g)
    out = df
    for _, ks, measures in specs:
        gid = sum(1 << (len(keys_all) - 1 - i) for i, k in enumerate(keys_all) if k not in ks)
        nn = F.lit(True)
        for k in ks:
            nn = nn & F.col(k).isNotNull()
        s = g.where((F.col("_gid") == gid) & nn).select(
            *ks, *[(F.col("_n") if how == "count" else F.col("_mean")).alias(name) for name, how in measures.items()])
        if set(ks) <= BOUNDED_KEYS:
            s = F.broadcast(s)
        out = out.join(s, ks, "left")
    return out


def attach_group_stat(df: DataFrame, keys: Sequence[str], name: str, how: str = "mean",
                      label: str = "result_numeric") -> DataFrame:
    """Single key set version (JN1)."""
    return attach_group_stats(df, [("one", list(keys), {name: how})], label)


# -- JN4 ------------------------------------------------------------------------------------------

def is_peak_hour(df: DataFrame, q: float = 0.75, volumes_from: DataFrame | None = None) -> DataFrame:
    """Hours whose volume is above the q-quantile of hourly volumes (24-row
    table, broadcast: its size is fixed by the clock).  ``volumes_from``:
    count on this (narrower) frame instead of ``df``."""
    src = df if volumes_from is None else volumes_from
    h = src.groupBy(F.hour("txn_ts").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("_vol"))
    thr = h.select(X.small_quantile("_vol", q)).scalar()
    peak = h.where(F.col("_vol") > thr).select("hour", F.lit(1).alias("is_peak_hour"))
    out = df if "hour" in df.columns else df.withColumn("hour", F.hour("txn_ts").cast("int"))
    return out.join(F.broadcast(peak), "hour", "left").withColumn("is_peak_hour", F.coalesce("is_peak_hour", F.lit(0)))


# -- JN5 / JN6: event calendar ------------------------------------------------------------------

def calendar_days(cal: DataFrame) -> DataFrame:
    """Expand the (tiny) calendar to one row per event day."""
    return cal.select("*", F.explode(F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))).alias("date"))


def tag_event(df: DataFrame, cal: DataFrame, ts: str = "txn_ts", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Name of the event that holds the row's time; regional before custom,
    then list order (first match wins).  Events may have dates or times, may
    overlap and may last long (``intervals``)."""
    t = I.with_intervals(df, cal, ts, start, end, ["priority", "name"], "_events")
    return t.withColumn("regional_event", F.array_min("_events")["name"]).drop("_events")


def event_factor(df: DataFrame, cal: DataFrame, ts: str = "txn_ts", method: str = "payment_method", start: str = "start_date",
                 end: str = "end_date") -> DataFrame:
    """Failure factor: the first regional event at the row's time (else 1.0), then
    the max with the custom events then that list the row's method."""
    t = I.with_intervals(df, cal, ts, start, end, ["priority", "failure_factor", "kind", "affected_payment_methods"], "_events")
    regional = F.array_min(F.filter("_events", lambda e: e["kind"] == "regional"))["failure_factor"]
    custom = F.array_max(F.transform(F.filter("_events", lambda e: (e["kind"] == "custom") & F.array_contains(e["affected_payment_methods"], F.col(method))),
                                     lambda e: e["failure_factor"]))
    return t.withColumn("event_factor", F.greatest(F.coalesce(regional, F.lit(1.0)), F.coalesce(custom, F.lit(0.0)))).drop("_events")


# -- JN7 --------------------------------------------------------------------------------------------

def lookup_dims(df: DataFrame, pm_dim: DataFrame, proc_dim: DataFrame, err_dim: DataFrame) -> DataFrame:
    """Broadcast equi-joins with the three fixed dimensions (5, 5, 10 rows)."""
    return (df.join(F.broadcast(pm_dim), "payment_method", "left")
              .join(F.broadcast(proc_dim), "processor_id", "left")
              .join(F.broadcast(err_dim), "error_code", "left"))


# -- JN8 / JN9 -----------------------------------------------------------------------------------------

def compare_decisions(a: DataFrame, b: DataFrame, id_col: str = "transaction_id",
                      col_a: str = "decision_a", col_b: str = "decision_b") -> DataFrame:
    j = a.select(id_col, F.col(col_a).alias("_a")).join(b.select(id_col, F.col(col_b).alias("_b")), id_col)
    return j.agg(F.count(F.lit(1)).alias("n"), X.rnd(F.avg((F.col("_a") == F.col("_b")).cast("int"))).alias("agreement"))


def prediction_vs_actual(scored: DataFrame, feedback: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """Predictions joined with the outcomes that came back later (left)."""
    return scored.join(feedback, id_col, "left")


# -- WN1 / WN2 / WN6 / WN8 --------------------------------------------------------------------------

def merchant_rolling_avg_amount(df: DataFrame, n: int = 10, min_periods: int = 1, method: str = "prefix",
                                out: str = "merchant_rolling_avg_amount", materialize: bool = False) -> DataFrame:
    return W.rolling_rows(df, ["merchant_id"], ["txn_ts", "transaction_id"], "payment_amount", n, min_periods,
                          out, method=method, materialize=materialize)


def payment_method_rolling_success(df: DataFrame, n: int = 50, min_periods: int = 5, method: str = "prefix",
                                   out: str = "payment_method_rolling_success", leak_free: bool = False,
                                   materialize: bool = False) -> DataFrame:
    """Trailing 50-row success mean per method (5 keys: the skew case the
    prefix form exists for).  Default = the reference (the frame includes
    the row's own label); ``leak_free`` uses the 50 rows before it (T7)."""
    return W.rolling_rows(df, ["payment_method"], ["txn_ts", "transaction_id"], X.is_success("result"), n,
                          min_periods, out, method=method, exclude_current=leak_free, materialize=materialize)


def previous_failures(df: DataFrame, method: str = "prefix", out: str = "previous_failures") -> DataFrame:
    """Failures of the same customer strictly before this row (T11)."""
    return W.running_before(df, ["customer_id"], ["txn_ts", "transaction_id"], X.is_failure("result"), out,
                            method=method)


def repeat_customer_rate(df: DataFrame) -> DataFrame:
    """Share of a merchant's rows from customers seen before at that
    merchant = (rows - distinct customers) / rows: two partial aggregations,
    no window, no single hot partition."""
    mc = df.groupBy("merchant_id", "customer_id").agg(F.count(F.lit(1)).alias("_c"))
    g = mc.groupBy("merchant_id").agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("n_customers"))
    return g.select("merchant_id", F.col("n").cast("bigint").alias("n"), "n_customers",
                    X.rnd((F.col("n") - F.col("n_customers")) / F.col("n")).alias("repeat_rate"))


# -- the feature table --------------------------------------------------------------------------------

SCALE_COLS = ["network_latency", "merchant_rolling_avg_amount", "merchant_success_rate", "device_success_rate",
              "payment_method_rolling_success", "location_success_rate", "payment_location_success_rate"]


#: The column that a derived feature is made of.
MADE_OF = {"amount_bin_encoded": "amount_bin", "latency_bin_encoded": "latency_bin", "merchant_transaction_count_log": "merchant_transaction_count",
           "hourly_transaction_volume_log": "hourly_transaction_volume", "amount_log": "payment_amount"} | {f"{c}_scaled": c for c in SCALE_COLS}


def features(df: DataFrame, method: str = "prefix", checkpoint: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Transactions -> the modelling feature table (the studied feature set).  ``columns``: these only, in this order; the
    shuffles and the two writes then carry no other column than they need."""
    wanted = None if columns is None else {*columns, *(MADE_OF[c] for c in columns if c in MADE_OF)}

    def narrow(t: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return t if wanted is None else t.select(*[c for c in t.columns if c in wanted or c in also])

    t = df.withColumn("result_numeric", X.is_success("result"))
    t = qbins(t, {"payment_amount": (S.AMOUNT_QBIN_LABELS, "amount_bin"), "network_latency": (S.LATENCY_QBIN_LABELS, "latency_bin")})
    base = t.withColumns({"hour": F.hour("txn_ts").cast("int"), "day_of_week": X.weekday("txn_ts"),
                          "day_name": X.day_name("txn_ts"), "month": F.month("txn_ts").cast("int"),
                          "is_weekend": X.is_weekend("txn_ts"), "time_of_day": X.time_of_day("txn_ts"),
                          "has_retry": X.has_retry("retry_count")})
    # ``base`` is one projection of the input, cheap to read again.  The rows are written twice: before the second window (its
    # numbering reads them twice) and, with everything joined, before the scaling (which reads seven columns first).
    t = merchant_rolling_avg_amount(base, method=method)
    t = narrow(t, ["txn_ts", "transaction_id", "result", "result_numeric", "hour", *(k for _, ks, _ in GROUP_STATS for k in ks)])
    t = payment_method_rolling_success(t, method=method, materialize=checkpoint and method == "prefix")
    t = attach_group_stats(t, stats_from=base)
    t = is_peak_hour(t, volumes_from=base.select("txn_ts"))
    t = cut_lineage(narrow(t)) if checkpoint else narrow(t)
    made = {
        "amount_bin_encoded": X.ordinal("amount_bin", S.AMOUNT_QBIN_LABELS),
        "latency_bin_encoded": X.ordinal("latency_bin", S.LATENCY_QBIN_LABELS),
        "merchant_transaction_count_log": F.log1p("merchant_transaction_count"),
        "hourly_transaction_volume_log": F.log1p("hourly_transaction_volume"),
        "amount_log": F.log1p("payment_amount"),
    }
    if wanted is None:
        return standardize(t.withColumns(made), SCALE_COLS)
    t = t.withColumns({c: v for c, v in made.items() if c in wanted})
    scaled = [c for c in SCALE_COLS if f"{c}_scaled" in wanted]
    return (standardize(t, scaled) if scaled else t).select(*columns)
