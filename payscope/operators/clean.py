"""Profiling and cleaning (PR*, CL*).

Statistics a projection needs (medians, fences, means) are computed by one
aggregation and used as a scalar subquery: the plan stays lazy, no join and
no collect, and Spark merges scalar subqueries over the same input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions import expr as X

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def columns_by_type(df: DataFrame, kind: str = "numeric", exclude: Sequence[str] = ()) -> list[str]:
    """SC27: numeric or non-numeric column names, minus exclusions (plan time)."""
    out = []
    for f in df.schema.fields:
        num = isinstance(f.dataType, _NUMERIC)
        if f.name in exclude:
            continue
        if (kind == "numeric") == num:
            out.append(f.name)
    return out


def _stack(row: DataFrame, items: Sequence[tuple[str, str]], names: str) -> DataFrame:
    """Unpivot a one-row frame: items are (label, sql expr over row cols)."""
    body = ", ".join(f"'{lab}', {e}" for lab, e in items)
    return row.selectExpr(f"stack({len(items)}, {body}) AS ({names})")


# -- PR1-PR6 --------------------------------------------------------------------

def shape_types(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def dtypes_table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, dtype string")


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count and % (2 dp) per column, in one aggregation."""
    def miss(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.count_if(c.isNull() | F.isnan(c))
        return F.count_if(c.isNull())
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[miss(f).alias(f"m{i}") for i, f in enumerate(fields)])
    long = _stack(row, [(f.name, f"m{i}, _n") for i, f in enumerate(fields)], "column, missing, n")
    return long.select("column", F.col("missing").cast("bigint").alias("missing"),
                       F.round(F.col("missing") * 100.0 / F.col("n"), 2).alias("missing_pct"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per NULL pattern: a '0'/'1' flag per column in column order."""
    flags = [F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per column."""
    cols = list(cols) if cols is not None else columns_by_type(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mu{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).withColumn("q", X.quantile_struct(df, {f"q{i}": (c, [0.25, 0.5, 0.75]) for i, c in enumerate(cols)}))
    long = _stack(row, [(c, f"n{i}, mu{i}, sd{i}, lo{i}, q.q{i}[0], q.q{i}[1], q.q{i}[2], hi{i}") for i, c in enumerate(cols)],
                  "column, count, mean, std, min, p25, p50, p75, max")
    return long.select("column", F.col("count").cast("bigint").alias("count"),
                       *[X.rnd(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row = sum over groups of (n - 1)."""
    cols = list(cols) if cols is not None else df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                 F.sum("_n").cast("bigint").alias("n_rows"))


def label_distribution(df: DataFrame, label: str = "result") -> DataFrame:
    """Counts and share per label value, and the overall failure rate."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(X.is_failure(label)).alias("_f"))
    w = Window.partitionBy()  # over the label table: a handful of rows
    return g.select(label, "n", X.rnd(F.col("n") / F.sum("n").over(w)).alias("share"),
                    F.round(F.sum("_f").over(w) * 100.0 / F.sum("n").over(w), 2).alias("overall_failure_rate"))


# -- CL1-CL3 imputation ----------------------------------------------------------

SENTINELS = {"error_code": "no_error", "failure_reason": "no_failure", "regional_event": "no_event"}


def fill_sentinels(df: DataFrame, values: dict | None = None) -> DataFrame:
    values = {k: v for k, v in (values or SENTINELS).items() if k in df.columns}
    return df.na.fill(values)


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", fill_value=0) -> DataFrame:
    """mean / median (interpolated) / zero / constant / most_frequent, as a
    scalar subquery per column (merged by the optimizer into one scan)."""
    out = df
    for c in cols:
        x = F.col(c)
        if strategy == "mean":
            v = df.select(F.avg(x)).scalar()
        elif strategy == "median":
            v = X.quantile_stat(df, c, 0.5)
        elif strategy in ("zero", "constant"):
            v = F.lit(0 if strategy == "zero" else fill_value)
        elif strategy == "most_frequent":
            # ties -> smallest value, like scikit-learn
            v = (df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
                 .select(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).scalar())
        else:
            raise ValueError(f"unknown strategy {strategy}")
        out = out.withColumn(c, F.coalesce(x, v.cast(df.schema[c].dataType)))
    return out


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return impute(df, cols, "median")


# -- CL4-CL7 outliers ------------------------------------------------------------------

def iqr_fences(df: DataFrame, c: str, k: float = 1.5) -> tuple[Column, Column]:
    q = X.quantile_stat(df, c, [0.25, 0.75])
    iqr = q[1] - q[0]
    return q[0] - k * iqr, q[1] + k * iqr


def outliers_iqr(df: DataFrame, c: str, k: float = 1.5) -> Column:
    """Mask Column (references the fences twice); prefer ``flag_outliers``."""
    lo, hi = iqr_fences(df, c, k)
    return (F.col(c) < lo) | (F.col(c) > hi)


def flag_outliers(df: DataFrame, c: str, method: str = "iqr", threshold: float | None = None,
                  out: str = "is_outlier") -> DataFrame:
    """Adds a boolean outlier flag; the statistics are ONE scalar subquery
    bound to a column (one extra scan, whatever the number of uses)."""
    x = F.col(c)
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        t = df.withColumn("_q", X.quantile_stat(df, c, [0.25, 0.75]))
        q = F.col("_q")
        flag = (x < q[0] - k * (q[1] - q[0])) | (x > q[1] + k * (q[1] - q[0]))
    elif method == "zscore":
        t = df.withColumn("_st", df.select(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar())
        flag = F.abs((x - F.col("_st.m")) / F.col("_st.s")) > (3.0 if threshold is None else threshold)
    else:
        raise ValueError("method must be 'iqr' or 'zscore'")
    return t.withColumn(out, flag).drop("_st", "_q")


def outliers_zscore(df: DataFrame, c: str, threshold: float = 3.0) -> Column:
    st = df.select(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))).scalar()
    return F.abs((F.col(c) - st["m"]) / st["s"]) > threshold


def outlier_mask(df: DataFrame, c: str, method: str = "iqr", threshold: float | None = None) -> Column:
    if method == "iqr":
        return outliers_iqr(df, c, 1.5 if threshold is None else threshold)
    if method == "zscore":
        return outliers_zscore(df, c, 3.0 if threshold is None else threshold)
    raise ValueError("method must be 'iqr' or 'zscore'")


def outlier_report(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """n and % of IQR outliers per column: the quantiles of all columns
    share their scans, then one counting aggregation."""
    df = df.withColumn("_q", X.quantile_struct(df, {f"q{i}": (c, [0.25, 0.75]) for i, c in enumerate(cols)}))
    aggs = []
    for i, c in enumerate(cols):
        qq = F.col("_q")[f"q{i}"]
        iqr = qq[1] - qq[0]
        m = (F.col(c) < qq[0] - k * iqr) | (F.col(c) > qq[1] + k * iqr)
        aggs.append(F.count_if(m).alias(f"o{i}"))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    long = _stack(row, [(c, f"o{i}, _n") for i, c in enumerate(cols)], "column, outliers, n")
    return long.select("column", F.col("outliers").cast("bigint").alias("outliers"),
                       F.round(F.col("outliers") * 100.0 / F.col("n"), 2).alias("outlier_pct"))


def cap_outliers(df: DataFrame, c: str, q: float = 0.99, k: float = 1.5, mode: str = "reference") -> DataFrame:
    """``reference``: every IQR-outlier (low ones too) := the q-quantile
    (trap T6, kept on purpose).  ``winsor``: clip each side to its fence."""
    df = df.withColumn("_st", X.quantile_struct(df, {"iq": (c, [0.25, 0.75]), "cap": (c, [q])}))
    st = F.col("_st")
    iqr = st["iq"][1] - st["iq"][0]
    lo, hi = st["iq"][0] - k * iqr, st["iq"][1] + k * iqr
    x = F.col(c)
    if mode == "reference":
        v = F.when((x < lo) | (x > hi), st["cap"][0]).otherwise(x)
    elif mode == "winsor":
        v = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
    else:
        raise ValueError("mode must be 'reference' or 'winsor'")
    return df.withColumn(c, v).drop("_st")


# -- CL8 / CL9 ---------------------------------------------------------------------

def standardize_text(df: DataFrame, exclude: Sequence[str] = ("transaction_id", "merchant_id", "customer_id")) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name not in exclude:
            cols.append(X.standardize_text(f.name).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def parse_timestamps(df: DataFrame, c: str, fmt: str | None = None) -> DataFrame:
    if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df
    return df.withColumn(c, X.parse_ts(c, fmt))


# -- CL10-CL12 distribution tables -----------------------------------------------------

def box_stats(df: DataFrame, by: str, c: str, k: float = 1.5) -> DataFrame:
    """Per group: min, Q1, median, Q3, max, whisker ends (most extreme data
    within the 1.5 IQR fences) and outlier count.  Quartiles by one
    aggregation; whiskers by a join of the per-group quartiles back to the
    rows (shuffle join on the group key; AQE broadcasts it when small)."""
    t = df.where(F.col(by).isNotNull() & F.col(c).isNotNull()).select(by, F.col(c).cast("double").alias("x"))
    from payscope.operators.windows import exact_quantile_arrays
    q = exact_quantile_arrays(t, {"q": ("x", [0.25, 0.5, 0.75])}, [by]).select(
        by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    mm = t.groupBy(by).agg(F.min("x").alias("min"), F.max("x").alias("max"))
    q = mm.join(q, by).select(by, "min", "q1", "median", "q3", "max")
    j = t.join(q.select(by, "q1", "q3"), by)
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    inside = (F.col("x") >= lo) & (F.col("x") <= hi)
    w = j.groupBy(by).agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
                          F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
                          F.count_if(~inside).alias("n_outliers"))
    r = q.join(w, by)
    return r.select(by, *[X.rnd(x).alias(x) for x in ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"]],
                    F.col("n_outliers").cast("bigint").alias("n_outliers"))


def histogram(df: DataFrame, c: str, nbins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max]; the max lands in the last bin."""
    df = df.withColumn("_st", df.select(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar())
    st = F.col("_st")
    w = (st["hi"] - st["lo"]) / nbins
    b = F.when(w == 0, 0).otherwise(F.least(F.floor((F.col(c) - st["lo"]) / w), F.lit(nbins - 1))).cast("int")
    keys = [by] if by else []
    t = df.where(F.col(c).isNotNull())
    if by:
        t = t.where(F.col(by).isNotNull())
    g = t.groupBy(*keys, b.alias("bin"), F.col("_st")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "bin", X.rnd(st["lo"] + F.col("bin") * w).alias("bin_lo"),
                    X.rnd(st["lo"] + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def kde(df: DataFrame, c: str, grid: int = 200, bins: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on a grid, from a histogram.

    Raw rows are reduced to ``bins`` bin counts first; each of those rows
    explodes the fixed ``grid`` points and the density is one aggregation,
    so the work is bins x grid regardless of the row count."""
    x = F.col(c).cast("double")
    df = df.withColumn("_st", df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
                                                 F.stddev_samp(x).alias("sd")).alias("s")).scalar())
    st = F.col("_st")
    bw = st["sd"] * F.pow(st["n"].cast("double"), F.lit(-0.2))
    width = (st["hi"] - st["lo"]) / bins
    b = F.least(F.floor((x - st["lo"]) / width), F.lit(bins - 1)).cast("int")
    h = df.where(x.isNotNull()).groupBy(b.alias("bin"), F.col("_st")).agg(F.count(F.lit(1)).alias("cnt"))
    center = st["lo"] + (F.col("bin") + 0.5) * width
    g0, g1 = st["lo"] - cut * bw, st["hi"] + cut * bw
    h = h.withColumn("center", center).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = g0 + F.col("g") * (g1 - g0) / (grid - 1)
    dens = F.sum(F.col("cnt") * F.exp(-0.5 * F.pow((gx - F.col("center")) / bw, 2)))
    out = h.groupBy("g", "_st").agg(F.first(gx).alias("x"), dens.alias("_s"))
    norm = st["n"] * bw * math.sqrt(2 * math.pi)
    return out.select(F.col("g").alias("grid_index"), X.rnd("x").alias("x"), X.rnd(F.col("_s") / norm).alias("density"))
