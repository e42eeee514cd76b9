"""Column expressions (JVM-side, whole-stage-codegen friendly).

Every function returns a ``Column``; none runs a job.  Names follow the
operator inventory (SC*, SC5 label rule, hashing for splits and arms).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from payscope.sources import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- label rule (T1) ---------------------------------------------------------

def is_success(result="result") -> Column:
    """1 when ``result='success'``, 0 for failure/failed, NULL otherwise
    (``pending`` and unknown values carry no label)."""
    r = F.lower(F.trim(_c(result)))
    return F.when(r == "success", 1).when(r.isin("failure", "failed"), 0).cast("int")


def is_failure(result="result") -> Column:
    r = F.lower(F.trim(_c(result)))
    return F.when(r.isin("failure", "failed"), 1).when(r == "success", 0).cast("int")


# -- time parts (SC1-SC4, SC30, SC31) -----------------------------------------

def weekday(ts="txn_ts") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts)).cast("int")


def day_name(ts="txn_ts") -> Column:
    return F.date_format(_c(ts), "EEEE")


def time_parts(ts="txn_ts") -> list[Column]:
    t = _c(ts)
    return [F.to_date(t).alias("date"), F.hour(t).cast("int").alias("hour"),
            weekday(t).alias("day_of_week"), day_name(t).alias("day_name"),
            F.weekofyear(t).cast("int").alias("week"), F.month(t).cast("int").alias("month")]


def is_weekend(ts="txn_ts") -> Column:
    return (weekday(ts) >= 5).cast("int")


def left_closed_lookup(x: Column, spec) -> Column:
    """CASE over ``[lo, hi) -> label`` triples; NULL outside."""
    out = None
    for lo, hi, lab in spec:
        cond = (x >= lo) & (x < hi)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def time_of_day(ts="txn_ts") -> Column:
    return left_closed_lookup(F.hour(_c(ts)), S.TIME_OF_DAY)


def hhmm(ts="txn_ts") -> Column:
    return F.date_format(_c(ts), "HH:mm")


def format_ts(ts="txn_ts") -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def is_business_hours(ts="txn_ts") -> Column:
    h = F.hour(_c(ts))
    return ((weekday(ts) < 5) & (h >= 9) & (h < 18)).cast("int")


def peak_band(ts="txn_ts") -> Column:
    h = F.hour(_c(ts))
    return (F.when((h >= 8) & (h < 10), "morning_peak").when((h >= 18) & (h < 20), "evening_peak")
            .when(h >= 22, "late_night").otherwise("off_peak"))


# -- ids and small scalar rules (SC6-SC8, SC13, SC14, SC21) -------------------

def digits_of_id(c) -> Column:
    return F.regexp_extract(_c(c), r"(\d+)", 1).cast("int")


def zero_fill(n, width: int) -> Column:
    """The number as text, zeros before it up to ``width``; longer numbers
    stay whole (``lpad`` would cut them)."""
    t = _c(n).cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def make_id(prefix: str, n, width: int) -> Column:
    return F.concat(F.lit(prefix), zero_fill(n, width))


def log1p(c) -> Column:
    return F.log1p(_c(c))


def has_retry(c="retry_count") -> Column:
    return (_c(c) > 0).cast("int")


def clip01(c) -> Column:
    return F.least(F.greatest(_c(c), F.lit(0.0)), F.lit(1.0))


def action(p, threshold: float = S.ROUTE_THRESHOLD) -> Column:
    return F.when(_c(p) > threshold, "route").otherwise("review")


def standardize_text(c) -> Column:
    return F.lower(F.trim(_c(c)))


def parse_ts(c, fmt: str | None = None) -> Column:
    """String -> timestamp_ntz; unparsable text becomes NULL."""
    col = _c(c)
    if fmt:
        return F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")
    return F.try_to_timestamp(col).cast("timestamp_ntz")


# -- fixed bins (SC9, SC10) ---------------------------------------------------

def right_closed_bins(x, edges: Sequence[float], labels: Sequence[str], include_lowest: bool) -> Column:
    """``pd.cut`` with explicit edges: (e_i, e_i+1]; NULL out of range."""
    x = _c(x)
    out = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= lo) if (i == 0 and include_lowest) else (x > lo)
        cond = lower & (x <= hi) if hi != float("inf") else lower
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def amount_bin_fixed(x="payment_amount") -> Column:
    return right_closed_bins(x, S.AMOUNT_BIN_FIXED_EDGES, S.AMOUNT_BIN_FIXED_LABELS, True)


def amount_bin_open(x="payment_amount") -> Column:
    return right_closed_bins(x, S.AMOUNT_BIN_OPEN_EDGES + [float("inf")], S.AMOUNT_BIN_OPEN_LABELS, False)


def ordinal(c, labels: Sequence[str], base: int = 1, strict: bool = False) -> Column:
    """Label -> base, base+1, ...; unknown -> NULL, or an error when strict."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i + base))])
    v = m[_c(c)]
    if strict:
        return F.when(v.isNull() & _c(c).isNotNull(),
                      F.raise_error(F.concat(F.lit("unknown label: "), _c(c)))).otherwise(v).cast("int")
    return v.cast("int")


# -- hashing (ML2, RO16, TK8) ------------------------------------------------

def hash_bucket(id_col, seed: int = 42, buckets: int = 100) -> Column:
    """Stable bucket of an id: first 28 bits of md5(id|seed) mod buckets.
    The same expression exists in DuckDB, so splits have an oracle."""
    h = F.md5(F.concat(_c(id_col).cast("string"), F.lit(f"|{seed}")))
    return (F.conv(F.substring(h, 1, 7), 16, 10).cast("bigint") % buckets).cast("int")


def hash_uniform(*cols, seed: int = 42) -> Column:
    """Deterministic uniform in [0, 1) from the given columns and a seed."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols] + [F.lit(str(seed))]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


# -- rounding helpers ---------------------------------------------------------

def pct(num, den, digits: int = 2) -> Column:
    return F.round(_c(num).cast("double") * 100.0 / _c(den), digits)


def rnd(c, digits: int = 6) -> Column:
    return F.round(_c(c).cast("double"), digits)


# -- quantiles -----------------------------------------------------------------

def small_quantile(c, p):
    """Quantile(s) by Spark's ``percentile`` (linear interpolation, like
    pandas).  It merges the distinct values in one task, so it is for tables
    of bounded size only: hours, replicates, rates by a dimension."""
    return F.percentile(_c(c), p)


def quantile_stat(df, c, p):
    """Exact quantile(s) of a whole column as ONE scalar value (scalar
    subquery): a double for a float ``p``, an array<double> in ``p`` order
    for a list (``windows.exact_quantiles``)."""
    v = quantile_struct(df, {"q": (c, list(p) if isinstance(p, (list, tuple)) else [p])})["q"]
    return v if isinstance(p, (list, tuple)) else v[0]


def quantile_struct(df, specs: dict):
    """Several quantile statistics as ONE struct value: ``specs`` maps a field
    name to (column name, probabilities); all share the same scans."""
    from payscope.operators.windows import exact_quantile_arrays
    return exact_quantile_arrays(df, specs).select(F.struct(*specs)).scalar()
