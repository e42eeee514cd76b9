"""Row-count windows that survive a hot key.

``Window.partitionBy(key)`` puts every row of a key in ONE task; with a
key holding a third of the data that task is the job.  The forms below
never do.  Rows are numbered inside (key, slice) partitions and per-slice
totals are carried forward on the small (key, slice) table (null-safe on
key and slice, so no row is lost).  A rolling frame of n rows is then an
ordinary window over (key, block of row numbers), each block with the last
n rows of the blocks before it: no frame crosses a block, and values are
summed as they are, without differences of running sums.

NULLs: a row with a NULL order value sorts first; rows with a NULL in a
key stay in the result, with a NULL feature (as pandas ``groupby`` does).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a unit score range in which rows are numbered; the carried table has a row for each part in use.
SCORE_SLICES = 1 << 20

#: Rows of a key in one task of a rolling window.
BLOCK_ROWS = 100_000


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def _no_key(keys: Sequence[str]) -> Column:
    """True where a key is NULL."""
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                slice_col: Column) -> DataFrame:
    """Add ``_g`` (1-based row number inside ``keys`` along ``order``) and,
    per entry of ``values``, ``_P_<name>`` = running sum up to and including
    the row, in the value's own type (integers exactly).  ``slice_col`` must
    be non-decreasing along ``order`` (e.g. the minute of the leading
    timestamp), NULL first; it only decides how the work is cut."""
    keys, order = _cols(keys), _cols(order)
    t = df.withColumn("_slice", slice_col)
    for name, v in values.items():
        t = t.withColumn(f"_v_{name}", v)
    # per-slice totals straight from the input (partial aggregation, small output)
    tot = t.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_sc"),
                                         *[F.sum(f"_v_{n}").alias(f"_ss_{n}") for n in values])
    w_in = Window.partitionBy(*keys, "_slice").orderBy(*order)
    run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_rn", F.row_number().over(w_in))
    for name in values:
        t = t.withColumn(f"_ps_{name}", F.coalesce(F.sum(f"_v_{name}").over(run), F.lit(0)))
    # carry-forward over the (key, slice) table: one row per slice, small
    w_k = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_slice").alias("_o_slice"),
                     F.coalesce(F.sum("_sc").over(w_k), F.lit(0)).alias("_oc"),
                     *[F.coalesce(F.sum(f"_ss_{n}").over(w_k), F.lit(0)).alias(f"_os_{n}") for n in values])
    cond = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in [*keys]] + [F.col("_slice").eqNullSafe(F.col("_o_slice"))]
    j = t.join(off, cond)
    j = j.withColumn("_g", F.col("_oc") + F.col("_rn"))
    for n in values:
        j = j.withColumn(f"_P_{n}", F.col(f"_os_{n}") + F.col(f"_ps_{n}"))
    drop = ["_slice", "_o_slice", "_rn", "_oc"] + [f"_o_{k}" for k in keys] + [f"_{p}_{n}" for n in values for p in ("ps", "os", "v")]
    return j.drop(*drop)


def default_slice(order_col: str) -> Column:
    return F.date_trunc("minute", F.col(order_col))


def rolling_rows(df: DataFrame, keys, order, value: str | Column | dict[str, Column], n: int, min_periods: int, out: str | None = None,
                 slice_col: Column | None = None, method: str = "prefix", stat: str = "mean",
                 exclude_current: bool = False, materialize: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trailing n-row mean (or sum) of ``value`` per key, NULL while fewer
    than ``min_periods`` non-null values are in the frame (pandas
    ``rolling(n, min_periods)``) and for rows without key.

    ``method='window'`` frames the rows of a key with ordinary windows (for
    keys known to be small), where the leading order column is a time inside
    an hour of the key first (``_framed_by_hour``); ``method='prefix'`` is the
    skew-safe default.
    ``exclude_current``: the frame is the n rows BEFORE this one (no label
    leakage from the row itself, trap T7).  ``materialize``: checkpoint the
    input first - the row numbering reads its input twice, so an
    expensive input (a multi-way join) is then computed once.  Several
    values (``value``: new column -> value) share numbering and frames."""
    keys, order = _cols(keys), _cols(order)
    vals = value if isinstance(value, dict) else {out: F.col(value) if isinstance(value, str) else value}
    lo, hi = (-n, -1) if exclude_current else (-(n - 1), 0)

    def framed(t: DataFrame, vs: list[Column], w) -> DataFrame:
        agg = F.avg if stat == "mean" else F.sum
        return t.withColumns({name: F.when((F.count(v).over(w) >= min_periods) & ~_no_key(keys), agg(v).over(w).cast("double"))
                              for name, v in zip(vals, vs)})

    if method == "window":
        vs = list(vals.values())
        if df.schema[order[0]].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
            return _framed_by_hour(df, keys, order, lambda t, w: framed(t, vs, w), lo, hi)
        return framed(df, vs, Window.partitionBy(*keys).orderBy(*order).rowsBetween(lo, hi))
    slice_col = default_slice(order[0]) if slice_col is None else slice_col
    if materialize:
        from payscope.session import cut_lineage
        df = cut_lineage(df.withColumns({f"_val{i}": v for i, v in enumerate(vals.values())}))
        vals = {name: F.col(f"_val{i}") for i, name in enumerate(vals)}
    size = max(block_rows, n)
    xs = {f"_x{i}": v for i, v in enumerate(vals.values())}
    t = prefix_sums(df.withColumns(xs), keys, order, {}, slice_col)
    block = F.floor((F.col("_g") - 1) / size)
    # a block's last n rows are rows of the next block too, to be framed but not returned
    last = (F.col("_g") - 1) % size >= size - n
    own = F.struct(block.alias("b"), F.lit(True).alias("own"))
    t = t.withColumn("_at", F.explode(F.when(last, F.array(own, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
                                      .otherwise(F.array(own))))
    t = t.withColumns({"_b": F.col("_at.b"), "_own": F.col("_at.own")}).drop("_at")
    t = framed(t, [F.col(x) for x in xs], Window.partitionBy(*keys, "_b").orderBy("_g").rowsBetween(lo, hi))
    t = t.where("_own").drop(*xs, "_g", "_b", "_own")
    return t.drop(*[f"_val{i}" for i in range(len(vals))]) if materialize else t


def _framed_by_hour(df: DataFrame, keys: list[str], order: list[str], framed, lo: int, hi: int) -> DataFrame:
    """``framed(rows, window)`` over the frames ``lo`` to ``hi`` of a key, none of whose rows are gathered but those at the ends of
    an hour.  A frame that lies inside an hour is taken there.  The first ``-lo`` rows of an hour reach into the hours before;
    their frames hold only first and last rows of hours, so a window of the key over these is enough."""
    n = -lo
    t = df.withColumn("_slice", F.date_trunc("hour", F.col(order[0])))
    hour = Window.partitionBy(*keys, "_slice")
    t = t.withColumns({"_rn": F.row_number().over(hour.orderBy(*order)), "_size": F.count(F.lit(1)).over(hour)})
    drop = ["_slice", "_rn", "_size"]
    # the new columns of rows whose frame lies inside the hour; the others are framed below
    inside = framed(t, hour.orderBy("_rn").rowsBetween(lo, hi)).where(F.col("_rn") > n).drop(*drop)
    ends = t.where((F.col("_rn") <= n) | (F.col("_rn") > F.col("_size") - n))
    across = framed(ends, Window.partitionBy(*keys).orderBy("_slice", "_rn").rowsBetween(lo, hi))
    return inside.unionByName(across.where(F.col("_rn") <= n).drop(*drop))


def running_before(df: DataFrame, keys, order, value: str | Column, out: str,
                   slice_col: Column | None = None, method: str = "prefix") -> DataFrame:
    """Sum of the integer ``value`` over all EARLIER rows of the key (frame
    ends at -1); 0 for the first row, NULL for rows without key."""
    keys, order = _cols(keys), _cols(order)
    val = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("bigint"), F.lit(0).cast("bigint"))
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.when(~_no_key(keys), F.coalesce(F.sum(val).over(w), F.lit(0))).cast("bigint"))
    slice_col = default_slice(order[0]) if slice_col is None else slice_col
    t = prefix_sums(df.withColumn("_cur", val), keys, order, {"s": F.col("_cur")}, slice_col)
    return t.withColumn(out, F.when(~_no_key(keys), F.col("_P_s") - F.col("_cur")).cast("bigint")).drop("_P_s", "_g", "_cur")


def row_index(df: DataFrame, keys, order, out: str = "row_index", slice_col: Column | None = None) -> DataFrame:
    """1-based position of the row inside its key, skew-safe; rows with a
    NULL key are numbered among themselves."""
    keys, order = _cols(keys), _cols(order)
    slice_col = default_slice(order[0]) if slice_col is None else slice_col
    return prefix_sums(df, keys, order, {}, slice_col).withColumnRenamed("_g", out)


#: Sketch accuracy of the quantile selection: ranks are off by at most N / this; brackets reach eight times as far.
SKETCH_ACCURACY = 100_000


def exact_quantile_arrays(df: DataFrame, specs: dict, keys=()) -> DataFrame:
    """Exact quantiles (linear interpolation, as pandas / ``percentile``): one row per key (one row without keys) with, for each
    entry (column, ascending probabilities) of ``specs``, an array<double> of its name.  NULLs do not count; an entry without
    values is an array of NULLs.

    Two scans, both with partial aggregation and shared by all entries; no column is shuffled or merged in one task:

    1. fixed-size sketches give, per probability, a bracket of values around its quantile;
    2. rows are counted by value inside the brackets (about 16 / accuracy of the rows) and, outside of them, by the gap between
       two brackets (a few numbers).  In order of value these counts are ranks, and the two values around the wanted
       rank are interpolated.
    """
    keys = _cols(keys)
    entries = [(name, c, [float(p) for p in ps]) for name, (c, ps) in specs.items()]
    margin = 8.0 / SKETCH_ACCURACY
    t = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, (_, c, _) in enumerate(entries)])

    def bracket(i: int, ps: list[float]) -> Column:
        at = [max(p - margin, 0.0) for p in ps] + [min(p + margin, 1.0) for p in ps]
        return F.percentile_approx(f"_c{i}", at, SKETCH_ACCURACY).alias(f"e{i}")

    sketch = t.groupBy(*keys).agg(*[bracket(i, ps) for i, (_, _, ps) in enumerate(entries)])
    edges = F.struct(*[f"e{i}" for i in range(len(entries))])
    if keys:
        small = sketch.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], edges.alias("_s"))
        same = [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(keys)]
        t = t.join(small, same).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        t = t.withColumn("_s", sketch.select(edges).scalar())

    def placed(i: int, k: int) -> Column:
        """Entry, value, and how many brackets begin at or below it and end below it: it is inside one if these differ."""
        v, e = f"_c{i}", f"_s.e{i}"
        begun, ended = (" + ".join(f"int({v} {op} {e}[{j}])" for j in js) for op, js in ((">=", range(k)), (">", range(k, 2 * k))))
        return F.expr(f"struct({i} AS e, {v} AS v, {begun} AS b, {ended} AS d)")

    each = [placed(i, len(ps)) for i, (_, _, ps) in enumerate(entries)]
    t = t.select(*keys, (each[0] if len(each) == 1 else F.explode(F.array(*each))).alias("_q")).where("_q.v IS NOT NULL")
    t = t.select(*keys, F.col("_q.e").alias("_e"), F.col("_q.v").alias("_v"), F.expr("IF(_q.b > _q.d, _q.v, NULL)").alias("_at"),
                 F.expr("IF(_q.b > _q.d, NULL, _q.d)").alias("_gap"))
    t = t.groupBy(*keys, "_e", "_at", "_gap").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    one = Window.partitionBy(*keys, "_e")
    t = t.withColumn("_last", F.sum("_n").over(one.orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    t = t.withColumns({"_first": F.col("_last") - F.col("_n") + 1, "_N": F.sum("_n").over(one)})

    def value(rank: str) -> str:
        """The value of a rank: any rank inside a bracket, the first and the last one of a gap."""
        return (f"CASE WHEN NOT ({rank} BETWEEN _first AND _last) THEN NULL WHEN _at IS NOT NULL THEN _at WHEN {rank} = _first THEN _lo "
                f"WHEN {rank} = _last THEN _hi ELSE CAST(raise_error('a quantile lies outside its bracket') AS DOUBLE) END")

    aggs = []
    for i, (_, _, ps) in enumerate(entries):
        for j, p in enumerate(ps):
            pos = f"({p!r}D * (_N - 1))"
            aggs += [F.expr(f"max({x}) FILTER (WHERE _e = {i})").alias(f"{name}{i}_{j}")
                     for name, x in (("l", value(f"floor({pos})")), ("h", value(f"ceil({pos})")), ("f", f"{pos} - floor({pos})"))]
    found = t.groupBy(*keys).agg(*aggs)

    def between(i: int, j: int) -> Column:
        lo, hi, share = (F.col(f"{x}{i}_{j}") for x in "lhf")
        return F.when(lo == hi, lo).otherwise(lo + share * (hi - lo))  # equal ends need no interpolation (infinite values stay as they are)

    return found.select(*keys, *[F.array(*[between(i, j) for j in range(len(ps))]).alias(name) for i, (name, _, ps) in enumerate(entries)])


def exact_quantiles(df: DataFrame, c: str, probs, keys=()) -> DataFrame:
    """One row per (keys, p): keys..., p, value, from ``exact_quantile_arrays``."""
    keys, probs = _cols(keys), [float(p) for p in probs]
    q = exact_quantile_arrays(df, {"_a": (c, probs)}, keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.get("_a", F.lit(i)).alias("value")) for i, p in enumerate(probs)]))
    return q.select(*keys, pairs.alias("_p")).select(*keys, "_p.p", "_p.value")
