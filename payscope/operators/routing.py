"""Processor routing on logged data (RO*, WN5, WN7, AG23, HT4, JN8).

The reference routes one row at a time with mutable counters.  Here:
* per-processor scores are an ARRAY column computed from a small,
  data-derived processor->rate map (a scalar subquery), so no row x
  processor join is ever materialised;
* bandit state (trials / successes per processor) is frozen per time
  bucket (hour by default) and built on the (bucket x arm) grid, which is
  generated by exploding the bounded arm list, not by a join;
* every policy is a column of the same row, so comparing policies needs
  no join; the long form is an unpivot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions import expr as X
from payscope.operators import features as FE
from payscope.operators import windows as W
from payscope.session import cut_lineage
from payscope.sources import schemas as S

def arms_of(df: DataFrame, col: str = "processor_id") -> list[str]:
    """Distinct processors, sorted: the processor dimension of the logged
    rows, one aggregated value."""
    return df.agg(F.array_sort(F.collect_set(col)).alias("arms")).first()["arms"]


# -- inputs --------------------------------------------------------------------------

def routing_base(txn: DataFrame, method: str = "prefix") -> DataFrame:
    """Columns the scores need: merchant success rate, 50-row method
    success, latency bin code, the logged label."""
    t = txn.withColumn("result_numeric", X.is_success("result"))
    t = FE.qbins(t, {"network_latency": (S.LATENCY_QBIN_LABELS, "latency_bin")})
    t = t.withColumn("latency_bin_encoded", X.ordinal("latency_bin", S.LATENCY_QBIN_LABELS))
    t = FE.attach_group_stats(t, [("merchant", ["merchant_id"], {"merchant_success_rate": "mean"})])
    t = t.select("transaction_id", "txn_ts", "payment_method", "device_type", "processor_id", "result", "result_numeric",
                 "latency_bin_encoded", "merchant_success_rate")
    # materialise the binned + joined rows once: the prefix window reads them several times
    return FE.payment_method_rolling_success(t, method=method, materialize=(method == "prefix"))


# -- RO1 / RO2 / RO3 ----------------------------------------------------------------------

def processor_scores(df: DataFrame, arms: Sequence[str] | None = None, noise: bool = False, seed: int = 42,
                     out: str = "scores") -> DataFrame:
    """Per processor: rate + .05(m - .85) + .03(r - .85) - .04(lat / 4)
    [+ U(-.05, .05) from a hash when ``noise``], clipped to 0..1.
    NULL inputs are neutral (m, r -> .85, lat -> 0).  Result: array of
    struct(arm, score) in arm order."""
    arms = arms_of(df) if arms is None else list(arms)
    rates = (df.where(F.col("processor_id").isin(arms)).groupBy("processor_id")
             .agg(F.avg("result_numeric").alias("rate")))
    rate_map = rates.select(F.map_from_entries(F.collect_list(F.struct("processor_id", "rate")))).scalar()
    base = (0.05 * (F.coalesce("merchant_success_rate", F.lit(0.85)) - 0.85)
            + 0.03 * (F.coalesce("payment_method_rolling_success", F.lit(0.85)) - 0.85)
            - 0.04 * (F.coalesce(F.col("latency_bin_encoded").cast("double"), F.lit(0.0)) / 4.0))

    def one(a):
        a = F.lit(a)
        s = F.coalesce(F.col("_rates")[a], F.lit(0.0)) + F.col("_base")
        if noise:
            s = s + (X.hash_uniform("transaction_id", a, seed=seed) - 0.5) * 0.1
        return F.struct(a.alias("arm"), X.clip01(s).alias("score"))

    # written out per processor: functions with a lambda are not compiled
    scores = F.array(*map(one, arms)) if arms else F.array().cast("array<struct<arm:string,score:double>>")
    return df.withColumn("_base", base).withColumn("_rates", rate_map).withColumn(out, scores).drop("_base", "_rates")


def argmax_arm(scores: Column) -> Column:
    """Arm with the highest score; ties -> the first arm in arm order."""
    values = scores["score"]
    return F.get(scores, F.coalesce(F.array_position(values, F.array_max(values)), F.lit(1)).cast("int") - 1)["arm"]


def score_of(scores: Column, arm: Column) -> Column:
    """The score of ``arm``; NULL where it has none."""
    return F.get(scores, F.array_position(scores["arm"], arm).cast("int") - 1)["score"]


def best_processor(df: DataFrame, scores: str = "scores") -> DataFrame:
    """RO2/RO3: argmax policy and whether the logged processor was it."""
    b = argmax_arm(F.col(scores))
    return df.withColumn("best_processor", b) \
             .withColumn("optimal_processor_selected", (F.col("processor_id") == b).cast("int"))


def wide_scores(df: DataFrame, arms: Sequence[str], scores: str = "scores") -> DataFrame:
    """F8 wide form: one ``<arm>_predicted_success`` column per processor."""
    return df.withColumns({f"{a}_predicted_success": score_of(F.col(scores), F.lit(a)) for a in arms})


# -- WN7: bandit state per time bucket ----------------------------------------------------------

def running_arm_stats(df: DataFrame, arms: Sequence[str], bucket: str = "hour", ts: str = "txn_ts",
                      arm_col: str = "processor_id", reward: str = "result_numeric") -> DataFrame:
    """Trials and successes per arm logged BEFORE each bucket.

    (bucket, arm) counts are aggregated first; the full grid comes from
    exploding the arm list into each bucket row; the running sum is a
    window per arm over buckets (one row per bucket - the aggregated
    table, never raw rows)."""
    b = F.date_trunc(bucket, ts).alias("bucket")
    counts = (df.where(F.col(arm_col).isin(list(arms))).groupBy(b, F.col(arm_col).alias("arm"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(reward).alias("s")))
    buckets = df.select(b).distinct()
    grid = buckets.select("bucket", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    g = grid.join(counts, ["bucket", "arm"], "left").fillna(0, ["n", "s"])
    w = Window.partitionBy("arm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("bucket", "arm", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint").alias("trials"),
                    F.coalesce(F.sum("s").over(w), F.lit(0)).cast("bigint").alias("successes"))


def bucket_state(stats: DataFrame, arms: Sequence[str]) -> DataFrame:
    """One row per bucket: array of struct(arm, trials, successes) in arm
    order (bounded by the arm count)."""
    order = F.create_map(*[x for i, a in enumerate(arms) for x in (F.lit(a), F.lit(i))])
    g = stats.groupBy("bucket").agg(F.sort_array(F.collect_list(
        F.struct(order[F.col("arm")].alias("i"), "arm", "trials", "successes"))).alias("state"))
    return g


def _pick_random(arms: Sequence[str], u: Column) -> Column:
    arr = F.array(*[F.lit(a) for a in arms])
    return F.element_at(arr, (F.floor(u * len(arms)) + 1).cast("int"))


def _rates(bonus: Callable[[Column], Column] | None = None, untried: float = 0.0) -> Column:
    """The arm of the largest empirical rate (plus ``bonus`` of an entry) in the ``state`` column; ties -> arm order."""
    def value(e, i):
        v = e["successes"] / e["trials"]
        v = v if bonus is None else v + bonus(e)
        return F.struct(F.when(e["trials"] > 0, v).otherwise(F.lit(untried)).alias("v"), (-i).alias("r"), e["arm"].alias("a"))
    return F.array_max(F.transform("state", value))["a"]


def _with_choices(state: DataFrame, c: float) -> DataFrame:
    """``state`` with what RO5 and RO6 choose by it: a choice follows from the bucket, so it is made once a bucket, not once a row."""
    t = state.withColumn("_total", F.aggregate("state", F.lit(0).cast("bigint"), lambda acc, e: acc + e["trials"]))
    bonus = lambda e: c * F.sqrt(F.log("_total") / e["trials"])
    choices = F.struct(F.col("_total").alias("total"), _rates().alias("greedy"), _rates(bonus, float("inf")).alias("ucb"))
    return t.withColumn("_choices", choices).drop("_total")


def _epsilon_greedy(arms: Sequence[str], epsilon: float, seed: int) -> Column:
    explore = X.hash_uniform("transaction_id", F.lit("explore"), seed=seed) < epsilon
    return F.when(explore, _pick_random(arms, X.hash_uniform("transaction_id", F.lit("pick"), seed=seed))).otherwise(F.col("_choices.greedy"))


def _ucb(arms: Sequence[str], seed: int) -> Column:
    pick = _pick_random(arms, X.hash_uniform("transaction_id", F.lit("pick"), seed=seed))
    return F.when(F.col("_choices.total") == 0, pick).otherwise(F.col("_choices.ucb"))


def with_state(df: DataFrame, state: DataFrame, bucket: str = "hour", c: float = 1.0) -> DataFrame:
    """``df`` with the ``state`` of its bucket and the bandits' choices by it (a row per bucket: AQE broadcasts it by measured size)."""
    if "state" in df.columns:
        return df if "_choices" in df.columns else _with_choices(df, c)
    return df.withColumn("bucket", F.date_trunc(bucket, "txn_ts")).join(_with_choices(state, c), "bucket", "left").drop("bucket")


def epsilon_greedy(df: DataFrame, state: DataFrame, arms: Sequence[str], epsilon: float = 0.1, seed: int = 42,
                   bucket: str = "hour", out: str = "route_epsilon_greedy") -> DataFrame:
    """RO5: explore with probability epsilon (hash-uniform), else the arm
    with the best empirical rate (0 when untried; ties -> arm order)."""
    return with_state(df, state, bucket).withColumn(out, _epsilon_greedy(arms, epsilon, seed)).drop("state", "_choices")


def ucb(df: DataFrame, state: DataFrame, arms: Sequence[str], c: float = 1.0, seed: int = 42,
        bucket: str = "hour", out: str = "route_ucb") -> DataFrame:
    """RO6: rate + c * sqrt(ln N / n); an untried arm is +inf; with no
    trials at all, a hash-random arm."""
    return with_state(df, state, bucket, c).withColumn(out, _ucb(arms, seed)).drop("state", "_choices")


def bandit_decisions(df: DataFrame, state: DataFrame, arms: Sequence[str], epsilon: float = 0.1, c: float = 1.0,
                     seed: int = 42, bucket: str = "hour") -> DataFrame:
    """RO5 and RO6 from ONE join with the bucket-state table."""
    t = with_state(df, state, bucket, c)
    return t.withColumns({"route_epsilon_greedy": _epsilon_greedy(arms, epsilon, seed), "route_ucb": _ucb(arms, seed)}).drop("state", "_choices")


@F.pandas_udf(T.DoubleType())
def _beta_draw(seed: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(seed))
    for i, (s, x, y) in enumerate(zip(seed, a, b)):
        out[i] = np.random.default_rng(int(s)).beta(float(x), float(y))
    return pd.Series(out)


def thompson_samples(stats: DataFrame, seed: int = 42) -> DataFrame:
    """RO7: one Beta(s + 1, n - s + 1) draw per (bucket, arm), seeded by a
    hash of (bucket, arm, seed) - replayable, and computed on the small
    state table (buckets x arms), not per row.  Also the posterior mean and
    variance, which SQL can check."""
    a = F.col("successes") + 1
    b = F.col("trials") - F.col("successes") + 1
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("bucket").cast("string"), "arm", F.lit(str(seed)))), 1, 12),
               16, 10).cast("bigint")
    return stats.select("bucket", "arm", "trials", "successes",
                        X.rnd(a / (a + b)).alias("posterior_mean"),
                        X.rnd(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("posterior_var"),
                        _beta_draw(h, a.cast("double"), b.cast("double")).alias("sample"))


def thompson(df: DataFrame, samples: DataFrame, arms: Sequence[str], bucket: str = "hour",
             out: str = "route_thompson") -> DataFrame:
    order = F.create_map(*[x for i, a in enumerate(arms) for x in (F.lit(a), F.lit(i))])
    pick = samples.groupBy("bucket").agg(F.max_by("arm", F.struct("sample", -order[F.col("arm")])).alias(out))
    return df.withColumn("bucket", F.date_trunc(bucket, "txn_ts")).join(pick, "bucket", "left").drop("bucket")


# -- RO4 capacity-capped routing ------------------------------------------------------------------------

#: Parts of a unit of score in which a round's rows are counted first.
CAP_CELLS = 1 << 16


def _id_slice(ids: DataFrame, col: str) -> Column:
    """Non-decreasing in the id: 65,536 numbers, or all but the last four characters of the shortest id."""
    if ids.schema[col].dataType.typeName() in ("long", "integer", "short", "byte"):
        return F.floor(F.col(col) / 65536)
    return F.substring(F.col(col).cast("string"), 1, max(int(ids.agg(F.min(F.length(col))).first()[0] or 0) - 4, 0))


def route_capped(df: DataFrame, arms: Sequence[str], ratio: float = 0.3, bucket: str = "hour", scores: str = "scores",
                 out: str = "route_capped", checkpoint: bool = True, id_col: str = "transaction_id") -> DataFrame:
    """RO4 per time bucket: each processor takes at most floor(ratio * n) rows of the bucket, best-scored rows first
    (ties: smaller id); rows over the cap try their next choice, for at most as many rounds as there are processors; rows
    left over go to their best processor (the reference's 'all overloaded').

    The rows are written once and not moved again.  A round counts its open rows by (bucket, processor, score cell), then by
    score inside the cell where the capacity ends, then numbers the ids of equal scores there: this gives the last key
    (score, id) that the processor accepts in that round.  These keys, a row per bucket and processor, are written after
    each round; a row's decision follows from them alone.  Rounds end as soon as no processor had to refuse a row."""
    prefs = F.sort_array(F.transform(F.col(scores), lambda e, i: F.struct((-e["score"]).alias("ns"), i.alias("i"), e["arm"].alias("a"))))
    base = df.withColumns({"_bucket": F.date_trunc(bucket, "txn_ts"), "_prefs": prefs})
    base = cut_lineage(base) if checkpoint else base
    narrow = base.select("_bucket", "_prefs", F.col(id_col).alias("_id"))
    last = F.lit(None).cast(f"array<struct<ns:double,id:{base.schema[id_col].dataType.simpleString()}>>")
    # one row per bucket and processor: capacity left, last accepted key of each round
    state = (narrow.groupBy("_bucket").agg(F.floor(F.count(F.lit(1)) * ratio).alias("left"))
             .select("_bucket", F.explode(F.array(*map(F.lit, arms))).alias("arm"), "left", F.coalesce(last, F.array()).alias("last"), F.lit(False).alias("over")))
    state = cut_lineage(state)
    for r in range(len(arms)):
        choice = F.get("_prefs", F.lit(r))
        asked = (_with_limits(narrow, state).where(_accepted_in(r) == 0)
                 .select("_bucket", choice["a"].alias("arm"), choice["ns"].alias("ns"), "_id", F.floor(choice["ns"] * CAP_CELLS).alias("cell"))
                 .where(F.col("arm").isNotNull()))
        state = cut_lineage(_after_round(state, asked, narrow))
        if state.where("over").isEmpty():
            break
    rows = _with_limits(base.withColumn("_id", F.col(id_col)), state).withColumn("_at", _accepted_in(len(arms)))
    chosen = F.get("_prefs", F.greatest(F.col("_at") - 1, F.lit(0)))["a"]
    return rows.withColumn(out, chosen).drop("_bucket", "_prefs", "_id", "_limits", "_at")


def _with_limits(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with ``_limits``: processor -> last accepted key of each round (one row per bucket: broadcast by its measured size)."""
    limits = state.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("arm", "last"))).alias("_limits"))
    limits = limits.withColumnRenamed("_bucket", "_b")
    return rows.join(limits, F.col("_bucket").eqNullSafe(F.col("_b"))).drop("_b")


def _accepted_in(rounds: int) -> Column:
    """The first of ``rounds`` rounds that accepted the row, 0 if none did."""

    def accepted(j):
        p = F.get("_prefs", F.lit(j))
        key = F.get(F.element_at("_limits", p["a"]), F.lit(j))
        return F.coalesce((p["ns"] < key["ns"]) | ((p["ns"] == key["ns"]) & (key["id"].isNull() | (F.col("_id") <= key["id"]))), F.lit(False))

    out = F.lit(0)
    for j in reversed(range(rounds)):
        out = F.when(accepted(j), j + 1).otherwise(out)
    return out


def _after_round(state: DataFrame, asked: DataFrame, ids: DataFrame) -> DataFrame:
    """``state`` after the rows ``asked`` (_bucket, arm, ns, _id, cell) asked their processors."""
    keys = ["_bucket", "arm"]
    same = lambda a, b: a["_bucket"].eqNullSafe(b["_bucket"]) & (a["arm"] == b["arm"])

    def last_part(parts: DataFrame, room: DataFrame, part: str) -> DataFrame:
        """Where the ``room`` of each (bucket, processor) ends along ``part``: that part, the room inside it, its rows; all rows."""
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
        t = parts.withColumn("upto", upto).join(room.select(*[F.col(k).alias(f"_{k}") for k in keys], "room"),
                                                F.col("_bucket").eqNullSafe(F.col("__bucket")) & (F.col("arm") == F.col("_arm")))
        here = (F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("n") < F.col("room"))
        return t.groupBy(*keys).agg(F.sum("n").alias("asked"), F.max(F.when(here, F.struct(F.col(part).alias("part"), (
            F.col("room") - F.col("upto") + F.col("n")).alias("room"), "n"))).alias("end"))

    room = state.select(*keys, F.col("left").alias("room"))
    by_cell = cut_lineage(last_part(asked.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")), room, "cell"))
    full = by_cell.join(state.select(F.col("_bucket").alias("_b"), F.col("arm").alias("_a"), "left"), F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("arm") == F.col("_a")))
    full = full.where((F.col("asked") > F.col("left")) & (F.col("left") > 0)).select(*keys, F.col("end.part").alias("cell"), F.col("end.room").alias("room"))
    inside = asked.join(full, same(asked, full) & (asked["cell"] == full["cell"]), "left_semi")
    by_score = last_part(inside.groupBy(*keys, "ns").agg(F.count(F.lit(1)).alias("n")), full, "ns").select(*keys, "end.*")
    by_score = cut_lineage(by_score.withColumnRenamed("part", "ns"))
    cut = by_score.where("room < n")
    equal = asked.join(cut, same(asked, cut) & (asked["ns"] == cut["ns"])).select(asked["_bucket"], asked["arm"], "_id", "room")
    ranked = W.row_index(equal, keys, ["_id"], "_rk", slice_col=_id_slice(ids, "_id").alias("s"))
    ends = by_score.select(F.col("_bucket").alias("_b"), F.col("arm").alias("_a"), "ns").join(
        ranked.where("_rk = room").select(F.col("_bucket").alias("_b2"), F.col("arm").alias("_a2"), F.col("_id").alias("id")),
        F.col("_b").eqNullSafe(F.col("_b2")) & (F.col("_a") == F.col("_a2")), "left").select("_b", "_a", "ns", "id")
    t = (state.join(by_cell.select(F.col("_bucket").alias("_b1"), F.col("arm").alias("_a1"), "asked"),
                    F.col("_bucket").eqNullSafe(F.col("_b1")) & (F.col("arm") == F.col("_a1")), "left")
         .join(ends, F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("arm") == F.col("_a")), "left"))
    n = F.coalesce("asked", F.lit(0))
    everyone = F.struct(F.lit(float("inf")).alias("ns"), F.lit(None).cast(ids.schema["_id"].dataType).alias("id"))
    key = F.when(n <= F.col("left"), everyone).when(F.col("left") > 0, F.struct("ns", "id"))
    return t.select(*keys, F.greatest(F.col("left") - n, F.lit(0)).alias("left"), F.concat("last", F.array(key)).alias("last"), (n > F.col("left")).alias("over"))


# -- policy evaluation (RO8-RO13, WN5, AG23, HT4, JN8) ----------------------------------------------------

POLICIES = ["route_simple", "route_capped", "route_epsilon_greedy", "route_ucb", "route_thompson",
            "route_static", "processor_id"]


@dataclass(frozen=True)
class Logged:
    """What a policy may know besides the row: the processors, and the counters logged before each time bucket."""

    arms: Sequence[str]
    stats: DataFrame  # bucket, arm, trials, successes
    state: DataFrame  # bucket, array of (arm, trials, successes)
    bucket: str = "hour"
    epsilon: float = 0.1
    c: float = 1.0
    ratio: float = 0.3
    seed: int = 42


#: Policies by name (UD3): ``policy(df, logged) -> df`` with the new column ``route_<name>``.  ``df`` has the columns of
#: ``processor_scores``, the row's ``state`` and what earlier policies added; rows must stay as they are.
REGISTRY: dict[str, Callable[[DataFrame, Logged], DataFrame]] = {}


def policy(name: str):
    """Register a policy under ``name``; ``route_all`` and the evaluation take it by that name."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"policy {name} exists")
        REGISTRY[name] = fn
        return fn
    return deco


policy("simple")(lambda df, lg: df.withColumn("route_simple", argmax_arm(F.col("scores"))))
policy("static")(lambda df, lg: static_baseline(df))
policy("epsilon_greedy")(lambda df, lg: df.withColumn("route_epsilon_greedy", _epsilon_greedy(lg.arms, lg.epsilon, lg.seed)))
policy("ucb")(lambda df, lg: df.withColumn("route_ucb", _ucb(lg.arms, lg.seed)))
policy("thompson")(lambda df, lg: thompson(df, thompson_samples(lg.stats, lg.seed), lg.arms, lg.bucket))
policy("capped")(lambda df, lg: route_capped(df, lg.arms, lg.ratio, lg.bucket))


def apply_policies(df: DataFrame, logged: Logged, names: Sequence[str]) -> DataFrame:
    """``df`` with a column ``route_<name>`` for each policy."""
    t = with_state(df, logged.state, logged.bucket, logged.c)
    for n in names:
        t = REGISTRY[n](t, logged)
        if f"route_{n}" not in t.columns:
            raise ValueError(f"policy {n} adds no column route_{n}")
    return t.drop("state", "_choices")


def static_baseline(df: DataFrame, scores: str = "scores") -> DataFrame:
    """RO8: always the processor with the best historical success rate."""
    best = (df.groupBy("processor_id").agg(F.avg("result_numeric").alias("r"))
            .select(F.min_by("processor_id", F.struct(-F.col("r"), F.col("processor_id")))).scalar())
    return df.withColumn("route_static", best)


def decisions_long(df: DataFrame, policies: Sequence[str], scores: str = "scores") -> DataFrame:
    """Unpivot policy columns to (transaction_id, strategy, routed_processor,
    expected_success): a stack, not a join."""
    keep = ["transaction_id", "txn_ts", "payment_method", "device_type", "processor_id", "result_numeric", scores]
    st = ", ".join(f"'{p.replace('route_', '') if p != 'processor_id' else 'actual'}', `{p}`" for p in policies)
    long = df.select(*keep, *[F.col(p).alias(p) for p in policies if p not in keep]) \
             .selectExpr(*keep, f"stack({len(policies)}, {st}) AS (strategy, routed_processor)")
    return long.withColumn("expected_success", score_of(F.col(scores), F.col("routed_processor"))).drop(scores)


def load_distribution(long: DataFrame) -> DataFrame:
    """RO9: share of decisions per processor, per strategy."""
    g = long.groupBy("strategy", "routed_processor").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", X.rnd(F.col("n") / F.sum("n").over(Window.partitionBy("strategy"))))


def policy_eval(long: DataFrame) -> DataFrame:
    """RO10: per strategy and routed processor: count and mean expected success."""
    return long.groupBy("strategy", "routed_processor").agg(
        F.count(F.lit(1)).alias("n"), X.rnd(F.avg("expected_success")).alias("expected_success"))


def expected_success(long: DataFrame, baseline: str = "static") -> DataFrame:
    """RO11 + HT4: mean predicted success per strategy, % vs baseline, best."""
    from payscope.operators.stats import improvement_over_baseline
    g = long.groupBy("strategy").agg(X.rnd(F.avg("expected_success")).alias("success_rate"))
    return improvement_over_baseline(g, baseline)


def actual_vs_routed(long: DataFrame, strategy: str = "simple") -> DataFrame:
    """RO12: logged success mean vs routed expected mean and the change %."""
    t = long.where(F.col("strategy") == strategy)
    return t.agg(X.rnd(F.avg("result_numeric")).alias("actual_rate"),
                 X.rnd(F.avg("expected_success")).alias("routed_rate")).withColumn(
        "improvement_pct", X.rnd(F.try_divide(F.col("routed_rate") - F.col("actual_rate"), F.col("actual_rate")) * 100.0, 4))


def ips_value(long: DataFrame) -> DataFrame:
    """RO13: inverse-propensity value of each policy on logged outcomes.
    Logging propensity of processor p for method m = share of m's rows sent
    to p (an aggregate joined back by (m, p): a table of #methods x #arms)."""
    logged = long.where(F.col("strategy") == "actual")
    prop = logged.groupBy("payment_method", "processor_id").agg(F.count(F.lit(1)).alias("_c"))
    prop = prop.withColumn("propensity", F.col("_c") / F.sum("_c").over(Window.partitionBy("payment_method")))
    t = long.join(prop.select("payment_method", "processor_id", "propensity"), ["payment_method", "processor_id"], "left")
    w = F.when(F.col("routed_processor") == F.col("processor_id"), 1.0 / F.col("propensity")).otherwise(0.0)
    return t.groupBy("strategy").agg(X.rnd(F.avg(w * F.col("result_numeric"))).alias("ips_value"),
                                     X.rnd(F.sum(F.when(F.col("routed_processor") == F.col("processor_id"), 1)
                                                 .otherwise(0)) / F.count(F.lit(1))).alias("match_rate"))


def ips_value_of(df: DataFrame, policies: Sequence[str]) -> DataFrame:
    """RO13 from the policy columns: one aggregation of the rows by (method,
    logged processor, decisions), then ``ips_value`` on that small table -
    no row is stacked once per policy."""
    g = df.groupBy("payment_method", "processor_id", *[p for p in policies if p != "processor_id"]).agg(
        F.count(F.lit(1)).alias("n"), F.count("result_numeric").alias("k"), F.sum("result_numeric").alias("s"))
    st = ", ".join(f"'{p.replace('route_', '') if p != 'processor_id' else 'actual'}', `{p}`" for p in policies)
    c = df.groupBy("payment_method", "processor_id").agg(F.count(F.lit(1)).alias("_c"))
    c = c.select("payment_method", "processor_id", (F.col("_c") / F.sum("_c").over(Window.partitionBy("payment_method"))).alias("propensity"))
    t = g.join(c, ["payment_method", "processor_id"], "left").selectExpr("processor_id", "n", "k", "s", "propensity", f"stack({len(policies)}, {st}) AS (strategy, routed_processor)")
    hit = F.col("routed_processor") == F.col("processor_id")
    return t.groupBy("strategy").agg(
        X.rnd(F.sum(F.when(hit, F.col("s") / F.col("propensity")).when(F.col("k") > 0, 0.0)) / F.sum("k")).alias("ips_value"),
        X.rnd(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("match_rate"))


def rate_by_segment(long: DataFrame, segment: str, strategy: str = "simple") -> DataFrame:
    """AG23: actual vs routed rate and lift by a base column (method/device)."""
    t = long.where((F.col("strategy") == strategy) & F.col(segment).isNotNull())
    g = t.groupBy(segment).agg(X.rnd(F.avg("result_numeric")).alias("actual_rate"),
                               X.rnd(F.avg("expected_success")).alias("routed_rate"))
    return g.withColumn("improvement_pct",
                        X.rnd(F.try_divide(F.col("routed_rate") - F.col("actual_rate"), F.col("actual_rate")) * 100.0, 4))


def moving_success(long: DataFrame, window: int = 500, method: str = "prefix") -> DataFrame:
    """WN5: 500-row moving mean of expected success per strategy in
    decision order; the first window-1 rows are dropped (count < window).
    Few strategies -> the skew-safe prefix form."""
    r = W.rolling_rows(long, ["strategy"], ["txn_ts", "transaction_id"], "expected_success", window, window,
                       "moving_success", method=method)
    return r.where(F.col("moving_success").isNotNull())


def moving_success_of(df: DataFrame, policies: Sequence[str], window: int = 500, scores: str = "scores") -> DataFrame:
    """WN5 from the policy columns: (transaction_id, strategy, moving_success).  All strategies follow one decision order, so the
    rows are numbered and framed once, a value per policy, and stacked last."""
    names = [p.replace("route_", "") if p != "processor_id" else "actual" for p in policies]
    t = df.select("transaction_id", "txn_ts", *[score_of(F.col(scores), F.col(p)).alias(f"_s{i}") for i, p in enumerate(policies)])
    t = W.rolling_rows(t, [], ["txn_ts", "transaction_id"], {f"_m{i}": F.col(f"_s{i}") for i in range(len(names))}, window, window)
    st = ", ".join(f"'{n}', _m{i}" for i, n in enumerate(names))
    return t.selectExpr("transaction_id", f"stack({len(names)}, {st}) AS (strategy, moving_success)").where("moving_success IS NOT NULL")


def state_vector(df: DataFrame) -> DataFrame:
    """RO14: the 8-feature observation of a routing policy."""
    return df.withColumn("state", F.array(
        F.col("network_latency_scaled").cast("double"), F.col("merchant_success_rate_scaled").cast("double"),
        F.col("device_success_rate_scaled").cast("double"),
        F.col("payment_method_rolling_success_scaled").cast("double"),
        F.col("location_success_rate_scaled").cast("double"),
        F.col("payment_location_success_rate_scaled").cast("double"),
        (F.col("amount_bin_encoded") / 4.0).cast("double"), F.col("is_peak_hour").cast("double")))


# -- RO18 / RO19: the generator's risk and volume rules against logged data --------------------------

def risk_rate(df: DataFrame, pm_dim: DataFrame, cal: DataFrame) -> DataFrame:
    """Expected failure = base(method) x hour factor x day factor x event
    factor, averaged per method and compared with the observed rate."""
    hour = F.hour("txn_ts")
    hf = None
    for lo, hi, f in S.HOUR_FACTORS:
        cond = (hour >= lo) & (hour < hi)
        hf = F.when(cond, f) if hf is None else hf.when(cond, f)
    df_ = F.when(X.weekday("txn_ts") < 5, S.WEEKDAY_FACTOR).otherwise(S.WEEKEND_FACTOR)
    t = FE.event_factor(df.join(F.broadcast(pm_dim.select("payment_method", "base_failure_rate")), "payment_method"),
                        cal)
    t = t.withColumn("expected_failure", F.col("base_failure_rate") * hf * df_ * F.col("event_factor"))
    return t.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n"),
                                           X.rnd(F.avg("expected_failure")).alias("expected_failure_rate"),
                                           X.rnd(F.avg(X.is_failure("result"))).alias("observed_failure_rate"))


def volume_expectation(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Expected rows per day: base = rows / days, x the largest regional
    volume factor of the day, truncated, x1.2 weekday / x0.8 weekend,
    truncated again; next to the observed daily count."""
    daily = df.groupBy(F.to_date("txn_ts").alias("date")).agg(F.count(F.lit(1)).alias("observed"))
    one = df.sparkSession.range(1).withColumn(
        "_b", daily.select(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"), F.sum("observed").alias("n"))).scalar())
    b = F.col("_b")
    days = F.datediff(b["hi"], b["lo"]) + 1
    spine = one.select(F.explode(F.sequence(b["lo"], b["hi"], F.expr("INTERVAL 1 DAY"))).alias("date"), "_b")
    vf = (FE.calendar_days(cal).where(F.col("kind") == "regional").groupBy("date")
          .agg(F.max("volume_factor").alias("vf")))
    t = spine.join(F.broadcast(vf), "date", "left")
    per_day = b["n"] / days
    first = F.floor(per_day * F.greatest(F.coalesce("vf", F.lit(1.0)), F.lit(1.0)))
    wk = F.when(X.weekday("date") < 5, S.WEEKDAY_VOLUME).otherwise(S.WEEKEND_VOLUME)
    t = t.withColumn("expected", F.floor(first * wk).cast("bigint"))
    return t.join(daily, "date", "left").select("date", "expected",
                                                F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"))


# -- the whole evaluation -----------------------------------------------------------------------------------

def route_all(txn: DataFrame, bucket: str = "hour", epsilon: float = 0.1, c: float = 1.0, ratio: float = 0.3,
              seed: int = 42, checkpoint: bool = True,
              policies: Sequence[str] = ("simple", "static", "epsilon_greedy", "ucb", "thompson", "capped")) -> tuple[DataFrame, list[str]]:
    """Scores + every registered policy named in ``policies`` as a column.  Returns (frame, arms)."""
    arms = arms_of(txn)
    t = best_processor(processor_scores(routing_base(txn), arms, seed=seed))
    if checkpoint:
        t = cut_lineage(t)
    stats = running_arm_stats(t, arms, bucket)
    stats = cut_lineage(stats) if checkpoint else stats  # a row per bucket and processor, read by three policies
    logged = Logged(arms, stats, bucket_state(stats, arms), bucket, epsilon, c, ratio, seed)
    t = apply_policies(t, logged, policies)
    return (cut_lineage(t) if checkpoint else t), arms
