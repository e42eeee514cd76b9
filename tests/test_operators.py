"""Hand-made edge frames: traps T1-T20 and the pandas <-> Spark semantics
of SURVEY section 1, checked against literal values or pandas itself."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.functions import pvalues as P
from payscope.operators import clean as C
from payscope.operators import features as FE
from payscope.operators import ml as ML
from payscope.operators import monitor as MN
from payscope.operators import reports as R
from payscope.operators import stats as ST
from payscope.operators import windows as W


def _txn(spark, rows):
    return spark.createDataFrame(rows, "transaction_id long, txn_ts timestamp_ntz, merchant_id string, customer_id string, "
                                       "payment_method string, payment_amount double, network_latency double, result string")


def ts(h=0, d=1, m=0):
    return dt.datetime(2024, 1, d, h, m)


def test_label_rule_t1(spark):
    df = spark.createDataFrame([("success",), ("failure",), ("failed",), ("pending",), (" Success ",), (None,)], "result string")
    got = [tuple(r) for r in df.select(X.is_success("result"), X.is_failure("result")).collect()]
    assert got == [(1, 0), (0, 1), (0, 1), (None, None), (1, 0), (None, None)]


def test_urban_share_is_case_insensitive_t2(spark):
    t = _txn(spark, [(1, ts(), "M1", "C1", "credit_card", 10.0, 30.0, "success")]).withColumn("processor_id", F.lit("P1")) \
        .withColumn("customer_location", F.lit(" Urban"))
    assert R.processor_scorecard(t).first()["urban_pct"] == 100.0


def test_null_group_key_dropped(spark):
    t = _txn(spark, [(1, ts(), "M1", "C", None, 1.0, 1.0, "failure"), (2, ts(), "M1", "C", "USSD", 1.0, 1.0, "success")])
    out = R.failure_rate_by(t, ["payment_method"]).collect()
    assert [(r.payment_method, r.total_transactions) for r in out] == [("USSD", 1)]


def test_time_parts_and_edges(spark):
    rows = [(i, dt.datetime(2024, 1, 7, h), "M", "C", "x", 1.0, 1.0, "success") for i, h in enumerate([5, 6, 11, 12, 17, 18, 23])]
    rows.append((99, dt.datetime(2021, 1, 3, 10), "M", "C", "x", 1.0, 1.0, "success"))
    t = FE.add_time_parts(_txn(spark, rows)).orderBy("transaction_id").collect()
    assert [r.time_of_day for r in t[:7]] == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]
    assert t[0].day_of_week == 6 and t[0].day_name == "Sunday" and t[0].is_weekend == 1
    assert t[7].week == 53  # ISO week of 2021-01-03
    assert t[1].hhmm == "06:00" and t[0].ts_text == "2024-01-07 05:00:00"


def test_fixed_bins_t17_t18(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 50.0, 50.01, 100.0, 450.0, 900.0, 900.01, -1.0]], "payment_amount double")
    got = [r[0] for r in df.select(X.amount_bin_fixed()).collect()]
    assert got == ["$0-50", "$0-50", "$50-100", "$50-100", "$400-500", "$500-900", None, None]
    got = [r[0] for r in df.select(X.amount_bin_open()).collect()]
    assert got == [None, "<$50", "$50-100", "$50-100", "$200-500", "$500-1000", "$500-1000", None]


def test_qbin_matches_pandas_qcut(spark):
    vals = [float(x) for x in np.random.default_rng(1).lognormal(3.5, 1.0, 200).round(2)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, payment_amount double")
    got = [r.b for r in FE.qbin(df, "payment_amount", ["very_low", "low", "medium", "high", "very_high"], "b")
           .orderBy("id").collect()]
    exp = pd.qcut(pd.Series(vals), 5, labels=["very_low", "low", "medium", "high", "very_high"]).astype(str).tolist()
    assert got == exp


def test_qbin_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)], "x double")
    with pytest.raises(Exception, match="unique"):
        FE.qbin(df, "x", ["a", "b", "c", "d"], "b").collect()


def test_minmax_constant_is_zero_and_standardize_ddof0(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, c double")
    r = FE.standardize(FE.minmax(df, ["a", "c"]), ["a"]).collect()
    assert [x.c_minmax for x in r] == [0.0, 0.0, 0.0]
    sd = np.std([1, 2, 4])  # ddof 0
    assert abs(r[0].a_scaled - (1 - 7 / 3) / sd) < 1e-12


def test_cap_outliers_reference_vs_winsor_t6(spark):
    vals = [1.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")
    s = pd.Series(vals)
    q1, q3 = s.quantile(.25), s.quantile(.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    cap = s.quantile(.99)
    ref = [r.x for r in C.cap_outliers(df, "x").orderBy("id").collect()]
    assert ref == pytest.approx([cap if (v < lo or v > hi) else v for v in vals])  # low outlier also -> p99
    win = [r.x for r in C.cap_outliers(df, "x", mode="winsor").orderBy("id").collect()]
    assert win == pytest.approx([min(max(v, lo), hi) for v in vals])


def test_rolling_matches_pandas_and_prefix_equals_window(spark):
    rng = np.random.default_rng(3)
    n = 400
    keys = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))  # one key holds most rows
    ts_ = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in np.sort(rng.integers(0, 5000, n))]
    y = rng.integers(0, 2, n).astype(float)
    y[::17] = np.nan
    pdf = pd.DataFrame({"id": range(n), "k": keys, "ts": ts_, "y": y})
    df = spark.createDataFrame([(int(a), b, c.to_pydatetime(), None if math.isnan(d) else float(d)) for a, b, c, d in pdf.itertuples(index=False)],
                               "id long, k string, ts timestamp_ntz, y double")
    pre = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 50, 5, "r").orderBy("id").toPandas()["r"]
    win = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 50, 5, "r", method="window").orderBy("id").toPandas()["r"]
    exp = pdf.sort_values(["ts", "id"]).groupby("k")["y"].transform(lambda s: s.rolling(50, min_periods=5).mean()).sort_index()
    np.testing.assert_allclose(pre.to_numpy(dtype=float), exp.to_numpy(dtype=float), rtol=0, atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(win.to_numpy(dtype=float), exp.to_numpy(dtype=float), rtol=0, atol=1e-12, equal_nan=True)


def test_previous_failures_t11(spark):
    rows = [(1, ts(1), "M", "C1", "x", 1.0, 1.0, "failure"), (2, ts(2), "M", "C1", "x", 1.0, 1.0, "success"),
            (3, ts(3), "M", "C1", "x", 1.0, 1.0, "failure"), (4, ts(4), "M", "C1", "x", 1.0, 1.0, "success"),
            (5, ts(1), "M", "C2", "x", 1.0, 1.0, "success")]
    got = [r.previous_failures for r in FE.previous_failures(_txn(spark, rows)).orderBy("transaction_id").collect()]
    assert got == [0, 1, 1, 2, 0]


def test_calibration_table_matches_pandas_cut(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0.0113, 0.97, 500).round(4)
    y = rng.random(500) < p
    fb = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "prediction_probability double, actual_success boolean")
    got = MN.calibration_table(fb).orderBy("bucket").toPandas()
    pdf = pd.DataFrame({"p": p, "y": y})
    pdf["b"] = pd.cut(pdf["p"], bins=10)
    g = pdf.groupby("b", observed=True)["y"].agg(["mean", "count"]).reset_index()
    g["mid"] = g["b"].apply(lambda iv: (iv.left + iv.right) / 2)
    assert got["n"].tolist() == g["count"].tolist()
    np.testing.assert_allclose(got["midpoint"], g["mid"].astype(float), atol=1e-9)
    np.testing.assert_allclose(got["observed"], g["mean"], atol=1e-6)
    err = MN.calibration_error(MN.calibration_table(fb)).first()["calibration_error"]
    assert err == pytest.approx(float((abs(g["mid"].astype(float) - g["mean"]) * g["count"]).sum() / g["count"].sum()), abs=1e-6)


def test_drift_flag_needs_100_rows(spark):
    fb = spark.createDataFrame([(0.9, False)] * 50, "prediction_probability double, actual_success boolean")
    assert MN.drift_flag(MN.calibration_error(MN.calibration_table(fb))).first()["drift_detected"] is None


def test_pvalues_against_tables():
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert P.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert P.t_sf_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert P.t_sf_two_sided(0.0, 5) == pytest.approx(1.0)


def test_chi2_yates_2x2_and_plain_5x2(spark):
    cells = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 20 + [("b", "y")] * 25
    df = spark.createDataFrame(cells, "g string, o string")
    r = ST.chi2_contingency(df, "g", "o", with_p=True).first()
    obs = np.array([[30, 10], [20, 25]], float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    d = np.abs(obs - e)
    yates = (((d - np.minimum(0.5, d)) ** 2) / e).sum()
    assert r.dof == 1 and r.chi2 == pytest.approx(yates, abs=1e-6)
    assert r.p_value == pytest.approx(P.chi2_sf(yates, 1), abs=1e-6)
    rng = np.random.default_rng(0)
    cells = [(f"m{rng.integers(5)}", "f" if rng.random() < .3 else "s") for _ in range(300)]
    df = spark.createDataFrame(cells, "g string, o string")
    r = ST.chi2_contingency(df, "g", "o").first()
    ct = pd.crosstab(pd.Series([c[0] for c in cells]), pd.Series([c[1] for c in cells])).to_numpy(float)
    e = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / ct.sum()
    assert r.dof == 4 and r.chi2 == pytest.approx(((ct - e) ** 2 / e).sum(), abs=1e-6)


def test_ttest_pooled(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0]
    df = spark.createDataFrame([("old", v) for v in a] + [("new", v) for v in b], "s string, v double")
    r = ST.ttest_ind(df, "s", "v", "old", "new").first()
    sp2 = ((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(sp2 * (1 / len(a) + 1 / len(b)))
    assert r.t_stat == pytest.approx(t, abs=1e-6) and r.dof == 5


def test_adjusted_probability_rule_ro17(spark):
    df = spark.createDataFrame([(0.5, "review"), (0.65, "review"), (0.8, "route"), (0.6, "route"), (0.15, "route")],
                               "p double, a string")
    got = [r[0] for r in df.select(ST.adjusted_probability("p", "a")).collect()]
    assert got == pytest.approx([0.8, 0.55, 0.8, 0.5, 0.1])


def test_extremes_tie_breaks_on_key(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0)], "k string, failure_rate double")
    r = R.extremes(df, "k", "failure_rate").first()
    assert (r.worst_key, r.best_key) == ("a", "c")


def test_class_weights_balanced_t14(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(0,)], "label int")
    w = {r.label: r.weight for r in R.class_weights(df).collect()}
    assert w[0] == pytest.approx(10 / 2) and w[1] == pytest.approx(10 / 18)


def test_mean_ci_bootstrap_brackets_mean(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "g", float(rng.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    r = R.mean_ci_bootstrap(df, "g", "v", "id", replicates=100, blocks=200).first()
    m = np.mean([x[2] for x in rows])
    assert r.ci_low < m < r.ci_high and r.ci_high - r.ci_low < 0.06


def test_leak_free_rolling_excludes_current_row(spark):
    rows = [(i, "k", dt.datetime(2024, 1, 1, 0, i), float(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, y double")
    a = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 5, 2, "r", exclude_current=True).orderBy("id").toPandas()["r"]
    b = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 5, 2, "r", method="window", exclude_current=True) \
        .orderBy("id").toPandas()["r"]
    exp = pd.Series([r[3] for r in rows]).shift(1).rolling(5, min_periods=2).mean()
    np.testing.assert_allclose(a.to_numpy(dtype=float), exp.to_numpy(), atol=1e-12, equal_nan=True)
    np.testing.assert_allclose(b.to_numpy(dtype=float), exp.to_numpy(), atol=1e-12, equal_nan=True)


def test_nan_becomes_null_and_empty_input(spark, tmp_path):
    from payscope.sources import io as IO
    df = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, None)], "id long, network_latency double")
    p = str(tmp_path / "nan")
    df.write.parquet(p)
    back = IO.read_transactions(spark, p, "parquet")
    assert back.agg(F.avg("network_latency")).first()[0] == 4.0  # pandas mean skips NaN
    empty = _txn(spark, [])
    assert R.failure_rate_by(empty, ["payment_method"]).count() == 0
    assert C.missing_profile(empty).where("missing > 0").count() == 0


def test_quantiles_are_exact_for_any_shape(spark):
    rng = np.random.default_rng(11)
    shapes = {"few": [1.0], "two": [2.0, 1.0], "ties": [float(v) for v in rng.integers(0, 5, 300)], "log": np.exp(rng.normal(0, 4, 3000)).tolist(),
              "hot": [7.0] * 900 + rng.normal(size=300).tolist(), "tiny": (rng.random(500) * 1e-12).tolist(), "huge": (rng.random(500) * 1e29).tolist()}
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    for name, vals in shapes.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)] + [(-1, None)], "id long, x double")
        got = df.select(X.quantile_stat(df, "x", probs).alias("q")).first()["q"]
        np.testing.assert_allclose(got, np.percentile(vals, [100 * p for p in probs]), rtol=1e-9, err_msg=name)
    rows = [(k, v) for k, vals in shapes.items() for v in vals] + [(None, 3.0)]
    keyed = W.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", probs, ["k"]).collect()
    for r in keyed:
        want = 3.0 if r["k"] is None else np.percentile(shapes[r["k"]], 100 * r["p"])
        assert r["value"] == pytest.approx(want, rel=1e-9), r
    none = spark.createDataFrame([(1, None)], "id long, x double")
    assert none.select(X.quantile_stat(none, "x", 0.5).alias("q")).first()["q"] is None


NULLS = [("a", 1, 1.0), ("a", None, 2.0), ("a", 3, None), (None, 2, 4.0), ("a", 2, 5.0), ("b", None, 1e-12), ("b", 5, 1e29), (None, None, 3.0), ("b", 4, 3e-13), ("a", 200, 6.0)]


@pytest.mark.parametrize("stat", ["mean", "sum"])
@pytest.mark.parametrize("leak_free", [False, True])
def test_row_windows_keep_null_keys_and_times_and_any_magnitude(spark, stat, leak_free):
    df = spark.createDataFrame([(i, k, t, v) for i, (k, t, v) in enumerate(NULLS)], "id long, k string, t int, v double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 61))
    how = dict(stat=stat, exclude_current=leak_free, n=3, min_periods=1, out="r")
    a = {r["id"]: r["r"] for r in W.rolling_rows(df, ["k"], ["ts", "id"], "v", **how, block_rows=3).collect()}
    b = {r["id"]: r["r"] for r in W.rolling_rows(df, ["k"], ["ts", "id"], "v", **how, method="window").collect()}
    assert len(a) == len(NULLS) and a == b and a[3] is None and a[7] is None


def test_running_before_keeps_null_keys_and_times(spark):
    df = spark.createDataFrame([(i, k, t, i % 2) for i, (k, t, _) in enumerate(NULLS)], "id long, k string, t int, f int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 61))
    a, b = ({r["id"]: r["r"] for r in W.running_before(df, ["k"], ["ts", "id"], "f", "r", method=m).collect()} for m in ("prefix", "window"))
    assert len(a) == len(NULLS) and a == b and a[3] is None


def test_split_and_folds_keep_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "transaction_id long, result_numeric int")
    tr, te = ML.split(df, 0.25, stratify="result_numeric")
    assert tr.count() + te.count() == 60 and te.where("result_numeric is null").count() == 5
    assert ML.add_folds(df).count() == 60


def test_long_ids_stay_whole(spark):
    got = [r[0] for r in spark.createDataFrame([(7,), (99999,), (123456,)], "n long").select(X.make_id("MERCH", F.col("n"), 5)).collect()]
    assert got == ["MERCH00007", "MERCH99999", "MERCH123456"]


def test_reports_come_in_order(spark):
    from payscope.sources import schemas as S
    from payscope.sources import views as V
    t = V.transactions(spark, "/root/testdata/sf0.001")
    n = [r["n"] for r in R.error_table(R.with_failure_reason(t, V.error_dim(spark))).collect()]
    assert n == sorted(n, reverse=True) and len(n) > 3
    days = [r["day_name"] for r in R.heatmap_pivot(t.withColumn("day_name", X.day_name("txn_ts")), "day_name").collect()]
    assert days == [d for d in S.WEEKDAY_NAMES if d in days]
    counts = [r["count"] for r in R.value_counts(t, "payment_method").collect()]
    assert counts == sorted(counts, reverse=True)
    times = [r["txn_ts"] for r in R.sort_by_time(t.select("transaction_id", "txn_ts")).collect()]
    assert times == sorted(times)


def test_feature_pipeline_values(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (None, "y"), (8.0, None)], "a double, c string")
    m = Pipeline(stages=ML.feature_pipeline(df, ["a"], ["c"])).fit(df)
    assert ML.feature_names(m) == ["a", "c=x", "c=y"]
    new = spark.createDataFrame([(3.0, "z"), (None, None), (8.0, "y")], "a double, c string")
    got = [r["features"].toArray().tolist() for r in m.transform(new).collect()]
    # imputed 1, 3, 3, 8: mean 3.75, population deviation 2.5860...
    sd = float(np.std([1, 3, 3, 8]))
    np.testing.assert_allclose(got, [[-0.75 / sd, 0, 0], [-0.75 / sd, 1, 0], [4.25 / sd, 0, 1]])


def test_models_take_categoricals_and_name_every_slot(spark):
    rows = [(i, float(i % 7), "pqr"[i % 3], int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, c string, result_numeric int")
    m = ML.fit(df, "random_forest", ["a"], ["c"], numTrees=5, maxDepth=3)
    imp = ML.importances(m).collect()
    assert {r["feature"] for r in imp} == {"a", "c=p", "c=q", "c=r"} and imp[0]["feature"] == "a"
    assert ML.predict(ML.fit(df, "mlp", ["a"], ["c"], maxIter=5), df).count() == 120
    cv = ML.cv_table(ML.cross_validate(df, {"logistic": {}}, ["a"], folds=3)).first()
    assert cv["auc_mean"] > 0.9 and cv["accuracy_mean"] > 0.9


def test_retrain_only_on_drift(spark):
    from payscope.operators import monitor as MN
    verdict = lambda v: spark.createDataFrame([(v,)], "drift_detected boolean")
    assert MN.retrain_on_drift(verdict(True), lambda: "done") == "done"
    assert MN.retrain_on_drift(verdict(False), lambda: "done") is None and MN.retrain_on_drift(verdict(None), lambda: "done") is None


def test_cluster_needs_a_shared_folder():
    from payscope import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(ValueError):
        session.checkpoint_dir(type("S", (), {"sparkContext": Context()})())


def test_label_encode_cuts_prefixed_ids_evenly(spark):
    """20,000 ids with one prefix: ranks as sorted, and no range of levels holds much more than its share."""
    df = spark.range(20_000).select(F.format_string("MERCH%06d", F.col("id")).alias("m")).unionByName(spark.createDataFrame([("MERCH000007",), (None,)], "m string"))
    out = FE.label_encode(df, "m")
    got = {r["m"]: r["m_index"] for r in out.collect()}
    want = ["MERCH000007"] + [f"MERCH{i:06d}" for i in range(20_000) if i != 7]
    assert got == {m: i for i, m in enumerate(want)} | {None: None}
    ranges = df.where("m IS NOT NULL").groupBy("m").count().repartitionByRange(8, F.col("count").desc(), "m").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 2 * 20_000 / 8
