"""Fits, features and streams whose tasks stay small as the input grows."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from payscope.operators import boosting as BO
from payscope.operators import features as FE
from payscope.operators import ml as ML
from payscope.operators import routing as RT
from payscope.operators import smote as SM
from payscope.operators import windows as W
from payscope.plans import q_io_stream as QS
from payscope.session import spread

T0 = dt.datetime(2024, 1, 1)


def transactions(spark, n=400):
    """Rows of few values, with missing latencies and a missing merchant."""
    rows = [(i, T0 + dt.timedelta(minutes=7 * (i % 300)), f"M{i % 4}" if i % 50 else None, ["urban", "rural"][i % 2], float(i * 37 % 1000) + 0.5,
             ["card", "USSD", "bank"][i % 3], ["mobile", "web"][i % 2], None if i % 9 == 0 else 20.0 + i * 13 % 400, "failure" if i % 5 == 0 else "success",
             f"P{i % 2}", i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id long, txn_ts timestamp_ntz, merchant_id string, customer_location string, payment_amount double, "
                                 "payment_method string, device_type string, network_latency double, result string, processor_id string, retry_count int")


def test_class_weights_move_no_row(spark):
    """Joined by a shuffle, all rows of a class would be read by one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = ML.with_class_weights(spark.range(1000).select("id", (F.col("id") % 5 == 0).cast("int").alias(ML.LABEL)))
        assert "BroadcastHashJoin" in t._jdf.queryExecution().executedPlan().toString()
        assert {(r[ML.LABEL], r["weight"]) for r in t.collect()} == {(0, 1000 / 1600), (1, 1000 / 400)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_dealt_to_even_tasks(spark):
    t = spread(spark.range(0, 1000, 1, 1), 100)
    sizes = [r[1] for r in t.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 110
    assert spread(spark.range(0, 100, 1, 1), 100).rdd.getNumPartitions() == 1


def test_chosen_features_are_those_of_the_whole_table(spark):
    t = transactions(spark)
    wanted = ["transaction_id", "payment_amount", "amount_log", *ML.MODEL_FEATURES]
    some, whole = FE.features(t, columns=wanted), FE.features(t)
    assert some.columns == wanted
    a, b = (x.select(wanted).orderBy("transaction_id").toPandas() for x in (some, whole))
    assert len(a) == 400
    for c in wanted:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12)


def test_moving_success_of_columns_is_that_of_the_long_table(spark):
    arms = ["P0", "P1"]
    t = transactions(spark).withColumns({"result_numeric": F.when(F.col("result") == "success", 1).otherwise(0),
                                         "route_one": F.lit("P1"), "route_two": F.when(F.col("transaction_id") % 7 > 0, "P0").otherwise("P1")})
    t = t.withColumn("scores", F.array(*[F.struct(F.lit(a).alias("arm"), F.when(F.col("transaction_id") % 11 > 0, F.col("payment_amount") / 1000 + i).alias("score")) for i, a in enumerate(arms)]))
    policies = ["processor_id", "route_one", "route_two"]
    long = RT.moving_success(RT.decisions_long(t, policies), 20).select("transaction_id", "strategy", F.round("moving_success", 9))
    got = RT.moving_success_of(t, policies, 20).select("transaction_id", "strategy", F.round("moving_success", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, long.collect()))


def test_slices_of_a_stream_keep_to_their_rows(spark):
    """A lane's task holds a slice in Python, so more rows must give more slices, in order of time, with every row."""
    t = transactions(spark, 300).select("transaction_id", "txn_ts")
    path, schema, files = QS._stage_in_order(spark, t, "txn_ts", "slices", slice_rows=25)
    rows = spark.read.schema(schema).parquet(path).select("transaction_id", "txn_ts", F.col("_metadata.file_modification_time").alias("m"), F.input_file_name().alias("f"))
    per_file = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("txn_ts").alias("lo"), F.max("txn_ts").alias("hi"), F.first("m").alias("m")).orderBy("m").collect()
    assert sum(r["n"] for r in per_file) == 300 and files == 2
    assert len(per_file) >= 20 and max(r["n"] for r in per_file) <= 25
    slices = [per_file[i:i + 2] for i in range(0, len(per_file), 2)]
    assert all(max(x["hi"] for x in a) < min(x["lo"] for x in b) for a, b in zip(slices, slices[1:]))


def test_vectors_of_a_batch(spark):
    x = SM._matrix(pa.array([[0.0, 1.0], [2.0, None]]))
    assert x.shape == (2, 2) and x[0].tolist() == [0.0, 1.0] and x[1][0] == 2.0 and np.isnan(x[1][1])
    assert SM._matrix(pa.array([[0.0, 1.0], [3.0, 4.0]]).slice(1)).tolist() == [[3.0, 4.0]]


def test_windows_of_a_key_gather_ends_of_hours_only(spark):
    """One task must not hold all rows of a key: only the rows at the ends of hours meet in a window of the key."""
    rows = [(i, ["a", None][i % 7 == 0], T0 + dt.timedelta(seconds=20 * i + (7200 if i > 900 else 0)) if i % 50 else None, float(i * 31 % 17)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, y double")
    for how in (dict(), dict(exclude_current=True)):
        got = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 5, 2, "r", method="window", **how)
        gathered = [w for w in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in w and "_slice" not in w.split("], [")[1]]
        assert len(gathered) == 1
        want = W.rolling_rows(df, ["k"], ["ts", "id"], "y", 5, 2, "r", **how)
        assert {r["id"]: r["r"] for r in got.collect()} == {r["id"]: r["r"] for r in want.collect()}


def test_histogram_copies_no_row(spark):
    """Sums by node, feature and bin are those of the rows, also beyond what doubles hold, and no row is exploded once per feature."""
    rows = [(i % 3 + 1, [i % 4, -1 if i % 5 == 0 else i % 6, 0], (1 << 60) // 300 + i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "node int, bins array<int>, g long, h long").repartition(3)
    cells = BO.histogram(df, [0, 1])
    assert "Generate" not in cells._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for node, bins, g, h in rows:
        for f in (0, 1):
            a, b = want.get((node, f, bins[f]), (0, 0))
            want[node, f, bins[f]] = a + g, b + h
    assert {(r["node"], r["feature"], r["bin"]): (r["g"], r["h"]) for r in cells.collect()} == want
    assert BO.histogram(df.where("node > 9"), [0]).count() == 0
    # a tree cut at the root, missing values on the left, and on its left side only
    tree = BO.Tree.empty(2)
    tree.feature[0], tree.cut[0], tree.missing_left[0], tree.feature[1], tree.cut[1] = 1, 2, True, 0, 1
    at = lambda depth: {r["node"]: r["h"] for r in BO.histogram(df.drop("node"), [2], tree, depth).collect()}
    left = [r for r in rows if r[1][1] <= 2]
    assert at(0) == {0: sum(r[3] for r in rows)}
    assert at(1) == {1: sum(r[3] for r in left), 2: sum(r[3] for r in rows) - sum(r[3] for r in left)}
    assert at(2) == {3: sum(r[3] for r in left if r[1][0] <= 1), 4: sum(r[3] for r in left if r[1][0] > 1)}


def _labelled_rows(spark, n=300):
    rows = [(i, i % 3 % 2, float(i % 3) + (i * 7 % 5) / 10, None if i % 11 == 0 else float(i * 13 % 29), float(i * 17 % 31)) for i in range(n)]
    return spark.createDataFrame(rows, f"transaction_id long, {ML.LABEL} int, a double, b double, c double")


def test_elimination_prepares_its_rows_once(spark, monkeypatch):
    df, made = _labelled_rows(spark), []
    pipeline = ML.feature_pipeline
    monkeypatch.setattr(ML, "feature_pipeline", lambda *a, **k: made.append(1) or pipeline(*a, **k))
    cur = ["c", "a", "b"]
    got = ML.rfe(df, cur, 1)
    assert len(made) == 1
    while len(cur) > 1:  # the plain form: a whole fit a round
        cur.pop(int(np.argmin(np.abs(ML.fit(df, "logistic", cur).stages[-1].coefficients.toArray()))))
    assert got == cur


def test_models_of_a_fold_share_its_rows(spark, monkeypatch):
    df, made = _labelled_rows(spark), []
    pipeline = ML.feature_pipeline
    monkeypatch.setattr(ML, "feature_pipeline", lambda *a, **k: made.append(1) or pipeline(*a, **k))
    got = ML.cross_validate(df, {"logistic": {}, "random_forest": {"numTrees": 3}}, ["a", "b"], folds=2).collect()
    assert len(made) == 2
    t = ML.add_folds(df, 2)
    for r in got:
        how = {"numTrees": 3} if r["model"] == "random_forest" else {}
        p = ML.predict(ML.fit(t.where(F.col("fold") != r["fold"]), r["model"], ["a", "b"], **how), t.where(F.col("fold") == r["fold"]), r["model"])
        m = ML.binary_metrics(p, "p", "y", pred="yhat").first()
        assert (r["n"], r["accuracy"], r["f1"]) == (m["n"], m["accuracy"], m["f1"]) and r["auc"] == ML.roc_auc(p, "p", "y").first()["auc"]
    assert sorted((r["model"], r["fold"]) for r in got) == [(m, k) for m in ("logistic", "random_forest") for k in (0, 1)]


def test_bandit_choices_are_made_once_a_bucket(spark):
    """What follows from the counters of a bucket is found on the table of buckets, not on every row."""
    t = transactions(spark).withColumn("result_numeric", F.when(F.col("result") == "success", 1).otherwise(0))
    arms = ["P0", "P1"]
    state = RT.bucket_state(RT.running_arm_stats(t, arms), arms)
    got = RT.bandit_decisions(t, state, arms)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(plan) if "Join LeftOuter" in x)
    assert not any("lambda" in x for x in plan[:join])
    rows = {r["transaction_id"]: r for r in got.collect()}
    for r in RT.with_state(t, state).select("transaction_id", "state").collect():
        s, x = r["state"], rows[r["transaction_id"]]
        n = sum(e["trials"] for e in s)
        if n and all(e["trials"] for e in s):
            value = lambda e: e["successes"] / e["trials"] + (np.log(n) / e["trials"]) ** 0.5
            assert x["route_ucb"] == max(s, key=value)["arm"]


def test_deep_forests_note_the_nodes_of_rows(spark, monkeypatch):
    """Walking every row down from the root once a level made the passes of deep forests slow; the forest is the same either way."""
    df, made = _labelled_rows(spark), []
    fitted = ML.RandomForestClassifier.fit
    monkeypatch.setattr(ML.RandomForestClassifier, "fit", lambda self, *a: made.append(self.getCacheNodeIds()) or fitted(self, *a))
    forest = lambda **kw: ML.fit(df, "random_forest", ["a", "b", "c"], numTrees=4, **kw).stages[-1].toDebugString.split("\n", 1)[1]
    noted = forest(maxDepth=8)
    forest(maxDepth=5)
    monkeypatch.setattr(ML, "NODE_ID_BYTES", 8 * 300 * 4 - 1)
    assert forest(maxDepth=8) == noted and "Predict" in noted
    assert made == [True, False, False]


def test_searches_note_the_nodes_of_rows(spark, monkeypatch):
    """The notes of all fits that run at once count together."""
    df, made = _labelled_rows(spark), []
    keep = ML.keep_nodes
    monkeypatch.setattr(ML, "keep_nodes", lambda *a: made.append(keep(*a).getCacheNodeIds()) or a[0])
    search = lambda: ML.grid_search(df, {"numTrees": [2, 3], "maxDepth": [2, 7]}, folds=3, parallelism=3, features=["a", "b"])
    noted = search().avgMetrics
    monkeypatch.setattr(ML, "NODE_ID_BYTES", 8 * 200 * (3 + 3 + 2))
    assert search().avgMetrics == noted
    monkeypatch.setattr(ML, "NODE_ID_BYTES", 8 * 200 * (3 + 3 + 2) - 1)
    assert search().avgMetrics == noted
    assert made == [True, True, False]
