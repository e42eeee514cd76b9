"""Routing against brute force, streaming semantics, plan checks, ML and IO."""

import datetime as dt
import math
import os
import sys
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import ml as ML
from payscope.operators import routing as RT
from payscope.sources import io as IO
from payscope.sources import views as V
from payscope.streaming import streams as ST
from tests.conftest import SF001

ARMS = ["P1", "P2", "P3"]


def _logged(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), str(rng.choice(ARMS)), int(rng.random() < 0.7))
            for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id long, txn_ts timestamp_ntz, processor_id string, result_numeric int"), rows


def test_ucb_one_row_buckets_equal_row_by_row(spark):
    df, rows = _logged(spark)
    stats = RT.running_arm_stats(df, ARMS, bucket="second")
    got = {r.transaction_id: r.route_ucb for r in RT.ucb(df, RT.bucket_state(stats, ARMS), ARMS, bucket="second").collect()}
    n = {a: 0 for a in ARMS}
    s = {a: 0 for a in ARMS}
    for tid, _, arm, y in rows:
        total = sum(n.values())
        if total > 0:
            vals = [(s[a] / n[a] + math.sqrt(math.log(total) / n[a])) if n[a] else float("inf") for a in ARMS]
            best = ARMS[int(np.argmax(vals))]  # first max in arm order
            assert got[tid] == best, tid
        n[arm] += 1
        s[arm] += y


def test_epsilon_greedy_exploit_is_best_rate(spark):
    df, rows = _logged(spark, 40, 1)
    stats = RT.running_arm_stats(df, ARMS, bucket="second")
    out = RT.epsilon_greedy(df, RT.bucket_state(stats, ARMS), ARMS, epsilon=0.0, bucket="second")
    got = {r.transaction_id: r.route_epsilon_greedy for r in out.collect()}
    n = {a: 0 for a in ARMS}
    s = {a: 0 for a in ARMS}
    for tid, _, arm, y in rows:
        rates = [s[a] / n[a] if n[a] else 0.0 for a in ARMS]
        assert got[tid] == ARMS[int(np.argmax(rates))]
        n[arm] += 1
        s[arm] += y


def test_a_policy_from_outside_is_routed_and_evaluated(spark, monkeypatch):
    monkeypatch.setattr(RT, "REGISTRY", dict(RT.REGISTRY))

    @RT.policy("least_used")
    def least_used(df, logged):
        used = F.transform("state", lambda e: F.struct(e["trials"].alias("n"), e["arm"].alias("a")))
        return df.withColumn("route_least_used", F.array_min(used)["a"])

    with pytest.raises(ValueError):
        RT.policy("simple")(least_used)
    t, arms = RT.route_all(V.transactions(spark, SF001), policies=["simple", "static", "least_used"])
    assert t.where(F.col("route_least_used").isNull()).count() == 0
    long = RT.decisions_long(t, ["route_simple", "route_static", "route_least_used", "processor_id"])
    got = {r["strategy"]: r["success_rate"] for r in RT.expected_success(long).collect()}
    assert set(got) == {"simple", "static", "least_used", "actual"} and got["simple"] >= got["least_used"]
    n = {a: 0 for a in arms}
    rows = t.select("txn_ts", "processor_id", "route_least_used").orderBy("txn_ts").collect()
    hours = sorted({r["txn_ts"].replace(minute=0, second=0, microsecond=0) for r in rows})
    for h in hours:
        here = [r for r in rows if r["txn_ts"].replace(minute=0, second=0, microsecond=0) == h]
        assert {r["route_least_used"] for r in here} == {min(arms, key=lambda a: (n[a], a))}
        for r in here:
            n[r["processor_id"]] += 1

    RT.policy("broken")(lambda df, logged: df)
    with pytest.raises(ValueError):
        RT.route_all(V.transactions(spark, SF001), policies=["broken"])


def _capped_by_rounds(rows, arms, ratio):
    """rows: (id, bucket, scores in arm order) -> processor, round by round."""
    out = {}
    for b in {r[1] for r in rows}:
        here = [r for r in rows if r[1] == b]
        room = dict.fromkeys(arms, math.floor(len(here) * ratio))
        prefs = {i: sorted(range(len(arms)), key=lambda j: (-sc[j], j)) for i, _, sc in here}
        left = sorted(here, key=lambda r: r[0])
        for rnd in range(len(arms)):
            asked = {}
            for i, _, sc in left:
                asked.setdefault(arms[prefs[i][rnd]], []).append((-sc[prefs[i][rnd]], i))
            taken = set()
            for a, ids in asked.items():
                for _, i in sorted(ids)[: room[a]]:
                    out[i] = a
                    taken.add(i)
                room[a] -= min(room[a], len(ids))
            left = [r for r in left if r[0] not in taken]
        out |= {i: arms[prefs[i][0]] for i, _, _ in left}
    return out


@pytest.mark.parametrize("kind", ["ties", "strings", "one score", "no room"])
def test_route_capped_with_ties_and_string_ids(spark, kind):
    rng = np.random.default_rng(7)
    arms = [f"P{i}" for i in range(6)]
    rows = []
    for n in range(240):
        sc = [0.5] * 6 if kind == "one score" else [float(x) for x in rng.choice([0.1, 0.2, 0.9], 6, p=[0.2, 0.2, 0.6])]
        rows.append((f"T{rng.integers(0, 10 ** 6)}-{n}" if kind == "strings" else int(n * 40_000), None if n % 3 == 0 else dt.datetime(2024, 1, 1, n % 3), sc))
    df = spark.createDataFrame([(i, t, [{"arm": a, "score": s} for a, s in zip(arms, sc)], n) for n, (i, t, sc) in enumerate(rows)],
                               f"transaction_id {'string' if kind == 'strings' else 'long'}, txn_ts timestamp_ntz, scores array<struct<arm:string, score:double>>, left int")
    ratio = 0.001 if kind == "no room" else 0.17
    out = RT.route_capped(df.repartition(5), arms, ratio)
    assert out.columns == [*df.columns, "route_capped"]
    assert {r.transaction_id: r.route_capped for r in out.collect()} == _capped_by_rounds(rows, arms, ratio)


def test_route_capped_writes_the_rows_once(spark, monkeypatch):
    """Row tables written: one; tables written after it have at most a row per bucket and processor (or cell, score of one)."""
    written = []
    monkeypatch.setattr(RT, "cut_lineage", lambda df: written.append(out := real(df)) or out)
    real = sys.modules["payscope.session"].cut_lineage
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), [{"arm": a, "score": i / 500.0} for a in ARMS]) for i in range(500)],
                               "transaction_id long, txn_ts timestamp_ntz, scores array<struct<arm:string, score:double>>")
    RT.route_capped(df, ARMS, 0.3)
    assert [t.count() for t in written][0] == 500 and max(t.count() for t in written[1:]) <= len(ARMS)


def test_route_capped_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        sc = [float(x) for x in rng.random(3).round(3)]
        rows.append((i, dt.datetime(2024, 1, 1, i // 30), sc))
    df = spark.createDataFrame([(i, t, [{"arm": a, "score": s} for a, s in zip(ARMS, sc)]) for i, t, sc in rows],
                               "transaction_id long, txn_ts timestamp_ntz, scores array<struct<arm:string, score:double>>")
    got = {r.transaction_id: r.route_capped for r in RT.route_capped(df, ARMS, 0.3, checkpoint=False).collect()}
    exp = {}
    for h in range(3):
        b = [r for r in rows if r[1].hour == h]
        cap = math.floor(len(b) * 0.3)
        prefs = {i: [ARMS[j] for j in sorted(range(3), key=lambda j: (-sc[j], j))] for i, _, sc in b}
        score = {i: dict(zip(ARMS, sc)) for i, _, sc in b}
        used = {a: 0 for a in ARMS}
        left = [i for i, _, _ in b]
        for rnd in range(3):
            want = {}
            for i in left:
                want.setdefault(prefs[i][rnd], []).append(i)
            nxt = []
            for a, ids in want.items():
                ids.sort(key=lambda i: (-score[i][a], i))
                room = cap - used[a]
                for k, i in enumerate(ids):
                    if k < room:
                        exp[i] = a
                    else:
                        nxt.append(i)
                used[a] += min(room, len(ids)) if room > 0 else 0
            left = nxt
        for i in left:
            exp[i] = prefs[i][0]
    assert got == exp
    per = {}
    for i, a in got.items():
        per[(rows[i][1].hour, a)] = per.get((rows[i][1].hour, a), 0) + 1
    assert max(per.values()) <= 30  # no arm takes a whole bucket


# ---- streaming ---------------------------------------------------------------------------

def _write_files(spark, df_parts, root):
    for k, part in enumerate(df_parts):
        part.coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # distinct modification times -> file order = batch order


def test_stream_late_row_dropped_and_duplicates(spark, tmp_path):
    base = dt.datetime(2024, 1, 2, 12)
    schema = "event_id long, ts timestamp_ntz, response_time_s double, status int, level string, message string"
    f1 = spark.createDataFrame([(1, base, 0.1, 500, "ERROR", "a"), (2, base + dt.timedelta(hours=5), 0.1, 500, "ERROR", "b")], schema)
    late = spark.createDataFrame([(3, base + dt.timedelta(hours=1), 0.1, 500, "ERROR", "late")], schema)  # < watermark
    src = str(tmp_path / "log")
    f2 = spark.createDataFrame([(4, base + dt.timedelta(hours=5), 0.1, 500, "ERROR", "c")], schema)
    _write_files(spark, [f1, f2, late], src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ST.error_stream(ST.file_stream(spark, src, f1.schema, max_files=1))
    run = ST.run_available(s.writeStream.foreachBatch(ST.upsert_sink(out, ["window_start"])).outputMode("update"), ck)
    res = ST.latest(spark, out, ["window_start"])
    # the three on-time rows count in 24 windows each; rows are late by the watermark of the batch
    # before, 16:00, so of the late row's 24 windows those that ended at 14:00, 15:00, 16:00 are closed
    total = res.agg(F.sum("error_count")).first()[0]
    assert total == 3 * 24 + 21
    on_time = res.where(F.col("window_start") > F.lit(base + dt.timedelta(hours=1))).agg(F.sum("error_count")).first()[0]
    assert on_time == 8  # windows starting at +2h..+5h hold only the two on-time rows at +5h
    marks = [p["eventTime"].get("watermark") for p in run.recentProgress]
    assert marks[-1].startswith("2024-01-02T16:00")  # max event time - 1 hour
    # duplicates inside the watermark are dropped
    fb_schema = "transaction_id long, txn_ts timestamp_ntz, actual_success boolean, prediction_probability double"
    a = spark.createDataFrame([(1, base, True, 0.9), (2, base, False, 0.2)], fb_schema)
    b = spark.createDataFrame([(1, base + dt.timedelta(minutes=5), True, 0.9), (3, base, True, 0.5)], fb_schema)
    src2 = str(tmp_path / "fb")
    _write_files(spark, [a, b], src2)
    out2, ck2 = str(tmp_path / "out2"), str(tmp_path / "ck2")
    s2 = ST.feedback_stream(ST.file_stream(spark, src2, a.schema, max_files=1))
    ST.run_available(s2.writeStream.format("parquet").option("path", out2).outputMode("append"), ck2)
    assert sorted(r.transaction_id for r in spark.read.parquet(out2).collect()) == [1, 2, 3]


def test_stream_restart_from_checkpoint(spark, tmp_path):
    t = V.transactions(spark, SF001).select("transaction_id", "txn_ts", "processor_id", "result")
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    first, second = t.where(F.col("transaction_id") < 500), t.where(F.col("transaction_id") >= 500)
    _write_files(spark, [first], src)
    q = lambda: ST.arm_stats_stream(ST.file_stream(spark, src, t.schema))
    ST.run_available(q().writeStream.foreachBatch(ST.upsert_sink(out, ["processor_id"])).outputMode("update"), ck)
    _write_files(spark, [second], src)
    ST.run_available(q().writeStream.foreachBatch(ST.upsert_sink(out, ["processor_id"])).outputMode("update"), ck)
    got = {r.processor_id: r.trials for r in ST.latest(spark, out, ["processor_id"]).collect()}
    exp = {r.processor_id: r["count"] for r in t.groupBy("processor_id").count().collect()}
    assert got == exp


# ---- plans -----------------------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_push_and_broadcast(spark):
    import __spark_entry__ as E
    q = E.queries()
    p = _plan(q["failure_rate_by_payment_method"](spark, SF001))
    assert "ReadSchema: struct<event_type:string,props:string>" in p
    p = _plan(q["filter_dashboard_range"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    p = _plan(q["event_factor"](spark, SF001))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_core_plans_have_no_python_udf(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["kpis", "error_table", "group_stats", "payment_method_rolling_success", "processor_scores",
                 "calibration_table", "ml_threshold_sweep", "box_stats_amount_by_method"]:
        p = _plan(q[name](spark, SF001))
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name


def test_prefix_rolling_never_partitions_raw_rows_by_key_alone(spark):
    t = V.transactions(spark, SF001)
    from payscope.operators import features as FE
    p = _plan(FE.payment_method_rolling_success(t))
    for line in p.splitlines():
        if "Window [" in line and "payment_method" in line:
            # raw rows: (key, slice) or (key, block of rows); else the slice table
            assert "_slice" in line or "_ss_" in line or "_sc" in line or "_b#" in line, line


# ---- ML and IO ------------------------------------------------------------------------------

def test_ml_fit_beats_chance_and_save_load(spark, tmp_path):
    from payscope.plans.q_ml import model_table
    t = model_table(spark, SF001)
    tr, te = ML.split(t)
    m = ML.fit(tr, "logistic", ML.MODEL_FEATURES, maxIter=50)
    p = ML.predict(m, te)
    assert ML.roc_auc(p, "p", "y").first()["auc"] > 0.6
    ML.save_model(m, str(tmp_path), {"ok": 1}, version="v1")
    m2 = ML.load_model(str(tmp_path), "v1")
    a = [r.p for r in ML.predict(m, te).orderBy("transaction_id").collect()]
    b = [r.p for r in ML.predict(m2, te).orderBy("transaction_id").collect()]
    assert a == b


def test_io_reader_writer(spark, tmp_path):
    with pytest.raises(ValueError):
        IO.write_table(spark.range(1), str(tmp_path / "x"), "xlsx")
    p = tmp_path / "t.csv"
    p.write_text("transaction_id,timestamp,merchant_id,customer_id,customer_location,payment_amount,payment_method,"
                 "device_type,network_latency,result,processor_id,hhmm,day_name,error_code,failure_reason,retry_count,"
                 "regional_event\n1,2024-01-01 10:00:00,M,C,urban,5.5,USSD,web,30.0,success,PROC001,10:00,Monday,,,0,\n"
                 "2,not a time,M,C,urban,5.5,USSD,web,30.0,failure,PROC001,10:00,Monday,E001,x,1,\n")
    df = IO.read_transactions(spark, str(p), "csv").orderBy("transaction_id").collect()
    assert df[0].timestamp == dt.datetime(2024, 1, 1, 10) and df[1].timestamp is None
    assert IO.read_feedback(spark, str(tmp_path / "nothing")) is None
    raw = spark.createDataFrame([('{"transaction_id": "1"}',), ("not json",)], "value string")
    good, bad = IO.parse_requests(raw)
    assert good.count() == 0 and bad.count() == 2


def test_stream_archive_reads_each_file_once(spark, tmp_path):
    fb = V.feedback(spark, SF001).select(F.col("transaction_id").cast("string").alias("transaction_id"),
                                         "actual_success", "prediction_probability")
    src, arch = str(tmp_path / "in"), str(tmp_path / "archive")
    for part in (fb.where(F.col("transaction_id") % 2 == 0), fb.where(F.col("transaction_id") % 2 == 1)):
        part.coalesce(1).write.mode("append").option("header", True).csv(src)
        time.sleep(1.1)
    from payscope.sources import schemas as S
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ST.file_stream(spark, src, S.FEEDBACK, fmt="csv", max_files=1, archive_dir=arch)
    ST.run_available(s.writeStream.format("parquet").option("path", out), ck)
    assert spark.read.parquet(out).count() == fb.count()  # every file read exactly once
    archived = [f for _, _, fs in os.walk(arch) for f in fs if f.endswith(".csv")]
    assert len(archived) >= 1  # files of committed batches were moved out of the source


def test_bucketed_join_has_no_exchange(spark):
    import __spark_entry__ as E
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:  # tiny tables would be broadcast; force the large-table path
            spark.conf.set(k, "-1")
        df = E.queries()["prediction_vs_actual_bucketed"](spark, SF001)
        p = _plan(df)
        assert "SortMergeJoin" in p and "Exchange" not in p, p
        assert df.count() == V.transactions(spark, SF001).count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
