"""State tables with a commit log, routing row by row on a stream, unanswered predictions."""

import datetime as dt
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.operators import routing as RT
from payscope.streaming import bandit as BA
from payscope.streaming import state_table as TB
from payscope.streaming import streams as ST

ARMS = ["A", "B", "C"]
START = dt.datetime(2024, 1, 1)


def _values(spark, path):
    return {r["k"]: r["v"] for r in ST.latest(spark, path, ["k"]).collect()}


def test_state_table_commits_replays_and_compacts(spark, tmp_path):
    path = str(tmp_path / "out")
    write = ST.upsert_sink(path, ["k"], compact_every=3)
    with pytest.raises(FileNotFoundError):
        ST.latest(spark, path, ["k"])
    for b in range(11):
        rows = [(f"k{b % 4}", b), ("all", b), (None, b)]
        for _ in range(2):  # the second time it is replayed after its commit
            write(spark.createDataFrame(rows, "k string, v long"), b)
        assert _values(spark, path) == {"all": b, None: b} | {f"k{i % 4}": i for i in range(b + 1)}
    t = TB.StateTable(spark, path)
    folders = {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch-")}
    last = t.manifest(t.commits()[-1])
    assert set(last["folders"]) <= folders and len(folders) <= 8 and len(t.commits()) <= 4
    assert not [p for p in (tmp_path / "out" / TB.COMMITS).iterdir() if p.name.endswith("~")]


def test_a_batch_that_failed_before_its_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    write = ST.upsert_sink(path, ["k"])
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long"), 0)
    # half a batch, as a task that died leaves it
    spark.createDataFrame([("a", 99, 1)], "k string, v long, _batch long").write.parquet(f"{path}/batch-1-dead")
    assert _values(spark, path) == {"a": 1, "b": 1}
    write(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    assert _values(spark, path) == {"a": 2, "b": 1}


def test_a_reader_during_replays_and_compactions_misses_no_key(spark, tmp_path):
    path, keys, stop, seen, errors = str(tmp_path / "out"), [f"k{i}" for i in range(5)], threading.Event(), [], []
    write = ST.upsert_sink(path, ["k"], compact_every=2)
    write(spark.createDataFrame([(k, 0) for k in keys], "k string, v long"), 0)

    def read():
        while not stop.is_set():
            try:
                seen.append(_values(spark, path))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for b in range(1, 9):
        for _ in range(2):
            write(spark.createDataFrame([(keys[b % 5], b)], "k string, v long"), b)
    stop.set()
    reader.join()
    assert not errors and len(seen) > 2
    assert all(set(s) == set(keys) for s in seen)
    assert all(sum(a.values()) <= sum(b.values()) for a, b in zip(seen, seen[1:]))


# ---- routing ----

def _events(spark, n, seed):
    r = np.random.default_rng(seed)
    rows = [(i, START + dt.timedelta(seconds=i), ARMS[int(r.integers(0, 3))] if i % 17 else "other", ["success", "failure", "pending"][int(r.choice(3, p=[0.6, 0.3, 0.1]))],
             f"g{i % 2}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "transaction_id long, txn_ts timestamp_ntz, processor_id string, result string, grp string")


def _files(df, n, path):
    for i in range(n):
        df.where((F.col("transaction_id") >= i * 40) & (F.col("transaction_id") < (i + 1) * 40)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_stream_routing_equals_one_row_buckets_and_restarts(spark, tmp_path):
    rows, df = _events(spark, 120, 3)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        s = BA.route_stream(ST.file_stream(spark, src, df.schema, max_files=1), ARMS, BA.POLICIES)
        ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)

    _files(df, 2, src)
    run()
    assert spark.read.parquet(out).count() == 80
    df.where("transaction_id >= 80").coalesce(1).write.mode("append").parquet(src)
    run()  # goes on from the checkpoint's counters
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 120
    logged = df.withColumn("result_numeric", RT.X.is_success("result"))
    stats = RT.running_arm_stats(logged, ARMS, bucket="second")
    state = RT.bucket_state(stats, ARMS)
    batch = RT.bandit_decisions(logged, state, ARMS, bucket="second")
    batch = RT.thompson(batch, RT.thompson_samples(stats), ARMS, bucket="second")
    for r in batch.collect():
        assert [got[r["transaction_id"]][f"route_{p}"] for p in BA.POLICIES] == [r[f"route_{p}"] for p in BA.POLICIES], r["transaction_id"]
    assert got[119]["trials_before"] == sum(x[2] in ARMS for x in rows[:119])


def test_stream_routing_lanes_learn_apart(spark, tmp_path):
    rows, df = _events(spark, 80, 4)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    _files(df, 2, src)
    s = BA.route_stream(ST.file_stream(spark, src, df.schema, max_files=1), ARMS, ["ucb"], by=["grp"], epsilon=0.0)
    ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    for g in ("g0", "g1"):
        n, w = dict.fromkeys(ARMS, 0), dict.fromkeys(ARMS, 0)
        for i, _, arm, result, grp in rows:
            if grp != g:
                continue
            total = sum(n.values())
            assert got[i]["trials_before"] == total and got[i]["grp"] == g
            if total:
                values = [w[a] / n[a] + math.sqrt(math.log(total) / n[a]) if n[a] else math.inf for a in ARMS]
                assert got[i]["route_ucb"] == ARMS[values.index(max(values))]
            if arm in n:
                n[arm] += 1
                w[arm] += result == "success"


# ---- unanswered predictions ----

def test_every_prediction_leaves_once(spark, tmp_path):
    day = dt.timedelta(days=1)
    p_schema, f_schema = "transaction_id string, txn_ts timestamp_ntz, success_probability double", "fb_transaction_id string, actual_success boolean, feedback_ts timestamp_ntz"
    p, f = str(tmp_path / "p"), str(tmp_path / "f")

    def put(rows, schema, path):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)

    put([(f"a{i}", START + i * dt.timedelta(minutes=1), 0.5) for i in range(6)] + [("a0", START, 0.5)], p_schema, p)  # a0 twice
    put([("b0", START + 10 * day, 0.5), ("b1", START + 10 * day, 0.5)], p_schema, p)
    put([("end", START + 40 * day, 0.5)], p_schema, p)
    # a0 at once (twice), a1 at seven days, a2 a minute too late, a3 in the next file, still on time, b0 before its prediction, b1 in time
    put([("a0", True, START + day), ("a0", True, START + day), ("a1", False, START + 7 * day + dt.timedelta(minutes=1)), ("a2", True, START + 7 * day + dt.timedelta(minutes=3)),
         ("nobody", True, START + day)], f_schema, f)
    put([("a3", True, START + 2 * day), ("b0", True, START + 9.5 * day), ("b1", True, START + 11 * day)], f_schema, f)
    put([("-", True, START + 40 * day)], f_schema, f)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ST.outcome_stream(ST.file_stream(spark, p, spark.read.parquet(p).schema, max_files=1), ST.file_stream(spark, f, spark.read.parquet(f).schema, max_files=1))
    ST.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"), ck)
    got = sorted((r["transaction_id"], r["actual_success"], r["feedback_ts"] is None) for r in spark.read.parquet(out).collect())
    assert [g[0] for g in got] == ["a0", "a1", "a2", "a3", "a4", "a5", "b0", "b1"]
    answered = {g[0]: g[1] for g in got if not g[2]}
    assert answered == {"a0": True, "a1": False, "a3": True, "b1": True}
