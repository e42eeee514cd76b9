"""Times joined with intervals: equal to a loop over all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from payscope.operators import features as FE
from payscope.operators import intervals as I

START = dt.datetime(2020, 1, 1)


def _times(n, seed):
    r = random.Random(seed)
    return [(i, None if i % 31 == 0 else START + dt.timedelta(seconds=r.randint(-10 ** 8, 3 * 10 ** 8), microseconds=r.randint(0, 999_999))) for i in range(n)]


def _intervals(seed):
    r = random.Random(seed)
    out = [(f"x{i}", START + dt.timedelta(seconds=(s := r.randint(-10 ** 8, 3 * 10 ** 8))), START + dt.timedelta(seconds=s + int(10 ** r.uniform(0, 8.5)))) for i in range(60)]
    out += [("point", START, START), ("hour", START, START + dt.timedelta(hours=1)), ("backwards", START, START - dt.timedelta(1)), ("open", START, None), ("never", None, START),
            ("ages", dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1))]
    return out


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_equals_all_pairs(spark):
    times, spans = _times(400, 1) + [(900, START), (901, START + dt.timedelta(hours=1)), (902, START + dt.timedelta(hours=1, microseconds=1))], _intervals(2)
    t = spark.createDataFrame(times, "id long, ts timestamp_ntz").repartition(3)
    s = spark.createDataFrame(spans, "name string, a timestamp_ntz, b timestamp_ntz")
    j = I.interval_join(t, s, "ts", "a", "b")
    want = sorted((i, n) for i, x in times for n, a, b in spans if None not in (x, a, b) and a <= x <= b)
    assert j.columns == ["id", "ts", "name", "a", "b"]
    assert sorted((r["id"], r["name"]) for r in j.collect()) == want and len(want) > 1000
    assert "NestedLoop" not in _plan(j) and "Cartesian" not in _plan(j)
    held = {r["id"]: sorted(x["name"] for x in r["held"]) for r in I.with_intervals(t, s, "ts", "a", "b", ["name"], "held").collect()}
    assert held == {i: sorted(n for j, n in want if j == i) for i, _ in times}


def test_dates_last_until_midnight_and_long_events_fit(spark):
    t = spark.createDataFrame([(1, dt.datetime(2024, 2, 29, 23, 59, 59, 999_999)), (2, dt.datetime(2024, 3, 1)), (3, dt.datetime(1999, 5, 5))], "id long, txn_ts timestamp_ntz")
    cal = spark.createDataFrame([("leap", 2, dt.date(2024, 2, 29), dt.date(2024, 2, 29)), ("era", 9, dt.date(1000, 1, 1), dt.date(2999, 1, 1))],
                                "name string, priority int, start_date date, end_date date")
    assert {r["id"]: r["regional_event"] for r in FE.tag_event(t, cal).collect()} == {1: "leap", 2: "era", 3: "era"}


@pytest.mark.parametrize("seed", [1, 2])
def test_factor_equals_a_loop(spark, seed):
    r = random.Random(seed)
    cal = [(f"e{i}", r.choice(["regional", "custom"]), START + dt.timedelta(hours=(h := r.randint(0, 900))), START + dt.timedelta(hours=h + r.randint(0, 300)), i,
            round(r.uniform(0.5, 2), 2), r.sample(["card", "ussd", "bank"], 2)) for i in range(12)]
    times = [(i, START + dt.timedelta(minutes=r.randint(0, 60_000)), r.choice(["card", "ussd", "cash", None])) for i in range(200)]
    t = spark.createDataFrame(times, "id long, txn_ts timestamp_ntz, payment_method string")
    c = spark.createDataFrame(cal, "name string, kind string, a timestamp_ntz, b timestamp_ntz, priority int, failure_factor double, affected_payment_methods array<string>")
    got = {x["id"]: x["event_factor"] for x in FE.event_factor(t, c, start="a", end="b").collect()}
    for i, x, m in times:
        on = [e for e in cal if e[2] <= x <= e[3]]
        regional = next((e[5] for e in sorted(on, key=lambda e: e[4]) if e[1] == "regional"), 1.0)
        assert got[i] == max([regional, *[e[5] for e in on if e[1] == "custom" and m in e[6]]])


def test_no_intervals(spark):
    t = spark.createDataFrame([(1, START)], "id long, ts timestamp_ntz")
    none = spark.createDataFrame([("x", None, None)], "name string, a timestamp_ntz, b timestamp_ntz")
    assert I.interval_join(t, none, "ts", "a", "b").count() == 0
    assert I.with_intervals(t, none, "ts", "a", "b", ["name"], "held").select(F.size("held")).first()[0] == 0
