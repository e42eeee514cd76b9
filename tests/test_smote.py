"""SMOTE: balance, segments between real rows, recall of neighbours, hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.operators import smote as M


def _rows(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d)) * 3
    return centres[r.integers(0, 12, n)] + r.normal(size=(n, d))


def _recall(x, got, k):
    hit = total = 0
    for i, found in got.items():
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        limit = np.sort(d)[k - 1]
        assert all(j != i and abs(d[j] - dist) < 1e-9 for dist, j in found) and len({j for _, j in found}) == len(found) <= k
        hit += sum(dist <= limit + 1e-12 for dist, _ in found)
        total += k
    return hit / total


@pytest.mark.parametrize("n, d", [(1500, 4), (4000, 10)])
def test_recall_of_neighbours(spark, n, d):
    x = _rows(n, d, 1)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(4)
    got = {r["id"]: [(p["dist"], p["id"]) for p in r["neighbours"]] for r in M.neighbours(df, "id", "x").collect()}
    assert len(got) == n and all([p[0] for p in v] == sorted(p[0] for p in v) for v in got.values())
    assert _recall(x, got, M.K) >= 0.9


def test_line_windows_equal_brute_force():
    r = np.random.default_rng(3)
    x, line = r.normal(size=(60, 3)), np.repeat([0, 1], 30)
    dist, at = M.nearest_in_line(x, line, 4, 7)
    for i in range(60):
        near = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(60) if j != i and abs(i - j) <= 7 and line[i] == line[j])[:4]
        assert sorted(at[i]) == sorted(j for _, j in near) and np.allclose(np.sort(dist[i]), [d for d, _ in near])


def test_balance_and_segments(spark):
    x = _rows(700, 3, 2)
    rows = [(f"id{i}", *[float(v) for v in r], int(i % 7 != 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, y int").repartition(3)
    out = M.smote(df, ["a", "b", "c"], "y", "id").collect()
    made = [r for r in out if r["synthetic"]]
    assert sorted(tuple(r[:5]) for r in out if not r["synthetic"]) == sorted(rows)
    assert len(made) == 600 - 100 and all(r["y"] == 0 and r["id"] is None for r in made)
    real = {r[0]: np.array(r[1:4]) for r in rows if r[4] == 0}
    per_row = {}
    for r in made:
        a, b = real[r["base_id"]], real[r["neighbour_id"]]
        assert r["base_id"] != r["neighbour_id"] and 0 <= r["share"] < 1
        assert np.allclose([r["a"], r["b"], r["c"]], a + r["share"] * (b - a))
        per_row[r["base_id"]] = per_row.get(r["base_id"], 0) + 1
    assert len(per_row) == 100 and set(per_row.values()) == {5}


def test_hot_value_fills_no_partition(spark):
    """A third of the rows are equal: range partitions stay even, and those rows have each other as neighbours."""
    x = _rows(3000, 4, 5)
    x[::3] = 1.0
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = M.neighbours(df, "id", "x", partitions=12)
    rows = {r["id"]: r["neighbours"] for r in got.collect()}
    assert all(p["dist"] == 0 for i in range(0, 3000, 3) for p in rows[i])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(line" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    keys = M.sort_keys(x, 1, 42)[0]
    spread = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key long, id long").repartitionByRange(12, "key", F.xxhash64("id"))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 3000 / 12


def test_edges(spark):
    schema = "id long, a double, b double, y int"
    for rows in ([], [(1, 1.0, 2.0, 1)], [(1, 1.0, 2.0, 1), (2, 1.0, 2.0, 0)], [(1, 1.0, 1.0, 0), (2, 1.0, 2.0, 1), (3, None, 2.0, 1)]):
        out = M.smote(spark.createDataFrame(rows, schema), ["a", "b"], "y", "id")
        assert out.count() == len(rows) and out.where("synthetic").count() == 0
    rows = [(i, None if i % 2 else 5.0, float("nan") if i == 0 else 3.0, int(i > 3)) for i in range(12)] + [(None, 1.0, 1.0, 1), (99, 1.0, 1.0, None)]
    made = M.smote(spark.createDataFrame(rows, schema), ["a", "b"], "y", "id").where("synthetic").collect()
    assert len(made) == 9 - 4 and all((r["a"], r["b"]) == (5.0, 3.0) for r in made)
    with pytest.raises(ValueError):
        M.smote(spark.createDataFrame([(i, 1.0, 1.0, i) for i in range(3)], schema), ["a", "b"], "y", "id")


def test_cross_validation_with_synthetic_rows(spark):
    from payscope.operators import ml as ML
    x = _rows(240, 2, 9)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > -3)) for i, (a, b) in enumerate(x)], "transaction_id long, a double, b double, result_numeric int")
    out = ML.cross_validate(df, {"logistic": {"maxIter": 30}}, ["a", "b"], folds=2, balance="smote").collect()
    assert [r["fold"] for r in out] == [0, 1] and sum(r["n"] for r in out) == 240 and all(r["auc"] > 0.9 for r in out)
