"""Shapley values: sums on every row, brute force over all coalitions, a forest and boosted trees with missing values."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from payscope.operators import boosting as B
from payscope.operators import shap as SH

NAMES = ["a", "b", "c", "d"]


def _expected(tree, row, known, node=0):
    """Value of a boosted tree when only the features ``known`` of the row are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        goes_left = tree.missing_left[node] if row[f] == B.MISSING else row[f] <= tree.cut[node]
        return _expected(tree, row, known, left if goes_left else right)
    return sum(tree.cover[c] / tree.cover[node] * _expected(tree, row, known, c) for c in (left, right))


def _shapley(model, row):
    worth = lambda s: sum(_expected(t, row, s) for t in model.trees)
    n, out = len(row), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * (worth({*s, i}) - worth(set(s))) for k in range(n) for s in combinations(rest, k)))
    return out


def _data(spark, n, missing):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 1.2)
    rows = [(i, *[None if missing and r.random() < 0.15 else float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "transaction_id long, a double, b double, c double, d double, y int")


def test_boosted_values_equal_all_coalitions(spark):
    df = _data(spark, 400, missing=True)
    model = B.fit_boosted(df, NAMES, "y", B.BoostParams(rounds=3, max_depth=4, eta=0.3, max_bins=8, subsample=1.0, colsample=1.0))
    got = SH.shap_of_columns(df, model).collect()
    x = np.array([[np.nan if r[n] is None else r[n] for n in NAMES] for r in got])
    bins, values, base = model.bins(x), np.array([r["shap"] for r in got]), SH.of_boosted(model).base
    assert np.allclose(base + values.sum(axis=1), model.margins(x))
    for i in range(0, 400, 37):
        assert np.allclose(values[i], _shapley(model, bins[i]))


def test_forest_values_sum_to_the_probability(spark):
    df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(_data(spark, 500, missing=False))
    model = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=7, maxDepth=5, seed=3).fit(df)
    shap = SH.of_forest(model, spark)
    out = SH.shap_of_vector(model.transform(df), shap).select("shap", vector_to_array("probability")[1].alias("p")).collect()
    assert all(abs(shap.base + sum(r["shap"]) - r["p"]) < 1e-9 for r in out)
    rank = SH.ranking(SH.shap_of_vector(df, shap), NAMES).collect()
    assert [r["rank"] for r in rank] == [1, 2, 3, 4] and {rank[0]["feature"], rank[1]["feature"]} == {"a", "b"} and rank[3]["feature"] == "d"
    assert abs(rank[0]["mean_abs_shap"] - np.mean([abs(r["shap"][NAMES.index(rank[0]["feature"])]) for r in out])) < 1e-6


def test_trees_without_a_cut(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0, i % 2) for i in range(10)], "transaction_id long, a double, b double, c double, d double, y int")
    model = B.fit_boosted(df, NAMES, "y", B.BoostParams(rounds=2, max_depth=2))
    assert SH.shap_of_columns(df, model).select(F.sum(F.aggregate("shap", F.lit(0.0), lambda s, v: s + F.abs(v)))).first()[0] == 0
