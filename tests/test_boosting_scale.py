"""Boosted trees of whole settings, fitted by one task or level by level over chunks of rows."""

import random

import pytest

from payscope.operators import boosting as B
from payscope.operators import ml as ML
from payscope.plans import q_ml


def _rows(spark, n=400, seed=5):
    r = random.Random(seed)
    rows = [(i if i % 40 else None, r.choice([None, 1.0, 2.0, 3.0]), round(r.uniform(0, 1), 2), float("nan") if r.random() < 0.2 else r.gauss(0, 1),
             None if i % 50 == 7 else int(r.random() < 0.3 + 0.1 * (i % 5)), r.choice([1.0, 0.5, 2.0])) for i in range(n)]
    return spark.createDataFrame(rows, f"transaction_id long, a double, b double, c double, {ML.LABEL} int, w double")


class Asked(Exception):
    pass


def _asked(monkeypatch, query):
    """The settings that a query fits."""
    seen = []
    monkeypatch.setattr(q_ml, "model_table", lambda *a: None)
    monkeypatch.setattr(ML, "split", lambda *a, **k: (None, None))

    def fit(df, params=None, *a, **k):
        seen.append(params)
        raise Asked

    monkeypatch.setattr(ML, "fit_boosted", fit)
    with pytest.raises(Asked):
        query(None, None)
    return seen


def test_boosted_trees_take_the_studied_settings(monkeypatch):
    assert _asked(monkeypatch, q_ml.q_boosted) == [B.PRESETS["base"]] and B.PRESETS["base"] == B.BoostParams(100, 6, 0.1, subsample=0.8, colsample=0.8)


def test_boosted_importances_take_the_studied_settings(monkeypatch):
    assert _asked(monkeypatch, q_ml.q_boosted_importances) == [B.PRESETS["config"]] and B.PRESETS["config"] == B.BoostParams(100, 5, 0.01, subsample=0.8, colsample=0.8)


@pytest.mark.parametrize("p", [B.BoostParams(rounds=4, max_depth=3, eta=0.3), B.BoostParams(rounds=2, max_depth=5, subsample=1.0, colsample=1.0, gamma=0.1, min_child_weight=0.0)])
def test_one_task_and_many_grow_the_same_trees(spark, monkeypatch, p):
    df = _rows(spark)
    fit = lambda: B.fit_boosted(df, ["a", "b", "c"], ML.LABEL, p, "w").to_json()
    alone = fit()
    monkeypatch.setattr(B, "FIT_ROWS", 0)
    monkeypatch.setattr(B, "CHUNK_ROWS", 60)
    monkeypatch.setattr(B, "TASK_ROWS", 75)
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    assert fit() == alone and len(B.BoostedTrees.from_json(alone).trees) == p.rounds


def test_chunks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_ROWS", 60)
    t = B._rows(_rows(spark), ["a"], ML.LABEL, "w", "transaction_id", B.F.lit(False)).repartition(3)
    found = B._chunks(t, ["a"], [[2.0, 3.0]], [B.BoostParams(rounds=2)]).collect()
    assert max(len(c["y"]) for c in found) <= 60 and sum(len(c["y"]) for c in found) == t.count()
    assert sorted(b for c in found for b in c["bins"][0].tolist()) == sorted({None: 0, 1.0: 1, 2.0: 2, 3.0: 3}[r["a"]] for r in t.collect())
    took = [sum(len(B._sample(c, k, B.BoostParams(rounds=2))) for c in found) for k in range(2)]
    want = [t.where(_uniform(k) < 0.8).count() for k in range(2)]
    assert took == want


def _uniform(k):
    from payscope.functions import expr as X
    return X.hash_uniform("id", B.F.lit(f"round {k}"), seed=42)


def test_grid_search_takes_the_studied_grid(monkeypatch):
    seen = []
    monkeypatch.setattr(q_ml, "model_table", lambda *a: None)
    monkeypatch.setattr(ML, "_search_boosted", lambda df, grid, folds, seed, features: seen.append((grid, folds)) or ML.BoostedSearch([], [], None))

    class Session:
        def createDataFrame(self, rows, schema):
            return rows

    q_ml.q_grid(Session(), None)
    (grid, folds), = seen
    assert folds == 5 and [len(v) for v in grid.values()] == [3, 3, 3, 2, 2, 3]
    assert grid == {"rounds": [50, 100, 200], "max_depth": [3, 6, 9], "eta": [0.01, 0.1, 0.2], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0], "gamma": [0, 0.1, 0.2]}


@pytest.mark.parametrize("alone", [True, False])
def test_a_search_scores_what_single_fits_score(spark, monkeypatch, alone):
    """Settings fitted side by side, and numbers of rounds scored on the way, against one fit a setting and fold."""
    df, features, grid = _rows(spark).where("transaction_id is not null").cache(), ["a", "b", "c"], {"rounds": [1, 3], "max_depth": [1, 3], "gamma": [0.0, 2.0], "subsample": [0.8, 1.0]}
    if not alone:
        monkeypatch.setattr(B, "FIT_ROWS", 0)
        monkeypatch.setattr(B, "CHUNK_ROWS", 60)
        monkeypatch.setattr(B, "TASK_ROWS", 100)
        grid = {"rounds": [1, 3], "max_depth": [2], "gamma": [0.0, 2.0]}
    got = ML.grid_search(df, grid, folds=2, features=features, kind="boosted")
    assert len(got.maps) == len(got.avgMetrics) == (16 if alone else 4)
    monkeypatch.undo()
    t = ML.add_folds(ML._labelled(df), 2).cache()
    for m, f1 in list(zip(got.maps, got.avgMetrics))[::3]:
        want = []
        for k in range(2):
            model = B.fit_boosted(t.where(B.F.col("fold") != k), features, ML.LABEL, B.replace(B.PRESETS["base"], **m), "weight")
            want.append(ML.binary_metrics(ML.predict_boosted(model, t.where(B.F.col("fold") == k)), "p", "y", pred="yhat").first()["f1"])
        assert abs(f1 - sum(want) / 2) < 1e-6
    best = got.maps[got.avgMetrics.index(max(got.avgMetrics))]
    assert got.bestModel.to_json() == B.fit_boosted(t, features, ML.LABEL, B.replace(B.PRESETS["base"], **best), "weight").to_json()


def test_a_search_of_no_rows(spark):
    got = ML.grid_search(_rows(spark).where("a > 9"), {"rounds": [1, 2]}, folds=2, features=["a"], kind="boosted")
    assert got.avgMetrics == [0.0, 0.0] and len(got.bestModel.trees) == 1
