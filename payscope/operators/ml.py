"""Model features, training and evaluation on Spark ML (ML1-ML22, IO9-IO10).

Evaluation never brings scores to the driver: metrics are aggregations
over (score, label) counts; curves and AUC use running sums over DISTINCT
scores with the skew-safe prefix form (slices of the score range), so a
global ranking is never one task.
"""

from __future__ import annotations

import datetime as _dt
import itertools
import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import boosting as BO
from payscope.operators import windows as W
from payscope.operators.smote import smote
from payscope.session import cut_lineage, spread
from payscope.sources import schemas as S

MODEL_FEATURES = S.MODEL_FEATURES
LABEL = "result_numeric"


# -- ML2 / ML9 splits --------------------------------------------------------------------

def split(df: DataFrame, test: float = 0.2, seed: int = 42, id_col: str = "transaction_id",
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeded split by md5(id|seed) bucket: stable across runs and engines.
    ``stratify``: exactly floor((1 - test) * n_c) rows of every class go to
    train (rank by hash inside the class, skew-safe numbering)."""
    if stratify is None:
        b = X.hash_bucket(id_col, seed, 10000)
        return df.where(b >= int(test * 10000)), df.where(b < int(test * 10000))
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    t = df.withColumn("_h", h)
    t = W.row_index(t, [stratify], ["_h"], "_rk", slice_col=F.substring("_h", 1, 4))
    n = t.groupBy(stratify).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(F.col(stratify).alias("_c"), "_n")
    t = t.join(n, F.col(stratify).eqNullSafe(F.col("_c"))).drop("_c")  # a NULL class is a class of its own
    train = F.col("_rk") <= F.floor(F.col("_n") * (1 - test))
    drop = ["_h", "_rk", "_n"]
    return t.where(train).drop(*drop), t.where(~train).drop(*drop)


def add_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "transaction_id",
              label: str = LABEL) -> DataFrame:
    """Stratified fold id: rank by hash inside each class, fold = rank mod k."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|fold|{seed}")))
    t = W.row_index(df.withColumn("_h", h), [label], ["_h"], "_rk", slice_col=F.substring("_h", 1, 4))
    return t.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_h", "_rk")


# -- ML10 / ML11 / ML12 / ML13 / ML14 metrics --------------------------------------------------

def binary_metrics(scored: DataFrame, prob: str, label: str, threshold: float = 0.5,
                   keys: Sequence[str] = (), pred: str | None = None) -> DataFrame:
    """Confusion counts and accuracy / precision / recall / F1 (positive
    class 1) in ONE aggregation, per key set."""
    y = F.col(label).cast("int")
    yhat = F.col(pred).cast("int") if pred else (F.col(prob) >= threshold).cast("int")
    t = scored.where(F.col(label).isNotNull())
    g = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                             F.count_if((yhat == 1) & (y == 1)).alias("tp"), F.count_if((yhat == 1) & (y == 0)).alias("fp"),
                             F.count_if((yhat == 0) & (y == 1)).alias("fn"), F.count_if((yhat == 0) & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return g.select(*keys, "n", "tp", "fp", "fn", "tn", X.rnd((tp + tn) / F.col("n")).alias("accuracy"),
                    X.rnd(prec).alias("precision"), X.rnd(rec).alias("recall"), X.rnd(f1).alias("f1"))


def _score_counts(scored: DataFrame, prob: str, label: str, keys: Sequence[str]) -> DataFrame:
    t = scored.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    return t.groupBy(*keys, F.col(prob).cast("double").alias("score")).agg(
        F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") == 0).alias("neg"))


def _slice(score: Column) -> Column:
    return F.floor(score * W.SCORE_SLICES)


def roc_auc(scored: DataFrame, prob: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (ties count 1/2) = sum_s pos(s) (neg_below(s) + neg(s)/2)
    / (P N), from distinct-score counts and a skew-safe running sum."""
    keys = list(keys)
    c = _score_counts(scored, prob, label, keys)
    if not keys:
        c = c.withColumn("_k", F.lit(0))
    ks = keys or ["_k"]
    p = W.prefix_sums(c, ks, ["score"], {"neg": F.col("neg")}, _slice(F.col("score")))
    below = F.col("_P_neg") - F.col("neg")
    a = p.groupBy(*ks).agg((F.sum(F.col("pos") * (below + F.col("neg") * 0.5))).alias("_u"),
                           F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    out = a.select(*ks, X.rnd(F.try_divide(F.col("_u"), F.col("_p") * F.col("_n"))).alias("auc"))
    return out.drop("_k") if not keys else out


def roc_points(scored: DataFrame, prob: str, label: str) -> DataFrame:
    """ML11/ML12 curves: for every distinct score s (threshold "score >= s"):
    tpr, fpr, precision, recall.  Running sums from the top score down."""
    c = _score_counts(scored, prob, label, []).withColumn("_k", F.lit(0)).withColumn("_ns", -F.col("score"))
    p = W.prefix_sums(c, ["_k"], ["_ns"], {"tp": F.col("pos"), "fp": F.col("neg")}, _slice(F.col("_ns")))
    p = p.withColumn("_tot", c.select(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar())
    tot = F.col("_tot")
    tp, fp = F.col("_P_tp").cast("double"), F.col("_P_fp").cast("double")
    return p.select(X.rnd("score").alias("threshold"), F.col("_P_tp").cast("bigint").alias("tp"),
                    F.col("_P_fp").cast("bigint").alias("fp"), X.rnd(F.try_divide(tp, tot["P"])).alias("tpr"),
                    X.rnd(F.try_divide(fp, tot["N"])).alias("fpr"), X.rnd(tp / (tp + fp)).alias("precision"),
                    X.rnd(F.try_divide(tp, tot["P"])).alias("recall"))


THRESHOLDS = [float(x) for x in np.linspace(0.1, 0.9, 100)]


def threshold_sweep(scored: DataFrame, prob: str, label: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """ML13: F1 at each threshold (pred = score >= t) and the first argmax.
    Each distinct score is mapped to j = #thresholds <= score (exact, O(1)
    per row); counts per j (<= 101 rows) are summed from the top."""
    th = list(thresholds)
    m = len(th)
    step = (th[-1] - th[0]) / (m - 1)
    arr = F.array(*[F.lit(t) for t in th])
    s = F.col("score")
    j0 = F.least(F.greatest(F.floor((s - th[0]) / step) + 1, F.lit(0)), F.lit(m)).cast("int")
    j1 = F.when((j0 >= 1) & (s < F.element_at(arr, F.greatest(j0, F.lit(1)))), j0 - 1).otherwise(j0)
    j = F.when((j1 < m) & (s >= F.element_at(arr, F.least(j1 + 1, F.lit(m)))), j1 + 1).otherwise(j1)
    c = _score_counts(scored, prob, label, []).withColumn("j", j)
    g = c.groupBy("j").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spark = scored.sparkSession
    # thresholds plus a row i = -1 that every score clears (its tp is the
    # positive total P)
    ts = spark.createDataFrame([(-1, None)] + [(i, t) for i, t in enumerate(th)], "i int, threshold double")
    # tp(i) = sum of pos over j > i: explode each j-row to the thresholds it
    # clears (<= 101 per row, over a <= 101-row table)
    e = g.withColumn("i", F.explode(F.sequence(F.lit(-1), F.col("j") - 1)))
    agg = e.groupBy("i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    r = ts.join(agg, "i", "left").fillna(0, ["tp", "fp"])
    # P and the argmax are windows over this 101-row table: no second scan
    r = r.withColumn("P", F.max(F.when(F.col("i") == -1, F.col("tp"))).over(Window.partitionBy())) \
         .where(F.col("i") >= 0)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.try_divide(tp, F.col("P").cast("double"))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    r = r.select("i", X.rnd("threshold").alias("threshold"), X.rnd(f1).alias("f1"))
    first = F.row_number().over(Window.orderBy(F.desc("f1"), F.asc("i"))) == 1
    return r.withColumn("is_optimal", first.cast("int"))


def cost_sensitive(preds_long: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0) -> DataFrame:
    """ML14: (model, y, yhat) -> total and average cost, ranked."""
    g = preds_long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("yhat") == 1) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("yhat") == 0) & (F.col("y") == 1)).alias("fn"))
    g = g.withColumn("total_cost", X.rnd(F.col("fp") * cost_fp + F.col("fn") * cost_fn, 4))
    g = g.withColumn("avg_cost", X.rnd(F.col("total_cost") / F.col("n")))
    return g.withColumn("rank", F.rank().over(Window.orderBy("avg_cost", "model")).cast("int"))


def compare_models(preds_long: DataFrame) -> DataFrame:
    """ML20: per model accuracy/precision/recall/F1 (+ AUC), by F1."""
    m = binary_metrics(preds_long, "p", "y", keys=["model"], pred="yhat")
    a = roc_auc(preds_long, "p", "y", keys=["model"])
    return m.join(a, "model").drop("tp", "fp", "fn", "tn")


def cv_table(fold_metrics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """ML9: mean and std (ddof 0) of per-fold metrics."""
    aggs = []
    for mname in [x for x in ("accuracy", "precision", "recall", "f1", "auc") if x in fold_metrics.columns]:
        aggs += [X.rnd(F.avg(mname)).alias(f"{mname}_mean"), X.rnd(F.stddev_pop(mname)).alias(f"{mname}_std")]
    return fold_metrics.groupBy(*keys).agg(*aggs)


# -- ML1 feature pipeline and ML3-ML6 models ------------------------------------------------------

def feature_pipeline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> list:
    """Stages that impute and scale numerics (exact median; mean and ddof-0
    deviation of the imputed values, 0 -> 1), impute categoricals (most
    frequent, ties alphabetical) and one-hot them (a level not seen here ->
    all zeros), then assemble one vector.  Only numerics are scaled, so the
    one-hot part stays sparse.  The statistics of ``df`` are read in two
    aggregations and live in the stages as constants."""
    num, cats = list(numeric), list(categorical)
    med = {}
    if num:
        med = df.select(X.quantile_struct(df, {f"q{i}": (c, [0.5]) for i, c in enumerate(num)}).alias("q")).limit(1).first()
        med = {c: (med["q"][f"q{i}"][0] if med is not None else None) or 0.0 for i, c in enumerate(num)}
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c])))
    aggs = [x for c in num for x in (F.avg(filled(c)).alias(f"m_{c}"), F.stddev_pop(filled(c)).alias(f"s_{c}"))]
    st = df.agg(*aggs).first() if num else None
    made = []
    for c in num:
        z = f"coalesce(CAST(`{c}` AS DOUBLE), {float(med[c])!r}D)"
        if scale:
            z = f"({z} - {float(st[f'm_{c}'] or 0.0)!r}D) / {float(st[f's_{c}'] or 1.0)!r}D"
        made.append(f"{z} AS `{c}__num`")
    for c in cats:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), c).limit(1).first()
        mode = (str(top[0]) if top is not None else "").replace("\\", "\\\\").replace("'", "\\'")
        made.append(f"coalesce(CAST(`{c}` AS STRING), '{mode}') AS `{c}__cat`")
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(made) + " FROM __THIS__")]
    ohe = [f"{c}__ohe" for c in cats]
    if cats:
        idx = [f"{c}__idx" for c in cats]
        # "keep" puts unseen levels last, and the last level has no slot
        stages.append(StringIndexer(inputCols=[f"{c}__cat" for c in cats], outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"{c}__num" for c in num] + ohe, outputCol="features"))
    return stages


def feature_names(model: PipelineModel) -> list[str]:
    """A name for every slot of the assembled vector: numerics, then
    column=level of each one-hot."""
    levels = {}
    for st in model.stages:
        if isinstance(st, StringIndexerModel):
            levels = {c.removesuffix("__cat"): list(ls) for c, ls in zip(st.getInputCols(), st.labelsArray)}
    assembler = next(st for st in model.stages if isinstance(st, VectorAssembler))
    out = []
    for c in assembler.getInputCols():
        base = c.removesuffix("__num").removesuffix("__ohe")
        out += [f"{base}={v}" for v in levels[base]] if c.endswith("__ohe") else [base]
    return out


def with_class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Balanced row weights n / (k n_c) (AG16), from the class table: a row
    per class, broadcast, as a shuffle by class would put every row into as
    many tasks as there are classes."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    g = g.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(g), label)


def make_model(kind: str, seed: int = 42, n_features: int | None = None, **kw):
    """A classifier with balanced row weights (all but the perceptron, which
    takes none)."""
    common = dict(featuresCol="features", labelCol=LABEL)
    if kind == "logistic":
        return LogisticRegression(**common, weightCol="weight", standardization=False, maxIter=kw.get("maxIter", 1000))
    if kind == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", 10),
                                      minInstancesPerNode=kw.get("minInstancesPerNode", 2), seed=seed)
    if kind == "gbt":
        # subsample, column sample, gamma and min child weight of the studied boosted trees
        return GBTClassifier(**common, weightCol="weight", maxIter=kw.get("maxIter", 100), maxDepth=kw.get("maxDepth", 6),
                             stepSize=kw.get("stepSize", 0.1), subsamplingRate=kw.get("subsamplingRate", 0.8),
                             featureSubsetStrategy=kw.get("featureSubsetStrategy", "0.8"), minInfoGain=kw.get("minInfoGain", 0.0),
                             minInstancesPerNode=kw.get("minInstancesPerNode", 1), seed=seed)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**common, layers=[n_features, 64, 32, 16, 2], maxIter=kw.get("maxIter", 100), seed=seed)
    raise ValueError(kind)


GBT_PRESETS = {"base": dict(maxIter=100, maxDepth=6, stepSize=0.1), "slow": dict(maxIter=100, maxDepth=6, stepSize=0.05),
               "config": dict(maxIter=100, maxDepth=5, stepSize=0.01), "tuned": dict(maxIter=200, maxDepth=9, stepSize=0.01)}


#: Most bytes of node numbers that a deep forest keeps while it is fitted (of two levels, 4 bytes a row and tree each).
NODE_ID_BYTES = 8 << 30


def keep_nodes(model, rows: int, trees: int | None = None, depth: int | None = None):
    """``model``; a forest of more than five levels notes the node that each row has reached in each tree, instead of walking
    every row down from the root once a level, as long as the notes on ``rows`` rows take no more than ``NODE_ID_BYTES``.  The
    trees are the same.  ``trees``, ``depth``: of all fits that run at once, if these are not the model's own."""
    if isinstance(model, RandomForestClassifier):
        trees, depth = trees or model.getNumTrees(), depth or model.getMaxDepth()
        # the notes are read a level later only: no need to write them to the checkpoint folder every ten levels
        model.setCacheNodeIds(depth > 5 and 8 * rows * trees <= NODE_ID_BYTES).setCheckpointInterval(-1)
    return model


def _labelled(df: DataFrame) -> DataFrame:
    """Rows with a label, as double, and their balanced weight."""
    return with_class_weights(df.where(F.col(LABEL).isNotNull()).withColumn(LABEL, F.col(LABEL).cast("double")))


def _prepared(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame, int]:
    """The fitted feature stages, the rows (features, label, weight) of ``df`` dealt to the tasks that fit a model, and their number."""
    t = _labelled(df.select(LABEL, *dict.fromkeys([*features, *categorical])))
    prepared = Pipeline(stages=feature_pipeline(t, features, categorical)).fit(t)
    rows = prepared.transform(t).select("features", LABEL, "weight")
    n = rows.count()
    return prepared, spread(rows, count=n), n


def fit(df: DataFrame, kind: str = "logistic", features: Sequence[str] = MODEL_FEATURES,
        categorical: Sequence[str] = (), seed: int = 42, **kw) -> PipelineModel:
    prepared, rows, n = _prepared(df, features, categorical)
    model = keep_nodes(make_model(kind, seed, n_features=len(feature_names(prepared)), **kw), n)
    return PipelineModel(prepared.stages + [model.fit(rows)])


def predict(model: PipelineModel, df: DataFrame, name: str = "model") -> DataFrame:
    """(id, model, p, yhat, y) rows from a fitted pipeline."""
    s = model.transform(df.withColumn(LABEL, F.col(LABEL).cast("double")))
    return s.select("transaction_id", F.lit(name).alias("model"),
                    vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("yhat"),
                    F.col(LABEL).cast("int").alias("y"))


def fit_boosted(df: DataFrame, params: BO.BoostParams = BO.PRESETS["base"], features: Sequence[str] = MODEL_FEATURES) -> BO.BoostedTrees:
    """ML5 with second-order boosted trees: balanced row weights, missing values as they are (no imputing)."""
    return BO.fit_boosted(_labelled(df), features, LABEL, params, weight="weight")


def predict_boosted(model: BO.BoostedTrees, df: DataFrame, name: str = "boosted") -> DataFrame:
    """(id, model, p, yhat, y) rows, as ``predict``."""
    s = model.transform(df, "p")
    return s.select("transaction_id", F.lit(name).alias("model"), "p", (F.col("p") >= 0.5).cast("int").alias("yhat"), F.col(LABEL).cast("int").alias("y"))


# -- ML7 / ML8 search --------------------------------------------------------------------------------

def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="fMeasureByLabel",
                                             metricLabel=1.0)


def _cross_validate(df: DataFrame, model, maps: list, folds: int, seed: int, parallelism: int, features: Sequence[str]):
    """CrossValidator over stratified folds (``add_folds``), scored by F1 of class 1."""
    t = cut_lineage(add_folds(_labelled(df.select("transaction_id", LABEL, *features)), folds, seed).drop("transaction_id"))
    n = t.count()
    if isinstance(model, RandomForestClassifier):  # up to ``parallelism`` fits keep their notes at once
        trees = sorted((m.get(model.numTrees, model.getNumTrees()) for m in maps), reverse=True)[:parallelism]
        keep_nodes(model, n * (folds - 1) // folds, sum(trees), max(m.get(model.maxDepth, model.getMaxDepth()) for m in maps))
    cv = CrossValidator(estimator=Pipeline(stages=feature_pipeline(t, features) + [model]), estimatorParamMaps=maps,
                        evaluator=f1_evaluator(), numFolds=folds, foldCol="fold", seed=seed, parallelism=parallelism)
    return cv.fit(spread(t, count=n))


#: The studied search: 324 settings of boosted trees, each on five folds.
STUDIED_GRID = {"rounds": [50, 100, 200], "max_depth": [3, 6, 9], "eta": [0.01, 0.1, 0.2], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0],
                "gamma": [0.0, 0.1, 0.2]}


@dataclass
class BoostedSearch:
    """Settings, the mean F1 of class 1 of each over the folds, and the model of the best (the first of equals) on all rows."""

    maps: list[dict]
    avgMetrics: list[float]
    bestModel: BO.BoostedTrees


def _search_boosted(df: DataFrame, grid: dict, folds: int, seed: int, features: Sequence[str]) -> BoostedSearch:
    """Boosted trees of every setting of ``grid`` over stratified folds, and the best on all rows."""
    t = cut_lineage(add_folds(_labelled(df.select("transaction_id", LABEL, *features)), folds, seed))
    maps = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    settings = [replace(BO.PRESETS["base"], seed=seed, **m) for m in maps]
    f1 = [sum(x) / folds for x in BO.cross_validate(t, features, LABEL, settings, folds, "weight")]
    return BoostedSearch(maps, f1, BO.fit_boosted(t, features, LABEL, settings[int(np.argmax(f1))], "weight"))


def grid_search(df: DataFrame, grid: dict | None = None, folds: int = 5, seed: int = 42, parallelism: int = 4,
                features: Sequence[str] = MODEL_FEATURES, kind: str = "random_forest"):
    """ML7: CrossValidator over a grid; the folds are fitted in parallel on
    the executors.  ``kind="boosted"``: the second-order boosted trees, over
    the studied grid unless another is given (a ``BoostedSearch``)."""
    if kind == "boosted":
        return _search_boosted(df, grid or STUDIED_GRID, folds, seed, features)
    model = make_model(kind, seed)
    grid = grid or {"numTrees": [20, 50], "maxDepth": [5, 10]}
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(model.getParam(k), v)
    return _cross_validate(df, model, b.build(), folds, seed, parallelism, features)


def random_search(df: DataFrame, n_iter: int = 5, ranges: dict | None = None, folds: int = 5, seed: int = 42,
                  features: Sequence[str] = MODEL_FEATURES):
    """ML8: seeded random draws of GBT parameters in ranges, then CV."""
    ranges = ranges or {"maxDepth": (3, 10), "stepSize": (0.01, 0.3), "maxIter": (50, 300), "subsamplingRate": (0.6, 1.0),
                        "minInfoGain": (0.0, 0.5), "minInstancesPerNode": (1, 10)}
    rng = random.Random(seed)
    gbt = make_model("gbt", seed)
    maps = []
    for _ in range(n_iter):
        m = {}
        for k, (lo, hi) in ranges.items():
            m[gbt.getParam(k)] = rng.randint(lo, hi) if isinstance(lo, int) else rng.uniform(lo, hi)
        maps.append(m)
    return _cross_validate(df, gbt, maps, folds, seed, 4, features), maps


def cross_validate(df: DataFrame, kinds: dict[str, dict], features: Sequence[str] = MODEL_FEATURES, folds: int = 5, seed: int = 42,
                   balance: str = "weights") -> DataFrame:
    """ML9: accuracy, precision, recall, F1 and ROC AUC of every model and
    stratified fold; ``cv_table`` sums them up.  ``balance="smote"`` adds
    synthetic rows to each fold's training rows (ML15), never to the others."""
    t = cut_lineage(add_folds(df.where(F.col(LABEL).isNotNull()).select("transaction_id", LABEL, *features), folds, seed))
    out = None
    for k in range(folds):
        train = t.where(F.col("fold") != k)
        train = cut_lineage(smote(train, features, LABEL)) if balance == "smote" else train
        # the models of a fold share its prepared rows
        prepared, rows, n = _prepared(train, features)
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        for kind, how in kinds.items():
            model = keep_nodes(make_model(kind, seed, n_features=len(feature_names(prepared)), **how), n).fit(rows)
            p = predict(PipelineModel(prepared.stages + [model]), t.where(F.col("fold") == k), kind).withColumn("fold", F.lit(k))
            out = p if out is None else out.unionByName(p)
        rows.unpersist()
    if out is None:
        return None
    out = cut_lineage(out.select("model", "fold", "p", "yhat", "y"))  # every row is scored once, for all metrics
    keys = ["model", "fold"]
    m = binary_metrics(out, "p", "y", pred="yhat", keys=keys).join(roc_auc(out, "p", "y", keys), keys)
    return m.select(*[c for c in m.columns if c != "fold"], "fold")


# -- ML16-ML19 feature selection ---------------------------------------------------------------------

def importances(model: PipelineModel) -> DataFrame:
    """ML16: tree importances (or |coef| for LR) of every slot of the model's
    vector as a ranked DataFrame."""
    m = model.stages[-1]
    vals = m.featureImportances.toArray() if hasattr(m, "featureImportances") else np.abs(m.coefficients.toArray())
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(feature_names(model), vals, strict=True)]
    d = spark.createDataFrame(rows, "feature string, importance double")
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                           seed: int = 42) -> DataFrame:
    """ML17: F1 drop when one column is permuted.  The permutation pairs row
    r (by id order) with row r of a hash order: two skew-safe numberings and
    one equi-join on the row number per feature."""
    base = binary_metrics(predict(model, df), "p", "y", pred="yhat").select("f1").scalar()
    keyed = W.row_index(df.withColumn("_h0", F.md5(F.col("transaction_id").cast("string"))), [], ["_h0"], "_r",
                        slice_col=F.substring("_h0", 1, 4))
    out = []
    for f in features:
        h = F.md5(F.concat(F.col("transaction_id").cast("string"), F.lit(f"|{f}|{seed}")))
        donor = W.row_index(df.select("transaction_id", f).withColumn("_h", h), [], ["_h"], "_r",
                            slice_col=F.substring("_h", 1, 4)).select("_r", F.col(f).alias("_v"))
        perm = keyed.join(donor, "_r").withColumn(f, F.col("_v")).drop("_v", "_r", "_h0")
        m = binary_metrics(predict(model, perm), "p", "y", pred="yhat").select(
            F.lit(f).alias("feature"), X.rnd(base - F.col("f1")).alias("f1_drop"))
        out.append(m)
    res = out[0]
    for m in out[1:]:
        res = res.unionByName(m)
    return res


def rfe(df: DataFrame, features: Sequence[str] = MODEL_FEATURES, keep: int = 5) -> list[str]:
    """ML18: drop the feature with the smallest |coefficient| of a logistic
    model on standardised inputs until ``keep`` remain (a driver loop of
    distributed fits)."""
    cur = list(features)
    if len(cur) <= keep:
        return cur
    t = _labelled(df.select(LABEL, *cur))
    # a column is imputed and scaled by its own values, so all rounds share the prepared columns
    made, *_ = feature_pipeline(t, cur)
    rows = spread(made.transform(t).select(LABEL, "weight", *[f"{c}__num" for c in cur])).persist(StorageLevel.MEMORY_AND_DISK)
    while len(cur) > keep:
        x = VectorAssembler(inputCols=[f"{c}__num" for c in cur], outputCol="features").transform(rows)
        coef = np.abs(make_model("logistic").fit(x.select("features", LABEL, "weight")).coefficients.toArray())
        cur.pop(int(np.argmin(coef)))
    rows.unpersist()
    return cur


def select_features(df: DataFrame, method: str = "importance", k: int = 5, target: str = LABEL,
                    features: Sequence[str] = MODEL_FEATURES) -> list[str]:
    """ML19 dispatch: importance / rfe / correlation, top k."""
    if method == "importance":
        imp = importances(fit(df, "random_forest", features))
        return [r[0] for r in imp.where(F.col("rank") <= k).orderBy("rank").select("feature").collect()]
    if method == "rfe":
        return rfe(df, features, k)
    if method == "correlation":
        from payscope.operators.reports import corr_with_target
        c = corr_with_target(df, features, target)
        return [r[0] for r in c.orderBy(F.desc(F.abs("corr")), "feature").limit(k).collect()]
    raise ValueError(method)


# -- ML21 / ML22 / IO9 / IO10 -----------------------------------------------------------------------------

def save_model(model: PipelineModel, root: str, metrics: dict, version: str | None = None) -> str:
    """IO9: versioned copy + 'latest' copy + metrics JSON next to them."""
    version = version or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S")
    spark = SparkSession.getActiveSession()
    for name in (f"model_{version}", "model_latest"):
        model.write().overwrite().save(f"{root}/{name}")
    spark.createDataFrame([(version, json.dumps(metrics))], "version string, metrics string") \
         .coalesce(1).write.mode("overwrite").json(f"{root}/metrics_{version}")
    return version


def load_model(root: str, version: str = "latest") -> PipelineModel:
    """IO10."""
    return PipelineModel.load(f"{root}/model_{version}")


def retrain(train: DataFrame, feedback: DataFrame, kind: str = "gbt", seed: int = 42, **kw):
    """ML21: union training rows and labelled feedback (T10 rename),
    split 80/20, fit, evaluate.  Returns (model, metrics row DataFrame)."""
    fb = feedback.withColumnRenamed("actual_success", LABEL).withColumn(LABEL, F.col(LABEL).cast("int"))
    allrows = train.unionByName(fb, allowMissingColumns=True)
    tr, te = split(allrows, 0.2, seed)
    model = fit(tr, kind, seed=seed, **kw)
    return model, binary_metrics(predict(model, te, kind), "p", "y", pred="yhat")


def score_batch(model: PipelineModel, df: DataFrame, version: str = "1.0.0") -> DataFrame:
    """ML22 / F3: id, success probability, action, time, model version."""
    s = model.transform(df)
    p = vector_to_array("probability")[1]
    return s.select(F.col("transaction_id").cast("string").alias("transaction_id"), p.alias("success_probability"),
                    X.action(p).alias("recommended_action"),
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("prediction_time"),
                    F.lit(version).alias("model_version"))
