"""ML queries (ML1-ML22, IO9-IO10).  Metrics over logged scores have oracle
SQL; fitted models are checked by their own tests (rows-only here)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators import boosting as BO
from payscope.operators import features as FE
from payscope.operators import ml as ML
from payscope.operators import shap as SH
from payscope.operators import smote as SM
from payscope.plans.registry import FEEDBACK_CTE, OK, register, txn_sql
from payscope.session import checkpoint_dir, cut_lineage, spread
from payscope.sources import views as V

HASH_10K = "CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|42'), 1, 7))::BIGINT % 10000 AS INTEGER)"



_MODEL_TABLES: dict[tuple[str, str], DataFrame] = {}


def model_table(spark, d):
    """The feature table with the ten model columns, written once per application and data folder and shared by the model queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODEL_TABLES:
        wanted = ["transaction_id", "txn_ts", "payment_amount", "payment_method", "device_type", "network_latency", "amount_log",
                  "merchant_success_rate", ML.LABEL]
        t = FE.features(V.transactions(spark, d), columns=list(dict.fromkeys(wanted + ML.MODEL_FEATURES)))
        _MODEL_TABLES[key] = cut_lineage(spread(t))
    return _MODEL_TABLES[key]


def _fb(spark, d):
    return V.feedback(spark, d)


# ---- ML2 / ML9 splits ----------------------------------------------------------------

@register("ml_split_counts", txn_sql(f"""
SELECT CASE WHEN {HASH_10K} >= 2000 THEN 'train' ELSE 'test' END AS split, CAST({OK} AS INTEGER) AS label, count(*) AS n
FROM transactions GROUP BY 1, 2"""))
def q_split(spark, d):
    t = V.transactions(spark, d).withColumn("label", X.is_success("result"))
    tr, te = ML.split(t)
    return (tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
            .groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))


@register("ml_stratified_split_counts", txn_sql(f"""
SELECT label, 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM (SELECT {OK} AS label FROM transactions) s GROUP BY 1
UNION ALL
SELECT label, 'test', CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) FROM (SELECT {OK} AS label FROM transactions) s GROUP BY 1"""))
def q_strat(spark, d):
    t = V.transactions(spark, d).withColumn("label", X.is_success("result"))
    tr, te = ML.split(t, 0.2, stratify="label")
    return (tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
            .groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")))


@register("ml_fold_counts", txn_sql(f"""
SELECT fold, result_numeric, count(*) AS n FROM (
  SELECT CAST((row_number() OVER (PARTITION BY result_numeric ORDER BY md5(CAST(transaction_id AS VARCHAR) || '|fold|42')) - 1) % 5
              AS INTEGER) AS fold, result_numeric FROM (SELECT *, {OK} AS result_numeric FROM transactions) s) f
GROUP BY 1, 2"""))
def q_folds(spark, d):
    t = ML.add_folds(V.transactions(spark, d).withColumn("result_numeric", X.is_success("result")))
    return t.groupBy("fold", "result_numeric").agg(F.count(F.lit(1)).alias("n"))


# ---- ML10-ML14, ML20 on logged scores -----------------------------------------------------

_FS = """fs AS (SELECT transaction_id, prediction_probability AS p, CAST(actual_success AS INTEGER) AS y,
   CASE WHEN prediction_probability >= 0.5 THEN 1 ELSE 0 END AS yhat FROM feedback)"""


@register("ml_confusion_feedback", txn_sql("""
SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM (SELECT count(*) AS n, count(CASE WHEN yhat = 1 AND y = 1 THEN 1 END) AS tp,
             count(CASE WHEN yhat = 1 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN yhat = 0 AND y = 1 THEN 1 END) AS fn,
             count(CASE WHEN yhat = 0 AND y = 0 THEN 1 END) AS tn FROM fs) c""", FEEDBACK_CTE, _FS))
def q_confusion(spark, d):
    return ML.binary_metrics(_fb(spark, d), "prediction_probability", "actual_success")


@register("ml_roc_auc_feedback", txn_sql("""
SELECT round(sum(pos * (nb - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM
  (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nb FROM
    (SELECT p AS score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
     FROM fs GROUP BY 1) c) w""", FEEDBACK_CTE, _FS))
def q_auc(spark, d):
    return ML.roc_auc(_fb(spark, d), "prediction_probability", "actual_success")


@register("ml_roc_pr_curve_feedback", txn_sql("""
SELECT round(score, 6) AS threshold, CAST(tpc AS BIGINT) AS tp, CAST(fpc AS BIGINT) AS fp,
       round(tpc / P, 6) AS tpr, round(fpc / N, 6) AS fpr, round(tpc / (tpc + fpc), 6) AS precision, round(tpc / P, 6) AS recall
FROM (SELECT score, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc, sum(pos) OVER () AS P, sum(neg) OVER () AS N
      FROM (SELECT p AS score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
            FROM fs GROUP BY 1) c
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x""", FEEDBACK_CTE, _FS))
def q_curve(spark, d):
    return ML.roc_points(_fb(spark, d), "prediction_probability", "actual_success")


_TH_LIST = "[" + ", ".join(repr(t) for t in ML.THRESHOLDS) + "]"


@register("ml_threshold_sweep", txn_sql(f"""
SELECT CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, round(f1, 6) AS f1,
       CAST(i = (SELECT i FROM sw ORDER BY round(f1, 6) DESC, i LIMIT 1) AS INTEGER) AS is_optimal FROM sw""",
    FEEDBACK_CTE, _FS,
    f"""th AS (SELECT generate_subscripts(l, 1) - 1 AS i, unnest(l) AS threshold FROM (SELECT {_TH_LIST} AS l) x)""",
    """sw AS (SELECT i, threshold,
       CASE WHEN tp + fp > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / P) / ((tp / (tp + fp)) + (tp / P)) ELSE 0.0 END AS f1
     FROM (SELECT i, threshold, CAST(count(CASE WHEN p >= threshold AND y = 1 THEN 1 END) AS DOUBLE) AS tp,
                  CAST(count(CASE WHEN p >= threshold AND y = 0 THEN 1 END) AS DOUBLE) AS fp,
                  (SELECT count(*) FROM fs WHERE y = 1) AS P
           FROM th, fs GROUP BY i, threshold) c)"""))
def q_sweep(spark, d):
    return ML.threshold_sweep(_fb(spark, d), "prediction_probability", "actual_success")


def _two_models(spark, d):
    t = V.transactions(spark, d).select("transaction_id", X.is_success("result").alias("y"), "network_latency",
                                        "payment_amount")
    a = t.select("transaction_id", F.lit("latency_model").alias("model"),
                 (F.lit(0.98) - 0.003 * F.coalesce("network_latency", F.lit(100.0))).alias("p"), "y")
    b = t.select("transaction_id", F.lit("amount_model").alias("model"),
                 X.clip01(F.lit(1.0) - F.col("payment_amount") / 3000.0).alias("p"), "y")
    u = a.unionByName(b)
    return u.withColumn("yhat", (F.col("p") >= 0.5).cast("int"))


_PL = f"""pl AS (SELECT transaction_id, 'latency_model' AS model, 0.98 - 0.003 * coalesce(network_latency, 100.0) AS p,
    {OK} AS y FROM transactions
  UNION ALL SELECT transaction_id, 'amount_model', least(greatest(1.0 - payment_amount / 3000.0, 0.0), 1.0), {OK} FROM transactions),
pl2 AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM pl)"""


@register("ml_cost_sensitive", txn_sql("""
SELECT model, n, fp, fn, round(fp * 1.0 + fn * 5.0, 4) AS total_cost, round(round(fp * 1.0 + fn * 5.0, 4) / n, 6) AS avg_cost,
       CAST(rank() OVER (ORDER BY round(round(fp * 1.0 + fn * 5.0, 4) / n, 6), model) AS INTEGER) AS rank
FROM (SELECT model, count(*) AS n, count(CASE WHEN yhat = 1 AND y = 0 THEN 1 END) AS fp,
             count(CASE WHEN yhat = 0 AND y = 1 THEN 1 END) AS fn FROM pl2 GROUP BY 1) g""", _PL))
def q_cost_sens(spark, d):
    return ML.cost_sensitive(_two_models(spark, d))


@register("ml_compare_models", txn_sql("""
SELECT m.model, n, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, auc
FROM (SELECT model, count(*) AS n, count(CASE WHEN yhat = 1 AND y = 1 THEN 1 END) AS tp,
             count(CASE WHEN yhat = 1 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN yhat = 0 AND y = 1 THEN 1 END) AS fn,
             count(CASE WHEN yhat = 0 AND y = 0 THEN 1 END) AS tn FROM pl2 GROUP BY 1) m
JOIN (SELECT model, round(sum(pos * (nb - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM
       (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nb
        FROM (SELECT model, p AS score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
              FROM pl2 GROUP BY 1, 2) c) w GROUP BY model) a ON m.model = a.model""", _PL))
def q_compare_models(spark, d):
    return ML.compare_models(_two_models(spark, d))


# ---- fitted models (rows-only) -----------------------------------------------------------------

def _fit_eval(spark, d, kind, **kw):
    t = model_table(spark, d)
    tr, te = ML.split(t)
    m = ML.fit(tr, kind, **kw)
    p = ML.predict(m, te, kind)
    return ML.binary_metrics(p, "p", "y", pred="yhat", keys=["model"]).join(ML.roc_auc(p, "p", "y", ["model"]), "model")


@register("ml_logistic_regression")
def q_lr(spark, d):
    return _fit_eval(spark, d, "logistic")


@register("ml_random_forest")
def q_rf(spark, d):
    return _fit_eval(spark, d, "random_forest")


@register("ml_gradient_boosting")
def q_gbt(spark, d):
    return _fit_eval(spark, d, "gbt", **ML.GBT_PRESETS["base"])


@register("ml_boosted_trees")
def q_boosted(spark, d):
    """Second-order boosting on all model columns with the studied settings."""
    tr, te = ML.split(model_table(spark, d))
    p = ML.predict_boosted(ML.fit_boosted(tr, BO.PRESETS["base"]), te, "boosted")
    return ML.binary_metrics(p, "p", "y", pred="yhat", keys=["model"]).join(ML.roc_auc(p, "p", "y", ["model"]), "model")


@register("ml_boosted_importances")
def q_boosted_importances(spark, d):
    """Gain shares of the studied configuration's model."""
    model = ML.fit_boosted(model_table(spark, d), BO.PRESETS["config"])
    return spark.createDataFrame([(k, v) for k, v in model.importances().items()], "feature string, gain_share double")


@register("ml_smote")
def q_smote(spark, d):
    """The synthetic rows that balance the training classes, on all model columns."""
    made = SM.smote(model_table(spark, d), ML.MODEL_FEATURES).where("synthetic")
    return made.select("base_id", "neighbour_id", "share", ML.LABEL, *ML.MODEL_FEATURES)


@register("ml_smote_counts", txn_sql("""
SELECT result_numeric, false AS synthetic, n FROM c
UNION ALL SELECT result_numeric, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""",
                                     f"c AS (SELECT {OK} AS result_numeric, count(*) AS n FROM transactions WHERE {OK} IS NOT NULL GROUP BY 1)"))
def q_smote_counts(spark, d):
    t = SM.smote(model_table(spark, d), ML.MODEL_FEATURES).where(F.col(ML.LABEL).isNotNull())
    return t.groupBy(ML.LABEL, "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("ml_mlp")
def q_mlp(spark, d):
    return _fit_eval(spark, d, "mlp")


@register("ml_grid_search")
def q_grid(spark, d):
    """The studied search: 324 settings of boosted trees over five folds."""
    cv = ML.grid_search(model_table(spark, d), ML.STUDIED_GRID, features=ML.MODEL_FEATURES, kind="boosted")
    rows = [(str(m), float(f1)) for m, f1 in zip(cv.maps, cv.avgMetrics)]
    return spark.createDataFrame(rows, "params string, f1 double")


@register("ml_random_search")
def q_random(spark, d):
    t = model_table(spark, d)
    cv, maps = ML.random_search(t, n_iter=3, folds=3, features=ML.MODEL_FEATURES,
                                ranges={"maxDepth": (3, 6), "stepSize": (0.05, 0.3), "maxIter": (10, 20), "minInfoGain": (0.0, 0.5)})
    rows = [(str({p.name: v for p, v in pm.items()}), float(m)) for pm, m in zip(maps, cv.avgMetrics)]
    return spark.createDataFrame(rows, "params string, f1 double")


@register("ml_cv_table")
def q_cv(spark, d):
    return ML.cv_table(ML.cross_validate(model_table(spark, d), {"logistic": {}, "random_forest": {"numTrees": 20}}, ML.MODEL_FEATURES))


@register("ml_importances")
def q_imp(spark, d):
    t = model_table(spark, d)
    return ML.importances(ML.fit(t, "random_forest", ML.MODEL_FEATURES))


@register("ml_permutation_importance")
def q_perm(spark, d):
    t = model_table(spark, d)
    tr, te = ML.split(t)
    m = ML.fit(tr, "random_forest", ML.MODEL_FEATURES)
    return ML.permutation_importance(m, te, ML.MODEL_FEATURES)


@register("ml_shap_ranking")
def q_shap(spark, d):
    """Mean absolute Shapley value of each model column, of a forest of 20 trees of depth 5 on the rows kept for testing."""
    tr, te = ML.split(model_table(spark, d))
    m = ML.fit(tr, "random_forest", numTrees=20, maxDepth=5)
    prepared = PipelineModel(m.stages[:-1]).transform(te)
    return SH.ranking(SH.shap_of_vector(prepared, SH.of_forest(m.stages[-1], spark)), ML.feature_names(m))


@register("ml_rfe")
def q_rfe(spark, d):
    t = model_table(spark, d)
    keep = ML.rfe(t, ML.MODEL_FEATURES, keep=5)
    return spark.createDataFrame([(f,) for f in keep], "feature string")


@register("ml_select_features")
def q_select(spark, d):
    t = model_table(spark, d)
    a = ML.select_features(t, "correlation", 4, features=ML.MODEL_FEATURES)
    b = ML.select_features(t, "importance", 4, features=ML.MODEL_FEATURES)
    from payscope.operators.reports import feature_intersection_or_union
    da = spark.createDataFrame([(f, i + 1) for i, f in enumerate(a)], "feature string, rank int")
    db = spark.createDataFrame([(f, i + 1) for i, f in enumerate(b)], "feature string, rank int")
    return feature_intersection_or_union(da, db, min_size=3, top=4)


@register("ml_feature_pipeline")
def q_pipeline(spark, d):
    from pyspark.ml import Pipeline
    t = model_table(spark, d)
    stages = ML.feature_pipeline(t, ["network_latency", "payment_amount"], ["payment_method", "device_type"])
    out = Pipeline(stages=stages).fit(t).transform(t)
    from pyspark.ml.functions import vector_to_array
    return out.select("transaction_id", F.size(vector_to_array("features")).alias("n_features"))


@register("ml_retrain_and_score")
def q_retrain(spark, d):
    t = model_table(spark, d)
    train, newer = ML.split(t, 0.2, seed=7)
    fb = newer.drop("result_numeric").join(
        V.feedback(spark, d).select("transaction_id", "actual_success"), "transaction_id")
    model, metrics = ML.retrain(train, fb, "logistic", features=ML.MODEL_FEATURES)
    root = f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    v = ML.save_model(model, root, {"f1": metrics.select("f1").first()[0]}, version="test")
    loaded = ML.load_model(root, "latest")
    return ML.score_batch(loaded, t, version=v).select("transaction_id", "success_probability", "recommended_action",
                                                       "model_version")


@register("features_model_input")
def q_model_input(spark, d):
    """The F9 model input columns from the full feature table."""
    return FE.features(V.transactions(spark, d)).select("transaction_id", *ML.MODEL_FEATURES)
