"""Shapley values of tree ensembles, path-dependent (ML17).

A leaf's share of a row's Shapley values depends only on which features' conditions on the leaf's path the row meets: a pattern of
at most as many bits as the path has features.  So a batch of rows is compared with each path's intervals (numpy, column by
column), and the values of the patterns that occur are computed once per leaf and looked up.  A feature outside of a coalition follows
the training rows: its splits count by the share of rows (cover) that took each side.

Trees go to the workers once (bounded by the model's settings); the rows' values come back as one array column; the ranking is one
aggregation.  For every row, base value plus Shapley values is the model's output: the probability of class 1 of a Spark
forest, or the margin of ``boosting.BoostedTrees``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.operators.boosting import MISSING, BoostedTrees
from payscope.session import checkpoint_dir


@dataclass
class Path:
    """A leaf and, for each feature on the way to it, its interval (lo, hi], whether missing values pass, and the share of rows that do."""

    value: float
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    missing: np.ndarray
    share: np.ndarray


def _paths(left, right, feature, threshold, missing_left, value, cover) -> list[Path]:
    """The paths of a tree given as arrays; ``feature[i] < 0`` marks a leaf, children may be a rule or arrays."""
    out, stack = [], [(0, {})]
    while stack:
        n, seen = stack.pop()
        f = feature[n]
        if f < 0:
            cols = [np.array([s[k] for s in seen.values()]) for k in range(4)]
            out.append(Path(float(value[n]), np.array(list(seen), dtype=int), *cols))
            continue
        lo, hi, missing, share = seen.get(f, (-np.inf, np.inf, True, 1.0))
        for child, goes_left in ((left(n), True), (right(n), False)):
            part = share * cover[child] / cover[n] if cover[n] else 0.0
            now = (lo, min(hi, threshold[n]), missing and missing_left[n], part) if goes_left else (max(lo, threshold[n]), hi, missing and not missing_left[n], part)
            stack.append((child, {**seen, f: now}))
    return out


def _shares(path: Path, met: np.ndarray) -> np.ndarray:
    """Shapley values of the path's features (columns) for patterns ``met`` (rows, 0 or 1) of met conditions.

    With feature i left out, the product of (share_j + met_j t) has in its k-th coefficient the coalitions of k features.
    """
    m = len(path.features)
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty(met.shape)
    for i in range(m):
        c = np.zeros(met.shape)
        c[:, 0] = 1.0
        for j in range(m):
            if j != i:
                up = c[:, :-1] * met[:, j: j + 1]
                c *= path.share[j]
                c[:, 1:] += up
        out[:, i] = path.value * (met[:, i] - path.share[i]) * (c @ weight)
    return out


@dataclass
class TreeShap:
    """Shapley values of a sum of trees over ``n_features`` numbers a row."""

    paths: list[Path]
    n_features: int
    base: float

    @classmethod
    def of(cls, paths: list[Path], n_features: int, offset: float = 0.0) -> TreeShap:
        return cls(paths, n_features, offset + sum(p.value * float(np.prod(p.share)) for p in paths))

    def values(self, x: np.ndarray, absent: np.ndarray | None = None) -> np.ndarray:
        """(rows, features); ``absent`` marks missing values."""
        out = np.zeros((len(x), self.n_features))
        for p in self.paths:
            if not len(p.features):
                continue
            v = x[:, p.features]
            met = (v > p.lo) & (v <= p.hi)
            if absent is not None:
                met = np.where(absent[:, p.features], p.missing, met)
            code = met @ (1 << np.arange(len(p.features), dtype=np.int64))
            codes, which = np.unique(code, return_inverse=True)
            patterns = (codes[:, None] >> np.arange(len(p.features))) & 1
            out[:, p.features] += _shares(p, patterns.astype(float))[which]
        return out


def of_forest(model: RandomForestClassificationModel, spark: SparkSession) -> TreeShap:
    """Of the probability of class 1; the nodes are read from the model's saved form (bounded by trees and depth)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    paths = []
    for t in trees.values():
        row = [t[i] for i in range(len(t))]
        cover = [sum(r["impurityStats"]) for r in row]
        chance = [r["impurityStats"][1] / c / len(trees) if c else 0.0 for r, c in zip(row, cover)]
        split = [r["split"] for r in row]
        if any(r["leftChild"] >= 0 and s["numCategories"] >= 0 for r, s in zip(row, split)):
            raise ValueError("categorical splits are not supported")
        paths += _paths(lambda n: row[n]["leftChild"], lambda n: row[n]["rightChild"], [s["featureIndex"] if r["leftChild"] >= 0 else -1 for r, s in zip(row, split)],
                        [s["leftCategoriesOrThreshold"][0] if s["leftCategoriesOrThreshold"] else 0.0 for s in split], [False] * len(row), chance, cover)
    return TreeShap.of(paths, model.numFeatures)


def of_boosted(model: BoostedTrees) -> TreeShap:
    """Of the margin, over the bins of the model's features."""
    paths = []
    for t in model.trees:
        paths += _paths(lambda n: 2 * n + 1, lambda n: 2 * n + 2, t.feature, t.cut, t.missing_left, t.value, t.cover)
    return TreeShap.of(paths, len(model.features), model.base_margin)


def shap_of_vector(df: DataFrame, shap: TreeShap, vector: str = "features", out: str = "shap") -> DataFrame:
    """``df`` with the Shapley values of the ML vector column as an array."""
    shared = df.sparkSession.sparkContext.broadcast(shap)

    @F.pandas_udf("array<double>")
    def values(rows: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.values(np.stack(rows.to_list())))) if len(rows) else pd.Series([], dtype=object)

    return df.withColumn(out, values(vector_to_array(vector)))


def shap_of_columns(df: DataFrame, model: BoostedTrees, out: str = "shap") -> DataFrame:
    """``df`` with the Shapley values of a boosted model's features as an array."""
    shared = df.sparkSession.sparkContext.broadcast((model, of_boosted(model)))

    @F.pandas_udf("array<double>")
    def values(*cols: pd.Series) -> pd.Series:
        own, shap = shared.value
        bins = own.bins(np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in cols], axis=1))
        return pd.Series(list(shap.values(bins, bins == MISSING)))

    return df.withColumn(out, values(*[F.col(c).cast("double") for c in model.features]))


def ranking(df: DataFrame, names: Sequence[str], shap: str = "shap") -> DataFrame:
    """feature, mean_abs_shap, rank from one aggregation."""
    def mean(i: int) -> Column:
        return F.avg(F.abs(F.col(shap)[i])).alias(f"m{i}")
    row = df.agg(*[mean(i) for i in range(len(names))])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), X.rnd(f"m{i}").alias("mean_abs_shap")) for i, n in enumerate(names)])).alias("r")).select("r.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))
