"""The learners by name: estimator, default parameters and search grid."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
)

from spindlescope.ml.forests import RandomForest
from spindlescope.ml.kernels import KERNELS, KernelSVM
from spindlescope.ml.neighbour_stages import DensityClusters, IsolationForest, NearestNeighbours
from spindlescope.ml.networks import Network
from spindlescope.ml.trees import BoostedTrees, ExtraTrees


@dataclasses.dataclass(frozen=True)
class Learner:
    make: Callable[[dict, int, int], object]
    defaults: dict
    grid: dict
    seeded: bool = True


def _plain(cls, **fixed):
    def make(params: dict, width: int, rows: int):
        return cls(featuresCol="vector", labelCol="label", **fixed, **params)
    return make


def _logistic(params: dict, width: int, rows: int):
    """Strength given as C: regParam = 1 / (C * rows)."""
    rest = {k: v for k, v in params.items() if k not in ("C", "penalty")}
    penalty = params.get("penalty", "l2")
    rest["regParam"] = 0.0 if penalty == "none" else 1.0 / (params.get("C", 1.0) * max(rows, 1))
    rest["elasticNetParam"] = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5, "none": 0.0}[penalty]
    return LogisticRegression(featuresCol="vector", labelCol="label", **rest)


def _own(cls):
    """Learners of this package; they read ``vector`` and ``label`` themselves."""
    def make(params: dict, width: int, rows: int):
        return cls(**params)
    return make


def _network(params: dict, width: int, rows: int):
    rest = {k: v for k, v in params.items() if k != "hidden"}
    return MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label", layers=[width, *params["hidden"], 2], **rest)


# Default parameters and search grids, in Spark's parameter names. Depth "none" is 30,
# the largest Spark grows; minimum samples to split have no counterpart. Extra trees have no bound but their leaves.
# The leaf size of a neighbour search changes no result and is left out.
LEARNERS: dict[str, Learner] = {
    "random_forest": Learner(
        _own(RandomForest),
        {"numTrees": 1000, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt", "maxDepth": 30, "impurity": "gini", "bootstrap": True},
        {"numTrees": [1000, 2000, 3000], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["auto", "sqrt"],
         "maxDepth": [10, 20, 30], "impurity": ["gini", "entropy"], "bootstrap": [True, False]}),
    "extra_trees": Learner(
        _own(ExtraTrees), {"numTrees": 100, "maxFeatures": "auto", "bootstrap": False},
        {"numTrees": [100, 200, 300, 400, 500], "maxFeatures": ["auto", "sqrt", "log2"], "bootstrap": [True, False]}),
    "decision_tree": Learner(
        _plain(DecisionTreeClassifier),
        {"impurity": "gini", "maxDepth": 30, "minInstancesPerNode": 1},
        {"impurity": ["gini", "entropy"], "maxDepth": list(range(1, 31)), "minInstancesPerNode": [1, 2, 4]}),
    "logistic_regression": Learner(
        _logistic,
        {"penalty": "l2", "C": 1.0, "maxIter": 100},
        {"penalty": ["l1", "l2", "elasticnet", "none"], "C": [float(c) for c in np.logspace(-4, 4, 20)],
         "maxIter": [100, 1000, 2500, 5000]}, seeded=False),
    "svm": Learner(
        _own(KernelSVM), {"C": 1.0, "gamma": "scale", "kernel": "rbf"},
        {"C": [0.1, 1.0, 10.0, 100.0, 1000.0], "gamma": [1.0, 0.1, 0.01, 0.001, 0.0001], "kernel": list(KERNELS)}),
    "xgb": Learner(
        _own(BoostedTrees),
        {"stepSize": 0.1, "maxIter": 100, "maxDepth": 3, "minChildWeight": 1, "gamma": 0.1, "subsample": 1.0, "colsampleByTree": 1.0},
        {"stepSize": [0.01, 0.1, 0.2, 0.3], "maxIter": [100, 500, 1000, 1500], "maxDepth": [3, 5, 7, 9], "minChildWeight": [1, 3, 5],
         "gamma": [0.1, 0.2, 0.3, 0.4], "subsample": [0.6, 0.8, 1.0], "colsampleByTree": [0.6, 0.8, 1.0]}),
    "gradient_boosting": Learner(
        _plain(GBTClassifier),
        {"stepSize": 0.1, "maxIter": 100, "maxDepth": 3, "minInstancesPerNode": 1},
        {"maxIter": [100, 200, 300, 400, 500], "stepSize": [0.1, 0.05, 0.01], "maxDepth": [3, 4, 5, 6, 7],
         "minInstancesPerNode": [1, 2, 5, 10]}),
    "naive_bayes": Learner(_plain(NaiveBayes, modelType="gaussian"), {}, {}, seeded=False),
    "k_nearest": Learner(
        _own(NearestNeighbours), {"k": 5, "weights": "uniform", "metric": "minkowski"},
        {"k": list(range(1, 31)), "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan", "minkowski"]}, seeded=False),
    "isolation_forest": Learner(
        _own(IsolationForest), {"numTrees": 100, "maxSamples": "auto", "contamination": "auto", "maxFeatures": 1.0, "bootstrap": False},
        {"numTrees": [100, 200, 300, 400, 500], "maxSamples": ["auto", 100, 200, 300, 400, 500], "contamination": ["auto", 0.1, 0.2, 0.3, 0.4, 0.5],
         "maxFeatures": [1, 2, 3, 4, 5], "bootstrap": [True, False]}),
    "dbscan": Learner(
        _own(DensityClusters), {"eps": 0.5, "minSamples": 5},
        {"eps": [0.3, 0.5, 0.7], "minSamples": [5, 10, 15], "metric": ["euclidean", "manhattan", "chebyshev"]}, seeded=False),
    "mlp": Learner(
        _network, {"hidden": (100,), "maxIter": 200},
        {"hidden": [(50, 50, 50), (50, 100, 50), (100,)], "maxIter": [200, 500, 1000]}),
    "mlp_two_layer": Learner(_network, {"hidden": (128, 128), "maxIter": 200}, {"hidden": [(64, 64), (128, 128)], "maxIter": [200]}),
    "dense_net": Learner(_network, {"hidden": (8, 8), "maxIter": 200}, {"hidden": [(8, 8), (64, 64)], "maxIter": [200]}),
}

NETWORKS = ("mlp", "mlp_two_layer", "dense_net")
#: Learners that do not read the labels: they are judged by the silhouette of what they find, and predict 1 for outliers.
UNSUPERVISED = ("isolation_forest", "dbscan")
UNWEIGHTED = (*UNSUPERVISED, "k_nearest")


def build(name: str, params: dict | None, width: int, rows: int, seed: int, weight_col: str | None = None):
    """The estimator of a learner on ``vector``/``label``, with its defaults overlaid by ``params``.

    Networks with class weights are trained by this package, since Spark's have no weight column.
    """
    if weight_col and name in UNWEIGHTED:
        raise ValueError(f"{name} takes no class weights")
    learner = LEARNERS[name]
    chosen = {**learner.defaults, **(params or {})}
    if weight_col and name in NETWORKS:
        return Network(**{k: v for k, v in chosen.items() if k in Network.DEFAULTS}).setSeed(seed).setWeightCol(weight_col)
    model = learner.make(chosen, width, rows)
    if learner.seeded:
        model = model.setSeed(seed)
    return model.setWeightCol(weight_col) if weight_col else model
