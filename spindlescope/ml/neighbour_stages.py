"""Nearest neighbours, density clusters and isolation forests as stages, so that one runner trains, searches and reports them all."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.ml import neighbour_models as nm
from spindlescope.ml.models import ArrayEstimator, ArrayModel, option
from spindlescope.operators.neighbours import knn_join
from spindlescope.session import cut_lineage


def as_points(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, vector_to_array("vector").alias("vec"))


class IsolationModel(ArrayModel):
    """Anomaly score less the threshold: class 1 is an outlier."""

    @staticmethod
    def prepared(facts):
        trees = [tuple(np.array(a) for a in t) for t in facts["trees"]]
        return trees, float(nm._average_path(facts["sample"])) or 1.0, facts["threshold"]

    @staticmethod
    def margins(ready, x):
        trees, expected, threshold = ready
        return np.power(2.0, -nm.path_lengths(trees, x) / len(trees) / expected) - threshold


class IsolationForest(ArrayEstimator):
    """Outliers by isolation; labels are not read. A contamination other than ``auto`` sets the threshold on the training rows."""

    numTrees = option("numTrees", "trees")
    maxSamples = option("maxSamples", "rows per tree; auto: 256")
    contamination = option("contamination", "share of outliers, or auto")
    maxFeatures = option("maxFeatures", "features per tree, a share or a number")
    bootstrap = option("bootstrap", "whether a tree draws its rows with replacement")
    idCol = option("idCol", "column that names a row")
    DEFAULTS = {"numTrees": 100, "maxSamples": "auto", "contamination": "auto", "maxFeatures": 1.0, "bootstrap": False, "idCol": "row_id"}

    def _fit(self, df: DataFrame) -> IsolationModel:
        most = self.value("maxSamples")
        model = nm.isolation_forest(as_points(df, self.value("idCol")), self.value("numTrees"), 256 if most == "auto" else most, self.value("contamination"),
                                    self.value("maxFeatures"), self.value("bootstrap"), self.value("seed"), self.value("idCol"))
        return IsolationModel({"trees": [[a.tolist() for a in t] for t in model.trees], "sample": model.sample, "threshold": model.threshold})


class RowsModel(Model):
    """A model that is its training rows; they stay in the table they were written to, so it is not saved with a run."""

    numClasses = 2

    def __init__(self, rows: DataFrame, answer, placed: DataFrame | None = None):
        super().__init__()
        self.rows, self.answer, self.placed = rows, answer, placed

    def copy(self, extra=None):
        return RowsModel(self.rows, self.answer, self.placed)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.col("_p1")
        found = self.answer(self.rows, df)
        return df.join(found, "row_id").withColumns({"rawPrediction": array_to_vector(F.array(1.0 - p, p)), "prediction": F.col("_said").cast("double")}).drop("_p1", "_said")


class NearestNeighbours(ArrayEstimator):
    """Vote of the nearest training rows; ``minkowski`` has the power 2 and is the Euclidean distance."""

    k = option("k", "neighbours that vote")
    weights = option("weights", "uniform or distance")
    metric = option("metric", "euclidean, manhattan, chebyshev or minkowski")
    DEFAULTS = {"k": 5, "weights": "uniform", "metric": "euclidean"}

    def _fit(self, df: DataFrame) -> RowsModel:
        k, weights, metric = self.value("k"), self.value("weights"), self.value("metric").replace("minkowski", "euclidean")
        rows = cut_lineage(df.select("row_id", vector_to_array("vector").alias("vec"), F.col("label").cast("int").alias("label")))

        def answer(train: DataFrame, test: DataFrame) -> DataFrame:
            votes = nm.knn_classify(train, as_points(test, "row_id"), k, weights, "row_id", metric=metric)
            return votes.select("row_id", F.col("prediction").alias("_said"), F.col("p1").alias("_p1"))
        return RowsModel(rows, answer)


class DensityClusters(ArrayEstimator):
    """Density clusters of the training rows; a row is an outlier (class 1) if no core row is within ``eps``. Labels are not read."""

    eps = option("eps", "distance within which rows are neighbours")
    minSamples = option("minSamples", "neighbours of a core row, itself included")
    metric = option("metric", "euclidean, manhattan or chebyshev")
    DEFAULTS = {"eps": 0.5, "minSamples": 5, "metric": "euclidean"}

    def _fit(self, df: DataFrame) -> RowsModel:
        eps, metric = self.value("eps"), self.value("metric")
        points = cut_lineage(as_points(df, "row_id"))
        placed = cut_lineage(nm.dbscan(points, eps, self.value("minSamples"), "row_id", metric=metric))

        def answer(train: DataFrame, test: DataFrame) -> DataFrame:
            near = knn_join(as_points(test, "row_id"), train, 1, id_col="row_id", metric=metric).filter(F.col("distance") <= eps)
            out = F.col("neighbour").isNull().cast("double")
            return test.select("row_id").join(near.select("row_id", "neighbour"), "row_id", "left").select("row_id", out.alias("_said"), out.alias("_p1"))
        return RowsModel(cut_lineage(points.join(placed.filter("core").select("row_id"), "row_id")), answer, placed)


def fitted_labels(model: Model, learner: str, params: dict, train: DataFrame) -> DataFrame:
    """Training rows with the label that the unsupervised fit itself gave them: clusters with noise as -1, or outliers."""
    if learner != "dbscan":
        return model.transform(train).select("vector", F.col("prediction").cast("int").alias("prediction"))
    return train.join(model.stages[-1].placed.withColumn("prediction", F.hash("cluster")), "row_id").select("vector", "prediction")
