import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import learners as ln
from spindlescope.ml import neighbour_models as nm
from spindlescope.ml import training as tr
from test_kernels_networks import slow_silhouette


@pytest.fixture(scope="module")
def sides(spark):
    """Two dense groups and a few rows far away (class 1)."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.15, (60, 2)), rng.normal(4, 0.15, (60, 2)), rng.uniform(8, 30, (12, 2))])
    rows = [(i, v.tolist(), int(i >= 120)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>, label int").select("vec_id", array_to_vector("x").alias("vector"), "label")
    return df.filter("vec_id % 3 <> 0").cache(), df.filter("vec_id % 3 = 0").cache(), x


def test_density_clusters_through_the_runner(spark, sides):
    train, test, x = sides
    done = tr.train_and_evaluate(train, test, "dbscan", {"eps": 0.5}, keys=["vec_id"])
    assert done.metrics["recall"] == 1.0 and done.metrics["accuracy"] > 0.9 and done.cv_accuracy is None
    placed = nm.dbscan(train.select("vec_id", F.expr("vector").alias("v")).join(train.select("vec_id"), "vec_id").select(
        "vec_id", tr.vector_to_array("v").alias("vec")), 0.5, 5).toPandas()
    assert done.metrics["silhouette"] == pytest.approx(slow_silhouette(x[placed["vec_id"]], placed["cluster"].to_numpy()), abs=1e-6)


def test_search_takes_the_best_silhouette(sides):
    train, test, _ = sides
    grid = {"eps": [0.01, 0.5], "minSamples": [5]}
    done = tr.train_and_evaluate(train, test, "dbscan", None, grid, "grid", keys=["vec_id"])
    assert done.params["eps"] == 0.5


def test_isolation_forest_through_the_runner_and_back_from_disk(sides, tmp_path):
    train, test, _ = sides
    done = tr.train_and_evaluate(train, test, "isolation_forest", {"numTrees": 30, "contamination": 0.1}, keys=["vec_id"])
    assert done.metrics["recall"] > 0.7 and done.metrics["far"] < 0.2 and -1 <= done.metrics["silhouette"] <= 1
    path = str(tmp_path / "forest")
    done.model.write().save(path)
    again = PipelineModel.load(path).transform(test).select("vec_id", "prediction")
    assert again.join(done.predictions.withColumnRenamed("prediction", "p"), "vec_id").filter("p <> prediction").count() == 0
    points = train.select(F.col("vec_id").cast("string").alias("row_id"), tr.vector_to_array("vector").alias("vec"))
    same = nm.isolation_forest(points, 30, 256, 0.1, 1.0, False, 42, "row_id")
    assert done.model.stages[0].facts["threshold"] == same.threshold


def test_nearest_neighbours_take_every_metric_and_no_weights(sides):
    train, test, _ = sides
    got = [tr.train_and_evaluate(train, test, "k_nearest", {"k": 3, "metric": m}, folds=None, keys=["vec_id"]).metrics for m in ("euclidean", "minkowski", "manhattan")]
    assert got[0] == got[1] and got[2]["accuracy"] > 0.9
    with pytest.raises(ValueError):
        ln.build("k_nearest", None, 2, 10, 1, "weight")
