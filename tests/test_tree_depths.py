import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import learners as ln
from spindlescope.ml import tree_depths as td
from spindlescope.ml import training as tr


def test_one_fit_per_fold_scores_all_depths_as_single_fits_do(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(400) < 0.15)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), float(c), i % 3) for i, (v, c) in enumerate(zip(x, y))], "i long, x array<double>, label double, _fold3 int")
    rows = rows.select(array_to_vector("x").alias("vector"), "label", "_fold3").repartition(2).cache()
    combos = tr._maps({"impurity": ["gini", "entropy"], "maxDepth": [1, 3, 4, 9], "minInstancesPerNode": [1, 4]})
    plain = tr._cross_validate(ln.build("decision_tree", {}, 4, 400, 42), combos, rows, 3, tr.f1_judge(), "_fold3", 4)
    fits = []
    fit = DecisionTreeClassifier._fit
    monkeypatch.setattr(DecisionTreeClassifier, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    got = td.tree_scores(rows, combos, 3, lambda c: ln.build("decision_tree", c, 4, 400, 42), 4)
    assert np.allclose(got, plain) and len(fits) == 4 * 3  # not one per depth
