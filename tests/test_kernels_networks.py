import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import kernels as kn
from spindlescope.ml import metrics as mt
from spindlescope.ml import networks as nw
from spindlescope.ml import training as tr
from spindlescope.ml.passes import stored_rows


def frame(spark, x, y, w=None):
    rows = [(i, v.tolist(), int(c), float(1 if w is None else w[i])) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "vec_id long, x array<double>, label int, wt double").select("vec_id", array_to_vector("x").alias("vector"), "label", "wt").repartition(3)


@pytest.fixture(scope="module")
def circle():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (400, 2))
    return x, (np.hypot(*x.T) < 0.75).astype(int)


def test_maps_give_the_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 9))
    z, gamma = x @ x.T, 1 / (9 * x.var())
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    for kernel, exact, extra in (("rbf", np.exp(-gamma * square), {}), ("poly", (gamma * z + 0.5) ** 2, {"degree": 2, "coef0": 0.5}), ("poly", (gamma * z) ** 3, {}),
                                 ("sigmoid", np.tanh(gamma * z), {}), ("linear", z, {})):
        m = kn.mapped(x, kernel, gamma, features=8192, **extra)
        off = np.abs((m * kn.signs(kernel, 9, 8192)) @ m.T - exact)
        small = np.abs(gamma * z) <= 1
        length = gamma * np.sqrt(np.outer(np.diag(z), np.diag(z))) + extra.get("coef0", 0.0)
        size = np.maximum(1.0, length ** {"poly": extra.get("degree", 3), "sigmoid": 5}.get(kernel, 0))
        assert (off / size)[small].mean() < 0.03 and (off / size)[small].max() < 0.15, kernel
        assert (m == kn.mapped(x[:60], kernel, gamma, features=8192, **extra)).all()
    sketch = np.mean([(kn.power_sketch(x[:1], 3, 64, s) * kn.power_sketch(x[1:2], 3, 64, s)).sum() for s in range(400)])
    assert abs(sketch - z[0, 1] ** 3) < 0.25 * np.abs(np.linalg.norm(x[0]) * np.linalg.norm(x[1])) ** 3
    for bad in ({"kernel": "sigmoid", "coef0": 1.0}, {"kernel": "poly", "coef0": -1.0}, {"kernel": "cubic"}):
        with pytest.raises(ValueError):
            kn.mapped(x, gamma=1.0, **bad)


def test_gamma_from_the_data(spark, circle):
    rows = stored_rows(frame(spark, *circle))
    assert kn.scale_gamma(rows) == pytest.approx(1 / (2 * circle[0].var()))
    assert kn.scale_gamma(rows.limit(0)) == 1.0


def test_a_circle_needs_a_kernel(spark, circle):
    df = frame(spark, *circle)
    train, test = df.filter("vec_id < 300"), df.filter("vec_id >= 300")
    got = {k: tr.train_and_evaluate(train, test, "svm", {"kernel": k, "C": 10.0, "features": 512}, folds=None, keys=["vec_id"]).metrics["accuracy"] for k in ("linear", "rbf")}
    assert got["rbf"] > 0.93 > 0.75 > got["linear"]


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    layers = [4, 6, 3, 1]
    flat = nw.initial(layers, 3) + 0.1 * rng.normal(size=len(nw.initial(layers, 3)))
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), rng.uniform(0.2, 2, 30)
    s = nw.weighted_gradient(flat, layers, x, y, w)
    assert s[1] == pytest.approx(w.sum())
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (nw.weighted_gradient(flat + t, layers, x, y, w)[0] for t in (step, -step))
        assert (up - down) / 2e-6 == pytest.approx(s[2 + i], abs=1e-4)


def test_weight_two_is_a_row_twice(spark, circle):
    x, y = circle[0][:120], circle[1][:120]
    w = np.where(np.arange(120) < 30, 2.0, 1.0)
    twice = np.r_[np.arange(120), np.arange(30)]
    est = nw.Network(hidden=(5,), maxIter=15)
    a, b = est.copy().setWeightCol("wt").fit(frame(spark, x, y, w)), est.fit(frame(spark, x[twice], y[twice]))
    assert np.allclose(a.margins(a.prepared(a.facts), x), b.margins(b.prepared(b.facts), x), atol=1e-6)


def test_networks_learn_and_weights_shift_them(spark, circle):
    df = frame(spark, *circle)
    train, test = df.filter("vec_id < 300"), df.filter("vec_id >= 300")
    got = [tr.train_and_evaluate(train, test, "mlp", {"hidden": (24,), "maxIter": 150}, folds=None, keys=["vec_id"], weights=w).metrics for w in ({0: 1.0, 1: 1.0}, {0: 0.1, 1: 1.9})]
    assert got[0]["accuracy"] > 0.9 and got[1]["recall"] >= got[0]["recall"] and got[1]["far"] >= got[0]["far"]


def slow_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("d,tile", [(2, 1000), (3, 7), (12, 20)])
def test_silhouette_equals_all_distances(spark, d, tile):
    rng = np.random.default_rng(d)
    labels = rng.integers(-1, 3, 90)
    x = rng.normal(size=(90, d)) + labels[:, None] * 1.5
    x[40:70], labels[40:70] = x[0], labels[0]  # a third of the rows is one row
    labels[5] = 9  # alone
    rows = [(v.tolist(), int(c)) for v, c in zip(x, labels)] + [(None, 1), (x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "vector array<double>, prediction int")
    got = mt.euclidean_silhouette(df, tile=tile).first()
    assert got["records"] == 90 and got["silhouette"] == pytest.approx(slow_silhouette(x, labels), abs=1e-6)


def test_silhouette_of_one_cluster_and_of_equal_rows(spark):
    schema = "vector array<double>, prediction int"
    assert tuple(mt.euclidean_silhouette(spark.createDataFrame([([1.0], 0), ([2.0], 0)], schema)).first()) == (2, None)
    assert tuple(mt.euclidean_silhouette(spark.createDataFrame([([1.0], 0)] * 2 + [([1.0], 1)] * 2, schema)).first()) == (4, 0.0)
    assert mt.euclidean_silhouette(spark.createDataFrame([], schema)).first()["records"] == 0


def test_silhouette_shuffles_no_sums_of_clusters(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(v.tolist(), i % 40) for i, v in enumerate(rng.normal(size=(400, 2)))], "vector array<double>, prediction int")
    sides = [mt._Sides([(np.array([[0.0], [1.0]]), np.array([0, 1]), np.array([1, 2]))])]
    sides[0].meet(np.array([[0.0], [1.0], [5.0]]), np.array([0, 1, 2]), np.array([1, 2, 1]))
    got = sides[0].batch().to_pydict()
    assert got == {"copies": [1, 2], "n": [1, 2], "total": [0.0, 0.0], "b": [1.0, 1.0]}
    plan = mt.euclidean_silhouette(df, tile=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapCoGroups" not in plan


def test_density_clusters_are_found_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector
    from spindlescope.ml import neighbour_stages as ns
    calls, real = [], ns.nm.dbscan

    def counted(*args, **kw):
        calls.append(1)
        return real(*args, **kw)
    monkeypatch.setattr(ns.nm, "dbscan", counted)
    rows = spark.createDataFrame([(str(i), [i % 10 / 100.0 + (i >= 20), 0.0]) for i in range(41)], "row_id string, v array<double>").select("row_id", array_to_vector("v").alias("vector"))
    model = Pipeline(stages=[ns.DensityClusters(eps=0.15)]).fit(rows)
    labels = ns.fitted_labels(model, "dbscan", {"eps": 0.15}, rows)
    assert labels.count() == 41 and labels.select("prediction").distinct().count() == 2 and len(calls) == 1
