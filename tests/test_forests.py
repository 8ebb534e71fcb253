import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import forests as fo
from spindlescope.ml import trees as fr


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(300) < 0.1)).astype(int)
    made = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, x array<double>, label int")
    return x, y, made.select("row_id", array_to_vector("x").alias("vector"), "label").repartition(3).cache()


def slow_tree(x, y, least, depth):
    """Every cut at every value, by the purity of both sides."""
    if depth == 0 or y.min() == y.max():
        return y.mean()
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[1:]:
            a = x[:, f] < c
            if min(a.sum(), (~a).sum()) >= least:
                gain = sum((z.sum() ** 2 + (len(z) - z.sum()) ** 2) / len(z) for z in (y[a], y[~a])) - (y.sum() ** 2 + (len(y) - y.sum()) ** 2) / len(y)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, c, a))
    if best[1] is None:
        return y.mean()
    f, c, a = best[1]
    return f, c, slow_tree(x[a], y[a], least, depth - 1), slow_tree(x[~a], y[~a], least, depth - 1)


def said(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] < tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("most", [1 << 16, 60])
def test_a_tree_equals_trying_every_cut(spark, rows, most, monkeypatch):
    monkeypatch.setattr(fo, "MOST_ROWS", most)
    x, y, df = rows
    model = fo.RandomForest(numTrees=1, featureSubsetStrategy="all", bootstrap=False, maxBins=512, minInstancesPerNode=3, maxDepth=6).fit(df)
    tree = slow_tree(x, y, 3, 6)
    got = {r["row_id"]: -r["rawPrediction"][0] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], [said(tree, v) - 0.5 for v in x])


def test_trees_are_the_same_wherever_they_grow_and_stay_off_the_driver(spark, rows, monkeypatch, tmp_path):
    x, y, df = rows
    for make in (lambda: fo.RandomForest(numTrees=70, maxDepth=8), lambda: fr.ExtraTrees(numTrees=70, bootstrap=True)):
        monkeypatch.setattr(fo, "MOST_ROWS", 1 << 16)
        monkeypatch.setattr(fr, "MOST_ROWS", 1 << 16)
        whole = make().fit(df)
        assert len(whole.held["top"]["feature"]) == 70 and len(whole.getOrDefault(whole.state)) < 10_000  # no tree in the state
        monkeypatch.setattr(fo, "MOST_ROWS", 80)
        monkeypatch.setattr(fr, "MOST_ROWS", 80)
        split = make().fit(df)
        assert len(split.held["top"]["feature"]) > 140
        path = str(tmp_path / type(whole).__name__)
        PipelineModel(stages=[split]).write().overwrite().save(path)
        a, b = (m.transform(df).select("row_id", "prediction", F.col("rawPrediction")).orderBy("row_id").collect() for m in (whole, PipelineModel.load(path)))
        assert np.allclose([r["rawPrediction"][1] for r in a], [r["rawPrediction"][1] for r in b])
        assert np.allclose([r["rawPrediction"][1] for r in a], whole.margins(whole.prepared(whole.facts), x))
        assert np.mean([r["prediction"] == t for r, t in zip(a, y)]) > 0.9


def test_extra_trees_equal_the_passes_over_all_rows(spark, rows):
    x, y, df = rows
    est = fr.ExtraTrees(numTrees=5)
    assert fr.node_table(est.fit(df).facts) == fr.node_table(est.grow(fr.stored(df, None), 4))


def test_rows_and_trees_meet_the_same_however_few_fit_into_a_task(spark, rows, monkeypatch):
    _, _, df = rows
    got = []
    for room, walked, most in ((1 << 26, 1 << 15, 1 << 16), (1 << 26, 64, 80), (1, 64, 80)):
        monkeypatch.setattr(fo, "ROOM", room)
        monkeypatch.setattr(fo, "WALKED", walked)
        monkeypatch.setattr(fo, "MOST_ROWS", most)
        monkeypatch.setattr(fo, "TASKS", 6)
        model = fo.RandomForest(numTrees=6, maxDepth=8).fit(df)
        got.append([r["rawPrediction"][1] for r in model.transform(df).orderBy("row_id").collect()])
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])


def test_sent_bytes_grow_in_proportion():
    def sent(n):
        row, forest = 28, 60 * n
        stripes, groups = fo.stripes_and_groups(n, row, forest, 1000)
        return stripes * forest + groups * n * (row + 16)
    assert sent(9_000_000) < 12 * sent(900_000)
