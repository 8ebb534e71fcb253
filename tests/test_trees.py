import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import trees as fr


def frame(spark, x, y, w=None):
    rows = [(v.tolist(), int(c), float(1 if w is None else w[i])) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "x array<double>, label int, wt double").select(array_to_vector("x").alias("vector"), "label", "wt").repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 5)), 1)
    x[:, 4] = 1.0
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(160) < 0.05)).astype(int)
    return x, y


def slow_boost(x, y, w, n, depth, eta, lam, gamma, least, columns, drawn_rows):
    """Boosting by trying every cut at every node, and pruning by recursion."""
    margin, forest = np.zeros(len(x)), []
    for t in range(n):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(idx, level):
            G, H = g[idx].sum(), h[idx].sum()
            node = {"g": G, "h": H, "leaf": -eta * G / (H + lam)}
            best = (1e-6, None)
            if level < depth:
                for f in columns(t):
                    for c in np.unique(x[:, f])[1:]:
                        a = idx & (x[:, f] < c)
                        gl, hl = g[a].sum(), h[a].sum()
                        if min(hl, H - hl) >= least:
                            gain = gl ** 2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G ** 2 / (H + lam)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, c))
            if best[1]:
                f, c = best[1]
                kids = grow(idx & (x[:, f] < c), level + 1), grow(idx & (x[:, f] >= c), level + 1)
                if not (all("cut" not in k for k in kids) and best[0] < gamma):
                    node.update(cut=(f, c), kids=kids)
            return node
        tree = grow(drawn_rows(t), 0)

        def place(node, idx):
            if "cut" not in node:
                margin[idx] += node["leaf"]
            else:
                f, c = node["cut"]
                place(node["kids"][0], idx & (x[:, f] < c))
                place(node["kids"][1], idx & (x[:, f] >= c))
        place(tree, np.ones(len(x), bool))
        forest.append(tree)
    return margin


@pytest.mark.parametrize("options", [{}, {"gamma": 3.0, "regLambda": 0.5, "minChildWeight": 4.0, "stepSize": 0.4}, {"subsample": 0.6}, {"colsampleByTree": 0.5}])
def test_boosting_equals_trying_every_cut(spark, data, options, monkeypatch):
    monkeypatch.setattr(fr, "REFRESH", 2)
    x, y = data
    w = 1.0 + np.arange(len(x)) % 3
    est = fr.BoostedTrees(maxIter=5, maxBins=512, **options).setWeightCol("wt")
    df = frame(spark, x, y, w)
    model = est.fit(df)
    rows = fr.stored(df, "wt").collect()
    h = {(tuple(r["x"]), r["label"], r["w"]): r["h"] for r in rows}
    keys = np.array([h[tuple(a), float(b), c] for a, b, c in zip(x, y, w)])
    v = est.value

    def columns(t):
        order = sorted(range(5), key=lambda f: fr.drawn(42, t, -1, f))
        return sorted(order[:int(np.ceil(v("colsampleByTree") * 5))])
    want = slow_boost(x, y, w, 5, 3, v("stepSize"), v("regLambda"), v("gamma"), v("minChildWeight"), columns,
                      lambda t: fr.uniform(keys, 42 * 1_000_003 + t) < v("subsample") if v("subsample") < 1 else np.ones(len(x), bool))
    got = model.margins(model.prepared(model.facts), x)
    assert np.abs(got - want).max() < 1e-9


def test_extra_trees_separate_and_respect_options(spark, data):
    x, y = data
    model = fr.ExtraTrees(numTrees=12, maxFeatures="sqrt").fit(frame(spark, x, y))
    said = model.margins(model.prepared(model.facts), x) > 0
    assert (said == y).mean() > 0.97  # grown to pure leaves, but for equal rows of both classes
    nodes = fr.node_table(model.facts)
    assert len({n[:2] for n in nodes}) == len(nodes)
    by = {n[:2]: n for n in nodes}
    for tree, node, f, _, n0, n1 in nodes:
        if f is not None:
            kids = [by[tree, 2 * node + 1], by[tree, 2 * node + 2]]
            assert f != 4 and n0 == sum(k[4] for k in kids) and n1 == sum(k[5] for k in kids) and all(k[4] + k[5] > 0 for k in kids)
    flat = fr.ExtraTrees(numTrees=3, maxDepth=1, bootstrap=True).fit(frame(spark, x, y))
    counts = [n[4] + n[5] for n in fr.node_table(flat.facts) if n[1] == 0]
    assert max(n[1] for n in fr.node_table(flat.facts)) <= 2 and len(set(counts)) > 1 and all(100 < c < 230 for c in counts)


def test_weight_two_is_a_row_twice(spark, data):
    x, y = data
    w = np.where(np.arange(len(x)) < 40, 2.0, 1.0)
    twice = np.r_[np.arange(len(x)), np.arange(40)]
    for est in (fr.ExtraTrees(numTrees=3, maxDepth=4), fr.BoostedTrees(maxIter=2, maxBins=512)):
        a = est.copy().setWeightCol("wt").fit(frame(spark, x, y, w))
        b = est.fit(frame(spark, x[twice], y[twice]))
        assert np.allclose(a.margins(a.prepared(a.facts), x), b.margins(b.prepared(b.facts), x))


def test_one_class_constant_columns_and_saved_models(spark, data, tmp_path):
    x, y = data
    for est in (fr.ExtraTrees(numTrees=2), fr.BoostedTrees(maxIter=2)):
        only = est.fit(frame(spark, np.ones((6, 2)), np.zeros(6)))
        assert (only.margins(only.prepared(only.facts), np.ones((2, 2))) < 0).all()
        df = frame(spark, x, y)
        model = Pipeline(stages=[est]).fit(df)
        path = str(tmp_path / type(est).__name__)
        model.write().overwrite().save(path)
        again = PipelineModel.load(path).transform(df)
        assert again.stat.crosstab("prediction", "label").count() == 2
        assert again.join(model.transform(df).select("vector", F.col("prediction").alias("p")), "vector").filter("prediction <> p").count() == 0
