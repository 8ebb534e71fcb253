import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.ml import batched, passes

D = 6


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, D)) * [1, 5, 0.1, 100, 1, 1] + [0, 3, 0, 1e4, 0, 0]
    x[:, 5] = 2.0  # no variance
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=240) * 1.5 > 1).astype(int)
    rows = [(x[i].tolist(), int(y[i]), i % 3, 1.0 + i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "x array<double>, label int, fold int, w double").select(array_to_vector("x").alias("vector"), "label", "fold", "w").repartition(5)
    return df.cache(), passes.stored_rows(df, "label", "fold", "w"), x


def test_sums_over_blocks_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(passes, "CHUNK", 7)
    monkeypatch.setattr(passes, "BLOCK", 3)
    rows = spark.range(50).selectExpr("array(cast(id as double), 1D) AS x", "cast(id as double) AS label").repartition(4)
    got = passes.block_sums(rows, lambda x, rest: np.outer(x.sum(axis=0), np.arange(10)) + rest["label"].sum() * 0, 20)
    assert got.tolist() == [1225.0 * i for i in range(10)] + [50.0 * i for i in range(10)]
    assert passes.block_sums(rows.limit(0), lambda x, rest: x.sum(axis=0), 2).tolist() == [0.0, 0.0]


@pytest.mark.parametrize("weight", [None, "w"])
def test_coefficients_equal_single_fits(table, weight):
    df, rows, x = table
    models = [batched.Model(f, c, a) for f, c in ((-1, None), (-1, 1.0), (0, 0.05), (2, 100.0)) for a in (0.0, 0.5, 1.0)]
    fitted, taken = batched.fit_models(rows, models, D, [2, 100], weight)
    assert taken.max() < 40 and not np.allclose(fitted[2], fitted[100])
    for m, got in zip(models, fitted[100]):
        part = df.filter(F.col("fold") != m.fold)
        one = LogisticRegression(featuresCol="vector", labelCol="label", regParam=0.0 if m.c is None else 1 / (m.c * part.count()), elasticNetParam=m.l1, maxIter=1000, tol=1e-12)
        one = (one.setWeightCol(weight) if weight else one).fit(part)
        assert np.abs((got - np.r_[one.coefficients.toArray(), one.intercept]) * np.r_[x.std(axis=0), 1]).max() < 1e-4


def test_masks_leave_columns_out(table):
    df, rows, x = table
    masks = [(True, True, False, False, False, False), (False, False, True, True, True, True)]
    got = batched.mask_accuracies(rows, masks, D, 3)
    for mask, score in zip(masks, got):
        right = []
        for f in range(3):
            cut = F.udf(lambda v, m=mask: [a for a, b in zip(v.toArray().tolist(), m) if b], "array<double>")
            part = df.withColumn("vector", array_to_vector(cut("vector")))
            model = LogisticRegression(featuresCol="vector", labelCol="label", tol=1e-10).fit(part.filter(F.col("fold") != f))
            right.append(model.transform(part.filter(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert score == pytest.approx(np.mean(right), abs=0.02)


def test_search_scores_every_combination(table):
    _, rows, _ = table
    combos = [{"penalty": p, "C": c, "maxIter": n} for p in ("l1", "none") for c in (1e-4, 1.0) for n in (1, 100)]
    scores = batched.cross_validated(rows, combos, D, 3)
    assert len(scores) == 8 and scores[0] == 0.0 and scores[3] > 0.7 and scores[5] == scores[7]


def test_scores_without_positives():
    cells = np.array([[0, 0, 5, 0], [2, 1, 3, 0]])
    assert batched.f1_scores(cells).tolist() == [0.0, 0.8] and batched.accuracies(cells).tolist() == [1.0, 5 / 6]
