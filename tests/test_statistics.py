import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlescope.functions import pvalues as pv
from spindlescope.functions import series as sr
from spindlescope.operators import features as ft
from spindlescope.operators import ordering as od
from spindlescope.operators import reports as rp
from spindlescope.operators import statistics as st


def test_tail_probabilities_at_known_points():
    assert pv.two_sided_t(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert pv.two_sided_t(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert pv.two_sided_t(0.0, 5) == pytest.approx(1.0)
    assert pv.two_sided_normal(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert pv.two_sided_t(None, 3) is None
    assert pv.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)


@pytest.fixture
def two_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 4 == 0), float(rng.integers(0, 6) + (i % 4 == 0)), 3.0, None if i % 5 else 1.0 * i) for i in range(200)]
    return spark.createDataFrame(rows, "id int, predict_val int, a_raw double, b_raw double, c_raw double")


def test_t_statistics(two_classes):
    got = {r["feature"]: r for r in st.t_test(two_classes, ["a_raw", "b_raw"]).collect()}
    x = [r["a_raw"] for r in two_classes.filter("predict_val = 0").collect()]
    y = [r["a_raw"] for r in two_classes.filter("predict_val = 1").collect()]
    pooled = ((len(x) - 1) * np.var(x, ddof=1) + (len(y) - 1) * np.var(y, ddof=1)) / (len(x) + len(y) - 2)
    assert got["a_raw"]["t"] == pytest.approx((np.mean(x) - np.mean(y)) / math.sqrt(pooled * (1 / len(x) + 1 / len(y))))
    assert got["b_raw"]["t"] is None and got["b_raw"]["p_value"] is None


@pytest.mark.parametrize("single", [10**6, 0])
def test_mann_whitney_counts_pairs(two_classes, monkeypatch, single):
    monkeypatch.setattr(od, "SINGLE_RANGE_ROWS", single)
    got = {r["feature"]: r for r in st.mann_whitney(two_classes, ["a_raw", "c_raw"]).collect()}
    for f in ("a_raw", "c_raw"):
        x = [r[f] for r in two_classes.filter(f"predict_val = 0 AND {f} IS NOT NULL").collect()]
        y = [r[f] for r in two_classes.filter(f"predict_val = 1 AND {f} IS NOT NULL").collect()]
        u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        assert got[f]["u"] == pytest.approx(u)
        assert 0 <= got[f]["p_value"] <= 1


def test_ranking_drops_undefined_and_keeps_other_columns(two_classes):
    df = two_classes.withColumnsRenamed({"a_raw": "smart_1_raw", "b_raw": "smart_2_raw", "c_raw": "smart_3_raw"})
    out, chosen = st.rank_features(df, 18)
    assert chosen[0] == "smart_1_raw" and "smart_2_raw" not in chosen
    assert out.columns == [*chosen, "id", "predict_val"]
    with pytest.raises(ValueError):
        st.rank_features(df, 2, "ks")


def test_correlation_of_a_constant_is_null_and_nulls_drop_pairwise(two_classes):
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in rp.correlation_matrix(two_classes, ["id", "b_raw", "c_raw"]).collect()}
    assert got[("id", "b_raw")] is None
    assert got[("id", "c_raw")] == pytest.approx(1.0)


def test_correlations_equal_numpy_per_group_and_scan_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 30)) * 10.0 ** rng.integers(-3, 6, 30) + 1e5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.0
    kinds = [None if i % 10 == 0 else "ab"[i % 3 == 0] for i in range(300)]
    cols = [f"c{i}" for i in range(30)]
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r]) for k, r in zip(kinds, x)]
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    for by, groups in (("kind", [None, "a", "b"]), (None, [None])):
        got = {(r[by] if by else None, r["feature_a"], r["feature_b"]): r["r"] for r in rp.correlation_matrix(df, cols, by).collect()}
        assert len(got) == len(groups) * 435
        for g in groups:
            part = x[[i for i, k in enumerate(kinds) if by is None or k == g]]
            for i in range(30):
                for j in range(i + 1, 30):
                    both = part[~np.isnan(part[:, i]) & ~np.isnan(part[:, j])]
                    r = got[g, cols[i], cols[j]]
                    assert r is None if 4 in (i, j) else r == pytest.approx(np.corrcoef(both[:, i], both[:, j])[0, 1], abs=1e-6)
    assert rp.correlation_matrix(df.limit(0), cols).count() == 0


def test_divergence_of_a_model_with_itself_is_zero_and_pairs_are_ordered(spark):
    rows = [(m, float(i % 7)) for m in ("x", "y", "z") for i in range(70)]
    got = st.model_divergence(spark.createDataFrame(rows, "model string, smart_1_raw double"), ["smart_1_raw"]).collect()
    assert len(got) == 6 and all(abs(r["kl"]) < 1e-9 for r in got)


def test_a_lone_model_has_no_divergence_and_is_relevant(spark):
    one = spark.createDataFrame([("x", float(i % 7)) for i in range(70)], "model string, smart_1_raw double")
    assert [tuple(r) for r in st.partition_models_by_divergence(one, ["smart_1_raw"]).collect()] == [("x", 0.0, True)]


def test_histogram_counts_every_value_and_samples_exactly(spark):
    df = spark.range(1000).select(F.col("id").alias("serial_number"), F.col("id").alias("date"),
                                  F.when(F.col("id") % 10 > 0, F.col("id") % 100).cast("double").alias("x"))
    assert rp.histogram(df, "x", 9).agg(F.sum("records")).first()[0] == 900
    sampled = rp.histogram(df, "x", 9, rows=300)
    r = sampled.agg(F.sum("records"), F.max("null_records")).first()
    assert r[0] + r[1] == 300
    empty = rp.histogram(df.withColumn("x", F.lit(None).cast("double")), "x", 9).collect()
    assert [(e["bin"], e["records"], e["null_records"]) for e in empty] == [(None, 0, 1000)]


@pytest.mark.parametrize("x", [[1.0, 2.0, 4.0, 8.0], [0.1] * 7, [3.0], [0.1, 0.1, 0.1, 0.2]])
def test_series_statistics(spark, x):
    r = spark.createDataFrame([(x,)], "x array<double>").select(
        sr.std_pop(F.col("x")).alias("std"), sr.skewness_pop(F.col("x")).alias("skew"), sr.lag1_autocorrelation(F.col("x")).alias("ac"),
        sr.root_mean_square(F.col("x")).alias("rms"), sr.range_slope(F.col("x")).alias("slope")).first()
    a = np.array(x)
    assert r["std"] == pytest.approx(a.std(), abs=1e-12)
    assert r["rms"] == pytest.approx(math.sqrt((a * a).mean()))
    assert r["slope"] == pytest.approx((a.max() - a.min()) / len(a))
    if a.max() == a.min():
        assert r["std"] == 0.0 and r["skew"] is None and r["ac"] is None
    else:
        assert r["skew"] == pytest.approx(((a - a.mean()) ** 3).mean() / a.std() ** 3)
        if np.ptp(a[:-1]) > 0:
            assert r["ac"] == pytest.approx(np.corrcoef(a[:-1], a[1:])[0, 1])
        else:
            assert r["ac"] is None


def test_drive_pca_is_white(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=4) @ rng.normal(size=(4, 4))), bool(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "serial_number int, a double, b double, c double, d double, ever_failed boolean")
    placed, _ = ft.drive_pca(df, ["a", "b", "c", "d"])
    cov = np.cov(np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in placed.collect()]).T)
    assert cov == pytest.approx(np.eye(3), abs=1e-8)


def test_rank_sees_a_dependent_column(spark):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(3)
    rows = [([float(a), float(b), float(a + b)],) for a, b in rng.normal(size=(40, 2))]
    df = spark.createDataFrame(rows, "x array<double>").select(array_to_vector("x").alias("vector"))
    assert ft.feature_rank(df).first()[:] == (2, 3, False)


def test_genetic_search_keeps_the_best_mask(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), i, int(i % 2), float(i % 2 * 4 + rng.normal()), float(rng.normal()), "xy"[i % 3 == 0]) for i in range(120)]
    df = spark.createDataFrame(rows, "serial_number string, date int, predict_val int, good double, noise double, kind string")
    chosen, best, history = ft.genetic_feature_select(df, ["good", "noise", "kind"], n_pop=3, n_gen=1, seed=5)
    assert "good" in chosen and best > 0.9
    assert best == pytest.approx(history.agg(F.max("fitness")).first()[0])
