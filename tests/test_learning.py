import dataclasses

import numpy as np
import pytest
from conftest import day
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindlescope.config import RunConfig
from spindlescope.ml import learners as ln
from spindlescope.ml import metrics as mt
from spindlescope.ml import training as tr
from spindlescope.ml.networks import Network
from spindlescope.operators import scaling as sc

SMALL = {
    "random_forest": {"numTrees": 10, "maxDepth": 4}, "extra_trees": {"numTrees": 10, "maxDepth": 6}, "decision_tree": {"maxDepth": 4},
    "logistic_regression": {}, "svm": {"maxIter": 20}, "xgb": {"maxIter": 5}, "gradient_boosting": {"maxIter": 5}, "naive_bayes": {},
    "k_nearest": {}, "mlp": {"hidden": (8,), "maxIter": 50}, "dense_net": {"maxIter": 50},
}


@pytest.fixture(scope="module")
def planted(spark):
    """Two Gaussian classes, 30 % positive."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(2.0 * (i % 10 < 3), 1.0, 4)], int(i % 10 < 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>, label int").select("vec_id", array_to_vector("x").alias("vector"), "label")
    return df.filter("vec_id < 300").cache(), df.filter("vec_id >= 300").cache()


@pytest.mark.parametrize("learner", sorted(SMALL))
def test_every_learner_beats_the_majority(planted, learner):
    done = tr.train_and_evaluate(*planted, learner, SMALL[learner], folds=None, keys=["vec_id"])
    assert done.metrics["accuracy"] > 0.8 and done.metrics["f1"] > 0.6


def test_same_seed_same_predictions(planted):
    one, two = (tr.train_and_evaluate(*planted, "random_forest", SMALL["random_forest"], folds=None, keys=["vec_id"]) for _ in range(2))
    assert one.metrics == two.metrics


def test_cross_validation_and_search(planted):
    done = tr.train_and_evaluate(*planted, "decision_tree", None, {"maxDepth": [1, 4], "impurity": ["gini"]}, "grid", folds=3, keys=["vec_id"])
    assert done.params["maxDepth"] in (1, 4) and 0.8 < done.cv_accuracy <= 1.0
    with pytest.raises(ValueError):
        tr.train_and_evaluate(*planted, "decision_tree", method="halving", keys=["vec_id"])


def test_random_draws_are_a_seeded_subset():
    combos = tr._maps({"a": [1, 2, 3], "b": [4, 5]})
    assert len(combos) == 6
    drawn = tr.draw_maps(combos, 3, 1)
    assert drawn == tr.draw_maps(combos, 3, 1) and len(drawn) == 3 and all(d in combos for d in drawn)


def test_class_weights_shift_recall_and_reach_networks(planted):
    heavy = tr.train_and_evaluate(*planted, "logistic_regression", None, folds=None, keys=["vec_id"], weights={1: 50.0})
    plain = tr.train_and_evaluate(*planted, "logistic_regression", None, folds=None, keys=["vec_id"])
    assert heavy.metrics["recall"] >= plain.metrics["recall"]
    assert isinstance(ln.build("mlp", {}, 3, 10, 1, "weight"), Network) and not isinstance(ln.build("mlp", {}, 3, 10, 1), Network)


def test_metrics_on_empty_denominators(spark):
    r = mt.report_metrics(spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")).first()
    assert r["fdr"] == r["far"] == r["f1"] == r["recall"] == r["precision"] == 0.0 and r["accuracy"] == 1.0


def test_log_loss_is_clipped(spark):
    r = mt.log_loss(spark.createDataFrame([(1, 0.0), (0, 0.5)], "label int, p1 double")).first()[0]
    assert r == pytest.approx((-np.log(1e-15) - np.log(0.5)) / 2)


def test_silhouette_against_numpy(spark):
    x = np.array([[0.0, 0], [0, 1], [5, 5], [5, 6], [9, 0]])
    labels = [0, 0, 1, 1, 1]
    sq = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(5):
        own = [j for j in range(5) if labels[j] == labels[i] and j != i]
        a = sq[i, own].mean()
        b = min(sq[i, [j for j in range(5) if labels[j] == c]].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    df = spark.createDataFrame([([float(v) for v in p], c) for p, c in zip(x, labels)], "x array<double>, prediction int")
    assert mt.silhouette(df.withColumn("vector", array_to_vector("x"))) == pytest.approx(np.mean(scores))
    assert mt.silhouette(df.withColumn("vector", array_to_vector("x")).filter("prediction = 0")) is None


@pytest.fixture(scope="module")
def fleet(spark):
    """Drives whose smart_5_raw climbs before they fail."""
    rng = np.random.default_rng(1)
    rows = []
    for s in range(24):
        bad = s % 3 == 0
        for d in range(30):
            rise = max(0, d - 24) * 10.0 if bad else 0.0
            rows.append((f"d{s:02d}", day(d), "ST1", 10, int(bad and d == 29), float(rng.normal() + rise), float(rng.normal())))
    return spark.createDataFrame(rows, "serial_number string, date date, model string, capacity_bytes long, failure int, smart_5_raw double, smart_9_raw double")


CFG = RunConfig(min_days=10, gap_window=7, gap_tolerance=7, horizon=4, window=4, num_features=2, learner="random_forest", split="hdd", under_ratio=0.5)


def test_saved_run_scores_as_the_fitted_one(spark, fleet, tmp_path):
    run = tr.fit_run(fleet, CFG, SMALL["random_forest"])
    assert run.metrics["recall"] > 0.5
    tr.save_model(run, str(tmp_path))
    newest = tr.save_model(run, str(tmp_path))
    back = tr.load_model(spark, str(tmp_path))
    assert back.config == CFG and back.columns == run.columns
    want = {tuple(r) for r in tr.score(fleet, run).collect()}
    assert {tuple(r) for r in tr.score(fleet.drop("failure"), back).collect()} == want
    assert tr.load_model(spark, newest).ranges == back.ranges
    positives = {s for s, _, p in want if p == 1}
    assert positives and all(int(s[1:]) % 3 == 0 for s in list(positives)[:1])
    one = tr.score_drive(fleet, "d03", run)
    assert {tuple(r) for r in one.collect()} == {w for w in want if w[0] == "d03"}


@pytest.mark.parametrize("method", ["duplicate", "interpolate"])
def test_short_history_is_extended_before_scoring(fleet, method):
    run = tr.fit_run(fleet, dataclasses.replace(CFG, augmentation=method), SMALL["random_forest"])
    short = fleet.filter(F.col("serial_number") == "d01").filter(F.col("date") < day(3))
    assert tr.score(short, run).count() == (CFG.horizon + CFG.window) - (CFG.window - 1)


@pytest.mark.parametrize("change", [{"extract": "custom", "split": "random"}, {"extract": "PCA", "pca_components": 2, "smoothing": 0.3},
                                    {"split": "time", "weighted_features": True}, {"over_ratio": 0.5, "windowing": False}])
def test_variants_of_a_run(fleet, change):
    run = tr.fit_run(fleet, dataclasses.replace(CFG, **change), {"numTrees": 5, "maxDepth": 3})
    assert 0.0 <= run.metrics["accuracy"] <= 1.0
    assert tr.score(fleet, run).count() > 0


def test_a_drive_with_gaps_gets_the_same_windows_in_training_and_scoring(fleet):
    holes = fleet.where("NOT (serial_number = 'd04' AND day(date) IN (5, 6, 14, 20))")
    cfg = dataclasses.replace(CFG, ranking=False)
    marked, cols, ranges, weights = tr.marked_days(holes, cfg)
    taught = tr.windows_of(marked, cfg, cols, ranges, weights).where("serial_number = 'd04'")
    scored = tr.scored_windows(holes.where("serial_number = 'd04'"), tr.Run(cfg, cols, ranges, None))
    want, got = ({str(r["features"]) for r in w.select("features").collect()} for w in (taught, scored))
    assert len(want) == 30 - (cfg.window - 1) and want == got


def test_days_can_be_filled_before_labels(fleet):
    holes = fleet.where(f"NOT (serial_number = 'd03' AND date IN (DATE'{day(27)}', DATE'{day(28)}'))")
    for first in (False, True):
        marked, *_ = tr.marked_days(holes, dataclasses.replace(CFG, ranking=False, interpolate_first=first))
        positive = [r["date"] for r in marked.where("serial_number = 'd03' AND predict_val = 1").select("date").orderBy("date").collect()]
        assert positive[-1] == day(29) and positive[0] == (day(26) if first else day(24))


def test_years_and_preset_choose_days_and_columns(spark, fleet):
    extra = fleet.withColumn("smart_22_raw", F.lit(1.0)).unionByName(
        fleet.withColumns({"date": F.add_months("date", -12), "smart_22_raw": F.lit(2.0)}))
    got = tr.clean_and_label(extra, dataclasses.replace(CFG, years=(str(day(0).year),), preset="iSTEP"))
    assert "smart_22_raw" not in got.columns and "smart_9_raw" in got.columns
    assert got.selectExpr("count_if(year(date) != %d)" % day(0).year).first()[0] == 0 and got.count() == 24 * 30


def test_wavelets_of_a_run_are_those_of_the_long_form(fleet):
    cols = ["smart_5_raw", "smart_9_raw"]
    wide = {(r["serial_number"], r["date"]): r for r in sc.with_wavelets(fleet, cols, 4).collect()}
    long = sc.wavelet(fleet, cols, 4).collect()
    assert len(long) == len(wide) * 6 and wide[("d00", day(3))]["failure"] == 0
    assert all(abs(wide[(r["serial_number"], r["date"])][f"{r['feature']}_scale_{r['scale']}"] - r["magnitude"]) < 1e-9 for r in long)
    hole = fleet.withColumn("smart_9_raw", F.when(F.col("date") != day(9), F.col("smart_9_raw")))
    assert sc.with_wavelets(hole, cols, 2).where("smart_9_raw_scale_1 IS NULL").count() == 24 * 17
    run = tr.fit_run(fleet, dataclasses.replace(CFG, wavelets=True, wavelet_scales=4), {"numTrees": 5, "maxDepth": 3})
    assert tr.score(fleet, run).count() == 24 * 27 and run.model.stages[-1].numFeatures == 2 * 4 * CFG.window


def test_transfer_starts_networks_from_the_first_fit(planted):
    train, test = planted
    near, far = train.filter("vec_id % 2 = 0"), train.filter("vec_id % 2 = 1")
    done = tr.transfer_train(near, far, test, "mlp", {"hidden": (4,), "maxIter": 1})
    first = tr.train_and_evaluate(near, test, "mlp", {"hidden": (4,), "maxIter": 1}, folds=None, keys=["vec_id"])
    assert done.params["initialWeights"] == first.model.stages[-1].weights
    assert tr.transfer_train(near, far, test, "decision_tree", {"maxDepth": 3}).metrics["accuracy"] > 0.7


def test_registered_learners_run_their_defaults(monkeypatch):
    import __spark_entry__ as entry
    from spindlescope.plans import learning, statistics
    calls = []

    class Stop(Exception):
        pass

    def record(*args, **kw):
        calls.append((args, kw))
        raise Stop

    monkeypatch.setattr(learning, "embedding_sides", lambda *a: (None, None))
    monkeypatch.setattr(learning, "_as_vectors", lambda df: df)
    for module in (learning.fx, statistics.fx):
        for name in ("vectors", "drive_day", "labelled_days", "shared_folder"):
            monkeypatch.setattr(module, name, lambda *a: None)
    monkeypatch.setattr(learning.tr, "train_and_evaluate", record)
    monkeypatch.setattr(learning.tr, "fit_run", record)
    monkeypatch.setattr(learning.nm, "isolation_forest", record)
    monkeypatch.setattr(statistics.ft, "genetic_feature_select", record)
    names = ["random_forest", "extra_trees", "decision_tree", "logistic_regression", "svm", "xgb", "gradient_boosting", "mlp", "dense_net", "with_class_weights"]
    for name in [*(f"learn_{n}" for n in names), "grid_search", "random_search", "isolation_forest", "genetic_feature_select", "train_and_evaluate"]:
        with pytest.raises(Stop):
            entry.queries()[name](None, "")
        args, kw = calls[-1]
        assert not any(isinstance(x, dict) and x for x in args) and not {"grid", "n_iter", "trees", "sample", "n_pop", "n_gen"} & set(kw), name
