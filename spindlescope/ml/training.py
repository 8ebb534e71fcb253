"""Training, search, evaluation, saved runs, scoring and transfer between drive models."""

from __future__ import annotations

import dataclasses
import json
import time

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.config import RunConfig, smart_columns
from spindlescope.ml import learners as ln
from spindlescope.ml import metrics as mt
from spindlescope.ml.batched import cross_validated
from spindlescope.ml.neighbour_stages import fitted_labels
from spindlescope.ml.passes import stored_rows
from spindlescope.ml.tree_depths import tree_scores
from spindlescope.operators import features as ft
from spindlescope.operators import history as hs
from spindlescope.operators import sampling as sp
from spindlescope.operators import scaling as sc
from spindlescope.operators import selection as sel
from spindlescope.operators import statistics as st
from spindlescope.operators import window_axes as wx
from spindlescope.operators import windows as wn
from spindlescope.session import cut_lineage, lookup_rows, written
from spindlescope.sources import snapshots as sn


def _maps(grid: dict) -> list[dict]:
    """All combinations of a grid as plain dicts."""
    combos = [{}]
    for name, values in grid.items():
        combos = [{**c, name: v} for c in combos for v in values]
    return combos


def draw_maps(combos: list[dict], n_iter: int, seed: int) -> list[dict]:
    """A seeded subset of the combinations, without repeats."""
    if len(combos) <= n_iter:
        return combos
    picked = np.random.default_rng(seed).choice(len(combos), n_iter, replace=False)
    return [combos[i] for i in sorted(picked)]


def f1_judge() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)


def accuracy_judge() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")


def _cross_validate(estimator, maps: list[dict], rows: DataFrame, folds: int, judge, fold_col: str, parallelism: int):
    """Mean score per param map, folds taken from ``fold_col``."""
    as_maps = [{estimator.getParam(k): v for k, v in m.items()} for m in maps] or [{}]
    return CrossValidator(estimator=estimator, estimatorParamMaps=as_maps, evaluator=judge, numFolds=folds,
                          foldCol=fold_col, parallelism=parallelism).fit(rows).avgMetrics


def search(rows: DataFrame, learner: str, combos: list[dict], width: int, count: int, seed: int, keys: list[str],
           folds: int = 3, parallelism: int = 4, weight_col: str | None = None) -> tuple[dict, float]:
    """The combination with the best mean F1 over stratified folds.

    Logistic regressions, all combinations and folds, share their scans; decision trees that only differ in depth share one tree. Of the other learners, combinations that only
    differ in Spark parameters share one cross-validator, which runs them in parallel; layers take one each.
    """
    folded = sp.stratified_kfold(rows, folds, "label", keys, seed, "_fold3")
    if learner == "logistic_regression":
        stored = stored_rows(folded.withColumnRenamed("_fold3", "fold"), "label", "fold", *([weight_col] if weight_col else []))
        scores = cross_validated(stored, combos, width, folds, weight_col)
        top = int(np.argmax(scores))
        return combos[top], float(scores[top])
    if learner == "decision_tree" and all("maxDepth" in c for c in combos):
        scores = tree_scores(folded, combos, folds, lambda c: ln.build(learner, c, width, count, seed, weight_col), parallelism)
        top = int(np.argmax(scores))
        return combos[top], float(scores[top])
    groups: dict[str, list[dict]] = {}
    special = ("hidden",)
    for c in combos:
        groups.setdefault(json.dumps({k: c[k] for k in special if k in c}), []).append(c)
    best, top = {}, -1.0
    for members in groups.values():
        base = {k: v for k, v in members[0].items() if k in special}
        estimator = ln.build(learner, base, width, count, seed, weight_col)
        plain = [{k: v for k, v in m.items() if k not in special} for m in members]
        scores = _cross_validate(estimator, plain, folded, folds, f1_judge(), "_fold3", parallelism)
        for m, s in zip(members, scores):
            if s > top:
                best, top = m, s
    return best, top


@dataclasses.dataclass
class Trained:
    """A fitted learner with the scores it got and its predictions on the test rows."""

    model: PipelineModel
    params: dict
    cv_accuracy: float | None
    metrics: dict
    predictions: DataFrame


def train_and_evaluate(train: DataFrame, test: DataFrame, learner: str, params: dict | None = None, grid: dict | None = None,
                       method: str | None = None, n_iter: int = 100, folds: int | None = 5, seed: int = 42,
                       keys=("serial_number", "date"), weights: dict | None = None, parallelism: int = 4) -> Trained:
    """Search, cross-validate, fit on all training rows, predict the test rows and report.

    Unsupervised learners are searched and judged by the plain silhouette of the labels they give the training rows (``silhouette`` in
    the report, no cross-validation); their outliers count as class 1. Frames hold ``vector``, 0/1 ``label`` and ``keys``. ``method`` is ``grid``, ``randomized`` or None;
    one fit uses all rows. Training rows are stored once, since every stage reads them again, and so are
    the predictions, without their vectors; folds are a column computed on the stored rows.
    """
    keys = list(keys)
    weight_col = None
    if weights:
        train, weight_col = sp.class_weights(train, weights, "label"), "weight"
    row_id = F.concat_ws("|", *keys).alias("row_id")
    train = cut_lineage(train.select(*keys, row_id, "vector", F.col("label").cast("double").alias("label"), *([weight_col] if weight_col else [])))
    count = train.count()
    width = int(train.first()["vector"].size)
    chosen = dict(params or {})
    if method:
        combos = _maps(grid if grid is not None else ln.LEARNERS[learner].grid)
        if method == "randomized":
            combos = draw_maps(combos, n_iter, seed)
        elif method != "grid":
            raise ValueError(f"unknown search method: {method}")
        combos = [{**chosen, **c} for c in combos]
        if learner in ln.UNSUPERVISED:
            found = max(combos, key=lambda c: -2.0 if (s := _silhouette(train, learner, c, width, count, seed)) is None else s)
        else:
            found, _ = search(train, learner, combos, width, count, seed, keys, parallelism=parallelism, weight_col=weight_col)
        chosen.update(found)
    estimator = ln.build(learner, chosen, width, count, seed, weight_col)
    cv = None
    if folds and learner not in ln.UNSUPERVISED:
        folded = sp.stratified_kfold(train, folds, "label", keys, seed, "_fold5")
        cv = float(_cross_validate(estimator, [], folded, folds, accuracy_judge(), "_fold5", parallelism)[0])
    model = Pipeline(stages=[estimator]).fit(train)
    scored = model.transform(test.select("*", row_id).withColumn("label", F.col("label").cast("double")))
    predicted = cut_lineage(scored.select(*keys, "label", "prediction", "rawPrediction"))
    report = mt.report_metrics(predicted).first().asDict()
    report["auc_score"] = mt.auc_score(predicted) if model.stages[-1].numClasses == 2 else None
    if learner in ln.UNSUPERVISED:
        labels = fitted_labels(model, learner, chosen, train)
        report["silhouette"] = mt.euclidean_silhouette(labels).first()["silhouette"]
    return Trained(model, chosen, cv, report, predicted)


def _silhouette(train: DataFrame, learner: str, params: dict, width: int, count: int, seed: int) -> float | None:
    """Silhouette of the labels that one combination gives the training rows; None for a single cluster."""
    model = Pipeline(stages=[ln.build(learner, params, width, count, seed)]).fit(train)
    return mt.euclidean_silhouette(fitted_labels(model, learner, params, train)).first()["silhouette"]


@dataclasses.dataclass
class Run:
    """Everything scoring needs to repeat what training did."""

    config: RunConfig
    columns: list[str]
    ranges: dict[str, tuple[float, float]]
    model: PipelineModel
    metrics: dict = dataclasses.field(default_factory=dict)
    weights: dict[str, float] = dataclasses.field(default_factory=dict)
    pca: list | None = None


def clean_and_label(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Years, columns of the preset, model filter, gap filter and horizon labels."""
    if cfg.years:
        df = sn.prune_days(df, years=cfg.years)
    if cfg.preset:
        df = sn.prune_columns(df, cfg.preset)
    if cfg.manufacturer != "custom" or cfg.models:
        df = sel.filter_manufacturer(df, cfg.manufacturer, cfg.models)
    kept, _, _ = hs.filter_drives(df, cfg.min_days, cfg.gap_window, cfg.gap_tolerance, cfg.max_missing)
    if cfg.interpolate and cfg.interpolate_first:
        kept = hs.interpolate(kept, cfg.interpolate)
    return hs.failure_horizon_labels(kept, cfg.horizon, cfg.window)


def choose_columns(df: DataFrame, cfg: RunConfig) -> tuple[list[str], dict[str, float]]:
    """SMART columns to use, and their weights if weighting is on."""
    cols = smart_columns(df)
    if cfg.genetic:
        cols, _, _ = ft.genetic_feature_select(df, cols, n_pop=cfg.population, n_gen=cfg.generations, seed=cfg.seed)
    if cfg.ranking:
        raws = [c for c in cols if "raw" in c]
        tests = {"t-test": st.t_test, "mannwhitneyu": st.mann_whitney}
        pvals = lookup_rows(tests[cfg.test_type](df, raws))
        ranked = sorted((r["p_value"], r["feature"]) for r in pvals if r["p_value"] is not None)[:cfg.num_features]
        cols = [f for _, f in ranked]
        if cfg.weighted_features:
            return cols, st.feature_weights(df.sparkSession.createDataFrame(ranked, "p_value double, feature string"))
    return cols, {}


def split_days(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Mark test days. A window belongs to the side of its last day; ``hdd`` keeps whole drives together."""
    if cfg.split == "random":
        return sp.split_random(df, cfg.test_share, cfg.seed)
    if cfg.split == "hdd":
        return sp.split_by_drive(df, cfg.test_share, cfg.seed, "predict_val")
    return sp.split_by_time(df, cfg.test_share, cfg.seed)


def scaled_days(df: DataFrame, cfg: RunConfig, cols: list[str], ranges: dict, weights: dict | None = None) -> DataFrame:
    """Scaling, optional weights, smoothing and wavelets; the columns to window are ``signals``."""
    scaled = sc.apply_ranges(df, {c: ranges[c] for c in cols})
    if weights:
        scaled = sel.apply_feature_weights(scaled, weights)
    if cfg.smoothing is not None:
        scaled = sc.exp_smooth(scaled, cols, cfg.smoothing)
    return sc.with_wavelets(scaled, cols, cfg.wavelet_scales) if cfg.wavelets else scaled


def signals(cfg: RunConfig, cols: list[str]) -> list[str]:
    """Columns that go into a window: the chosen ones and, with ``wavelets``, their scales."""
    return [*cols, *sc.wavelet_names(cols, cfg.wavelet_scales)] if cfg.wavelets else list(cols)


def windows_of(df: DataFrame, cfg: RunConfig, cols: list[str], ranges: dict, weights: dict | None = None,
               label: str | None = "predict_val", align: str = "end") -> DataFrame:
    """Scaled days, then windows: the part training and scoring share."""
    scaled = scaled_days(df, cfg, cols, ranges, weights)
    return wn.lag_windows(scaled, signals(cfg, cols), cfg.window, cfg.overlap, label=label, pad=cfg.fillna_method, align=align,
                          windowing=cfg.windowing)


def vectors_of(windows: DataFrame, cfg: RunConfig, pca: list | None = None) -> DataFrame:
    """One dense vector per window: flattened days, summaries or components."""
    if cfg.extract == "custom":
        return ft.summary_vector(ft.window_features(windows))
    if cfg.extract == "basic":
        return ft.summary_vector(ft.window_features_basic(windows), ft.BASIC)
    if cfg.extract == "PCA":
        return wx.window_pca(windows, pca).withColumn("vector", array_to_vector(F.flatten("components")))
    return wn.flatten_windows(windows)


def prepare(df: DataFrame, cfg: RunConfig) -> tuple[DataFrame, list[str], dict, dict]:
    """Labelled windows with ``is_test``, the columns used, their training ranges and weights."""
    marked, cols, ranges, weights = marked_days(df, cfg)
    return windows_of(marked, cfg, cols, ranges, weights), cols, ranges, weights


def marked_days(df: DataFrame, cfg: RunConfig) -> tuple[DataFrame, list[str], dict, dict]:
    """Stored labelled days with ``is_test``, the columns used, their training ranges and weights."""
    labelled = written(clean_and_label(df, cfg))
    cols, weights = choose_columns(labelled, cfg)
    days = labelled.select("serial_number", "date", "model", "failure", "predict_val", "validate_val", *cols)
    if cfg.interpolate and not cfg.interpolate_first:
        days = hs.interpolate(days, cfg.interpolate)
    marked = written(split_days(days, cfg))
    return marked, cols, sc.fit_ranges(marked.filter("NOT is_test"), cols), weights


def fit_axes(days: DataFrame, windows: DataFrame, cfg: RunConfig, cols: list[str]) -> list[wx.WindowAxes]:
    """Components of the training windows: from scaled days where a window is a run of days, else from the windows."""
    if cfg.windowing and cfg.overlap == "full" and cfg.fillna_method is None:
        return wx.fit_window_pca_of_days(days, signals(cfg, cols), cfg.window, cfg.pca_components, ~F.col("is_test"))
    return wx.fit_window_pca(windows.filter("NOT is_test"), len(signals(cfg, cols)), cfg.pca_components)


def _sides(samples: DataFrame, cfg: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Training and test vectors; only the training side is balanced."""
    train = samples.filter("NOT is_test")
    test = samples.filter("is_test").select(
        F.concat_ws("|", "serial_number", "date").alias("vec_id"), "vector", F.col("window_label").alias("label"))
    rows = train.select(F.concat_ws("|", "serial_number", "date").alias("vec_id"), vector_to_array("vector").alias("vec"),
                        F.col("window_label").alias("label"))
    if cfg.over_ratio is not None or cfg.under_ratio is not None:
        rows = sp.balance(rows, cfg.over_ratio, cfg.under_ratio, seed=cfg.seed, label="label")
    return rows.select("vec_id", array_to_vector("vec").alias("vector"), "label"), test


def fit_run(df: DataFrame, cfg: RunConfig, params: dict | None = None, grid: dict | None = None, folds: int | None = None) -> Run:
    """Clean, label, choose, fill, split, scale, window, balance, fit and evaluate under one configuration.

    Windows are ``window`` times the size of the days. The days are stored and windowed again where a step needs them; the vectors
    of the training side are stored once more for the learner, which reads them many times.
    """
    marked, cols, ranges, weights = marked_days(df, cfg)
    windows = windows_of(marked, cfg, cols, ranges, weights)
    pca = fit_axes(scaled_days(marked, cfg, cols, ranges, weights), windows, cfg, cols) if cfg.extract == "PCA" else None
    train, test = _sides(vectors_of(windows, cfg, pca), cfg)
    done = train_and_evaluate(train, test, cfg.learner, params, grid, cfg.search, cfg.n_iter, folds, cfg.seed, ["vec_id"])
    return Run(cfg, cols, ranges, done.model, {**done.metrics, "cv_accuracy": done.cv_accuracy}, weights, pca)


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_model(run: Run, folder: str) -> str:
    """Save model, settings, columns and ranges under a new time-stamped name; returns the path."""
    spark = SparkSession.getActiveSession()
    path = f"{folder.rstrip('/')}/run-{time.time_ns():020d}"
    run.model.write().overwrite().save(f"{path}/model")
    facts = {"config": json.loads(run.config.to_json()), "columns": run.columns, "ranges": run.ranges,
             "metrics": run.metrics, "weights": run.weights, "pca": [dataclasses.asdict(m) for m in run.pca or []]}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return path


def load_model(spark: SparkSession, folder: str) -> Run:
    """Load the newest complete run of a folder, or the run at this very path."""
    if "/run-" not in folder:
        path, files = _hadoop(spark, folder)
        names = sorted(s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().startswith("run-"))
        done = [n for n in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n + "/facts/_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"no finished run in {folder}")
        folder = done[-1]
    facts = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
    pca = [wx.WindowAxes(**m) for m in facts["pca"]]
    return Run(RunConfig.from_json(json.dumps(facts["config"])), facts["columns"],
               {c: tuple(r) for c, r in facts["ranges"].items()}, PipelineModel.load(f"{folder}/model"),
               facts["metrics"], facts["weights"], pca or None)


def scored_windows(df: DataFrame, run: Run) -> DataFrame:
    """Windows of all drives as training builds them, with ``position``: the place of a window's last day.

    Missing days are filled as in training before short histories are extended; scaling uses the training ranges, and days are
    ordered by their position, since repeated days share a date.
    """
    cfg = run.config
    days = sel.require_keys(sel.select_attributes(df, run.columns, ("serial_number", "date", "capacity_bytes")))
    days = days.drop("capacity_bytes").na.drop(subset=run.columns)
    if cfg.interpolate:
        days = hs.interpolate(days, cfg.interpolate)
    long = wn.extend_short_history(days, cfg.horizon + cfg.window, cfg.augmentation, run.columns)
    start = F.min("date").over(hs.drive())
    placed = long.withColumn("date", F.date_add(start, F.col("position").cast("int")))
    return windows_of(placed, dataclasses.replace(cfg, overlap="full" if cfg.overlap == "hybrid" else cfg.overlap),
                      run.columns, run.ranges, run.weights, None, "start")


def score(df: DataFrame, run: Run) -> DataFrame:
    """Predicted class per window, for all drives in one job: (serial_number, position, prediction). ``failure`` is not needed."""
    vectors = vectors_of(scored_windows(df, run), run.config, run.pca).select("serial_number", "position", "vector")
    scored = run.model.transform(vectors)
    return scored.select("serial_number", "position", F.col("prediction").cast("int").alias("prediction"))


def score_drive(df: DataFrame, serial, run: Run) -> DataFrame:
    return score(df.filter(F.col("serial_number") == F.lit(serial)), run)


def transfer_train(relevant: DataFrame, irrelevant: DataFrame, test: DataFrame, learner: str, params: dict | None = None,
                   seed: int = 42, keys=("vec_id",)) -> Trained:
    """Train on relevant models, then go on with the others.

    Networks start the second fit from the first one's weights; other learners are fitted on both.
    """
    if learner not in ("mlp", "mlp_two_layer", "dense_net"):
        return train_and_evaluate(relevant.unionByName(irrelevant), test, learner, params, folds=None, seed=seed, keys=keys)
    first = train_and_evaluate(relevant, test, learner, params, folds=None, seed=seed, keys=keys)
    learnt = first.model.stages[-1].weights
    return train_and_evaluate(irrelevant, test, learner, {**(params or {}), "initialWeights": learnt}, folds=None, seed=seed, keys=keys)
