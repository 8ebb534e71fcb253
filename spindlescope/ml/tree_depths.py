"""Search over decision trees: a tree of smaller depth is the deeper one cut off, so one fit per fold judges all depths."""

from __future__ import annotations

import json
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.ml.passes import block_sums
from spindlescope.session import cut_lineage, ensure_checkpoint_dir


def tree_arrays(spark: SparkSession, model) -> dict[str, np.ndarray]:
    """A fitted tree as arrays by node, the root first; ``feature`` is -1 at a leaf, and every node has its ``prediction``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).orderBy("id").toArrow()
    inner = nodes["leftChild"].to_numpy() >= 0
    return {"prediction": nodes["prediction"].to_numpy(), "left": nodes["leftChild"].to_numpy(), "right": nodes["rightChild"].to_numpy(),
            "feature": np.where(inner, nodes["feature"].to_numpy(), -1), "cut": np.where(inner, nodes["cut"].to_numpy(), 0.0)}


def depth_counts(tree: dict[str, np.ndarray], x: np.ndarray, label: np.ndarray, deepest: int) -> np.ndarray:
    """(depth, 3): true positives, false positives and false negatives of the tree cut off at every depth."""
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    out = np.zeros((deepest + 1, 3))
    for depth in range(deepest + 1):
        said, true = tree["prediction"][at] == 1.0, label == 1.0
        out[depth] = (said & true).sum(), (said & ~true).sum(), (~said & true).sum()
        f = tree["feature"][at]
        left = x[rows, np.maximum(f, 0)] <= tree["cut"][at]
        at = np.where(f >= 0, np.where(left, tree["left"][at], tree["right"][at]), at)
    return out


def tree_scores(folded: DataFrame, combos: list[dict], folds: int, build, parallelism: int, fold_col: str = "_fold3") -> list[float]:
    """Mean F1 of class 1 over the folds for every combination. ``build`` makes the estimator of one."""
    spark = folded.sparkSession
    folded = cut_lineage(folded)
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(combos):
        groups.setdefault(json.dumps({k: v for k, v in c.items() if k != "maxDepth"}, sort_keys=True), []).append(i)

    @inheritable_thread_target(spark)
    def one(job) -> np.ndarray:
        members, fold, train, held = job
        deepest = max(combos[i]["maxDepth"] for i in members)
        tree = tree_arrays(spark, build({**combos[members[0]], "maxDepth": deepest}).fit(train))
        tp, fp, fn = block_sums(held, lambda x, rest: depth_counts(tree, x, rest["label"], deepest), 3 * (deepest + 1)).reshape(-1, 3).T
        f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros(len(tp)), where=tp > 0)
        return np.array([f1[combos[i]["maxDepth"]] for i in members])

    total = np.zeros(len(combos))
    for fold in range(folds):
        train = folded.filter(F.col(fold_col) != fold).cache()
        held = folded.filter(F.col(fold_col) == fold).select(vector_to_array("vector").alias("x"), "label").cache()
        with ThreadPool(parallelism) as pool:
            for members, scores in zip(groups.values(), pool.map(one, [(m, fold, train, held) for m in groups.values()])):
                total[members] += scores
        train.unpersist()
        held.unpersist()
    return (total / folds).tolist()
