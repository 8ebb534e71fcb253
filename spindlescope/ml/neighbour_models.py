"""Nearest-neighbour voting, density clustering and isolation forest as Spark jobs."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindlescope.operators.neighbours import Neighbourhood, knn_join
from spindlescope.operators.ordering import exact_quantiles
from spindlescope.session import cut_lineage, lookup_join, split_join, written

#: Rows that a tree's first draw has beyond its sample, in standard deviations of that draw; it falls short less than once in a billion trees.
SPARE = 6.0


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", id_col: str = "vec_id",
                 vec: str = "vec", label: str = "label", metric: str = "euclidean") -> DataFrame:
    """Vote of the ``k`` nearest training rows: (id, prediction, p1). Ties go to the smaller label.

    ``distance`` weights votes by 1 / distance; an exact match outvotes everything else.
    """
    near = knn_join(test, train, k, id_col=id_col, vec=vec, metric=metric)
    # one training row may be near to a third of all rows
    votes = split_join(cut_lineage(near), train.select(F.col(id_col).alias("neighbour"), F.col(label).alias("_l")), ["neighbour"])
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(id_col))
    if weights == "uniform":
        w = F.lit(1.0)
    elif weights == "distance":
        w = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        raise ValueError(f"unknown weights: {weights}")
    sums = votes.withColumn("_vote", w).groupBy(id_col, "_l").agg(F.sum("_vote").alias("_vote"))
    best = F.min_by("_l", F.struct(-F.col("_vote"), F.col("_l")))
    p1 = F.sum(F.when(F.col("_l") == 1, F.col("_vote")).otherwise(0.0)) / F.sum("_vote")
    return sums.groupBy(id_col).agg(best.alias("prediction"), p1.alias("p1"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node per node: (_key, _root). Labels jump to their label's label each round.

    Every round joins the edges to labels, and labels to their labels, and is written to shared storage. Hubs and labels
    that many nodes have are split.
    """
    both = written(edges.select("_a", "_b").union(edges.select("_b", "_a")).distinct())
    labels = written(nodes.select("_key", F.col("_key").alias("_root")))
    while True:
        heard = split_join(both.withColumnRenamed("_b", "_key"), labels, ["_key"]).groupBy("_a").agg(F.min("_root").alias("_m"))
        lower = written(labels.join(heard, labels["_key"] == heard["_a"], "left").select(
            "_key", F.col("_root").alias("_old"), F.least("_root", F.coalesce("_m", "_root")).alias("_new")))
        roots = lower.select(F.col("_key").alias("_new"), F.col("_new").alias("_jump"))
        moved = split_join(lower, roots, ["_new"]).select("_key", "_old", F.least("_new", "_jump").alias("_root"))
        moved = written(moved)
        labels = moved.select("_key", "_root")
        if not moved.filter("_root <> _old").limit(1).count():
            return labels


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, id_col: str = "vec_id", vec: str = "vec",
           metric: str = "euclidean") -> DataFrame:
    """Density clusters: (id, cluster, core). Noise is -1; clusters are numbered by their smallest id.

    A border row joins the core cluster with the smallest root among those it touches.
    """
    space = Neighbourhood(df, eps, vec, metric)
    weighed = cut_lineage(space.points.join(space.weights(), "_key"))
    core = weighed.filter(F.col("_weight") >= min_samples)
    roots = components(space.forest(core), core)
    edge = weighed.filter(F.col("_weight") < min_samples)
    touch = cut_lineage(space.touching(edge, core).select(F.col("_key").alias("_edge"), F.col("_near").alias("_key")))
    border = split_join(touch, roots, ["_key"]).groupBy(F.col("_edge").alias("_key")).agg(F.min("_root").alias("_root"))
    placed = roots.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    rows = cut_lineage(split_join(space.rows.select(id_col, "_key"), placed, ["_key"], "left"))
    first = rows.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(id_col).alias("cluster"))
    return lookup_join(rows, first, ["_root"], "left").select(
        id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


def _average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def path_lengths(trees, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the path length of every row."""
    rows, total = np.arange(len(x)), np.zeros(len(x))
    for feature, cut, extra in trees:
        node = np.zeros(len(x), dtype=int)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(feature[node], 0)] >= cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += extra[node]
    return total


@dataclasses.dataclass(frozen=True)
class IsolationForestModel:
    """Trees as flat arrays; their size is trees * 2 * sample nodes, whatever the training rows."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    sample: int
    threshold: float

    def score(self, df: DataFrame, vec: str = "vec", out: str = "anomaly") -> DataFrame:
        """Anomaly score in (0, 1]: 2^(-mean path / expected path)."""
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(self.trees)
        expected = float(_average_path(self.sample)) or 1.0

        @F.pandas_udf(T.DoubleType())
        def anomaly(vectors: pd.Series) -> pd.Series:
            x = np.vstack([np.asarray(v, dtype=float) for v in vectors])
            return pd.Series(np.power(2.0, -path_lengths(shared.value, x) / len(shared.value) / expected))

        return df.withColumn(out, anomaly(F.col(vec)))

    def predict(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """-1 for rows scored above the threshold, 1 for the rest."""
        return self.score(df, vec).withColumn("prediction", F.when(F.col("anomaly") > self.threshold, -1).otherwise(1))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator, max_features: int):
    """One tree over a bounded sample, as a heap of (feature or -1, cut, path length)."""
    size = 2 ** (limit + 1) - 1
    feature, cut, path = np.full(size, -1), np.zeros(size), np.zeros(size)
    allowed = np.sort(rng.choice(x.shape[1], max_features, replace=False))
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        spread = allowed[np.ptp(x[rows][:, allowed], axis=0) > 0] if len(rows) > 1 else allowed[:0]
        if depth == limit or not len(spread):
            path[node] = depth + float(_average_path(len(rows)))
            continue
        f = int(rng.choice(spread))
        low, high = x[rows, f].min(), x[rows, f].max()
        at = low + (high - low) * (1.0 - rng.random())
        right = x[rows, f] >= at
        feature[node], cut[node] = f, at
        todo += [(2 * node + 1, rows[~right], depth + 1), (2 * node + 2, rows[right], depth + 1)]
    return feature, cut, path


def isolation_forest(df: DataFrame, trees: int = 100, sample: int = 256, contamination: float | str = "auto",
                     max_features: float = 1.0, bootstrap: bool = False, seed: int = 42, id_col: str = "vec_id",
                     vec: str = "vec") -> IsolationForestModel:
    """Fit one tree per bounded sample, all trees in parallel.

    Every tree draws its ``sample`` rows from the whole table by a hash of row and tree: one scan keeps, for each tree, the rows
    below a cut-off that lets a few more through than are needed, and the smallest hashes of these are the sample.
    """
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    total = rows.count()
    size = min(sample, total)
    share = min(1.0, (size + SPARE * math.sqrt(size) + SPARE ** 2) / max(total, 1))
    cut = F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    hit = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col("_id"), t, F.lit(seed)) <= cut)
    copies = rows.withColumn("tree", F.explode(hit))
    by = Window.partitionBy("tree").orderBy("_o", "_id")
    drawn = copies.withColumn("_o", F.xxhash64("_id", "tree", F.lit(seed))).withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    schema = "tree int, feature array<int>, cut array<double>, path array<double>"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        x = np.vstack([np.asarray(v, dtype=float) for v in pdf["_v"]])
        rng = np.random.default_rng([seed, int(key[0])])
        if bootstrap:
            x = x[rng.integers(0, len(x), len(x))]
        width = max(1, int(max_features * x.shape[1])) if isinstance(max_features, float) else min(int(max_features), x.shape[1])
        feature, cut, path = _grow(x, limit, rng, width)
        return pd.DataFrame({"tree": [int(key[0])], "feature": [feature.astype("int32")], "cut": [cut], "path": [path]})

    fitted = drawn.groupBy("tree").applyInPandas(fit, schema).orderBy("tree").collect()
    model = IsolationForestModel([(np.array(r["feature"]), np.array(r["cut"]), np.array(r["path"])) for r in fitted], size, 0.5)
    if contamination == "auto":
        return model
    scores = cut_lineage(model.score(df, vec).select("anomaly"))
    cutoff = exact_quantiles(scores, [], ["anomaly"], {"q": 1.0 - float(contamination)}).first()["q"]
    return dataclasses.replace(model, threshold=cutoff)
