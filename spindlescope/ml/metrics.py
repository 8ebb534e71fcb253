"""Classification metrics as single aggregates over (truth, prediction) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.session import cut_lineage

#: Rows per group of the silhouette, rows of a group and of the other side that are compared at once.
TILE, SLAB, PIECE = 8192, 64, 2048
#: Groups of a small table, and rows per group there.
FEW_TILES, SMALL_TILE = 32, 1024


def _count(truth: str, predicted: str, t: int, p: int) -> Column:
    return F.count_if((F.col(truth) == t) & (F.col(predicted) == p))


def _cells(truth: str, predicted: str) -> dict[str, Column]:
    return {"tp": _count(truth, predicted, 1, 1), "fp": _count(truth, predicted, 0, 1),
            "tn": _count(truth, predicted, 0, 0), "fn": _count(truth, predicted, 1, 0)}


def confusion(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in _cells(truth, predicted).items()])


def _share(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def report_metrics(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """RMSE, MAE, FDR, FAR, F1, recall, precision, accuracy and the AUC of hard labels in one row.

    FDR is the false discovery rate fp / (fp + tp); recall is the detection rate.
    """
    cells = _cells(truth, predicted)
    tp, fp, tn, fn = (cells[k] for k in ("tp", "fp", "tn", "fn"))
    gap = F.col(truth).cast("double") - F.col(predicted).cast("double")
    recall, far = _share(tp, tp + fn), _share(fp, fp + tn)
    return df.agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
        _share(fp, fp + tp).alias("fdr"), far.alias("far"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        recall.alias("recall"), _share(tp, tp + fp).alias("precision"),
        _share(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((recall + 1 - far) / 2).alias("auc_hard"))


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, truth: str = "label", probability: str = "p1", eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped to [eps, 1 - eps]."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(probability)))
    return df.agg(F.avg(-F.when(F.col(truth) == 1, F.ln(p)).otherwise(F.ln(1.0 - p))).alias("log_loss"))


def auc_score(df: DataFrame, truth: str = "label", raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=truth, rawPredictionCol=raw).evaluate(df)


def silhouette(df: DataFrame, labels: str = "prediction", vector: str = "vector") -> float | None:
    """Silhouette of unsupervised labels in squared Euclidean distance; None with fewer than two labels."""
    used = df.withColumn("_l", F.col(labels).cast("int"))
    if used.select("_l").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(predictionCol="_l", featuresCol=vector, metricName="silhouette").evaluate(used)


def _distances(left: np.ndarray, right: np.ndarray, spare: np.ndarray) -> np.ndarray:
    if left.shape[1] > 4:
        return np.sqrt(np.maximum((left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1) - 2.0 * (left @ right.T), 0.0))
    # written over two small buffers, which stay in the cache
    total, gap = (s[:len(left) * len(right)].reshape(len(left), len(right)) for s in spare)
    total[:] = 0.0
    for f in range(left.shape[1]):
        np.subtract(left[:, f, None], right[:, f], out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return np.sqrt(total, out=total)


class _Sides:
    """Rows of a group, and what is known of them while the clusters come by one after the other."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        x, self.own, self.copies = (np.concatenate(p) for p in zip(*parts))
        self.middle = x.mean(axis=0)
        self.x = x - self.middle
        self.within, self.size, self.other = np.zeros(len(x)), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        self.open, self.sums, self.n = None, np.zeros(len(x)), 0
        self.spare = np.empty((2, SLAB * PIECE))

    def close(self) -> None:
        if self.open is not None:
            same = self.own == self.open
            self.within[same], self.size[same] = self.sums[same], self.n
            self.other = np.where(same, self.other, np.minimum(self.other, self.sums / self.n))

    def meet(self, right: np.ndarray, cluster: np.ndarray, copies: np.ndarray) -> None:
        """The next rows of the other side, sorted by cluster."""
        right = right - self.middle
        for a in range(0, len(right), PIECE):
            part, names, times = right[a:a + PIECE], cluster[a:a + PIECE], copies[a:a + PIECE]
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            sums, weighed = np.empty((len(self.x), len(first))), bool((times != 1).any())
            for b in range(0, len(self.x), SLAB):
                d = _distances(self.x[b:b + SLAB], part, self.spare)
                if weighed:
                    d *= times
                sums[b:b + SLAB] = np.add.reduceat(d, first, axis=1)
            counts = np.add.reduceat(times, first)
            for i, name in enumerate(names[first].tolist()):
                if name != self.open:
                    self.close()
                    self.open, self.sums, self.n = name, sums[:, i].copy(), int(counts[i])
                else:
                    self.sums += sums[:, i]
                    self.n += int(counts[i])

    def batch(self) -> pa.RecordBatch:
        self.close()
        known = np.isfinite(self.other)
        return pa.RecordBatch.from_arrays([pa.array(self.copies), pa.array(self.size), pa.array(self.within), pa.array(self.other, mask=~known)], ["copies", "n", "total", "b"])


def _meet_sides(batches):
    group, left, sides = None, [], None
    for batch in batches:
        i, right = (batch.column(c).to_numpy() for c in ("i", "right"))
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        cluster, copies = (batch.column(c).to_numpy() for c in ("cluster", "copies"))
        border = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (right[1:] != right[:-1])])
        for a, b in zip(border, [*border[1:], len(i)]):
            if i[a] != group:
                if sides:
                    yield sides.batch()
                group, left, sides = i[a], [], None
            if not right[a]:
                left.append((x[a:b], cluster[a:b], copies[a:b]))
            elif left or sides:
                if sides is None:
                    sides, left = _Sides(left), []
                sides.meet(x[a:b], cluster[a:b], copies[a:b])
    if sides:
        yield sides.batch()


def euclidean_silhouette(df: DataFrame, labels: str = "prediction", vector: str = "vector", tile: int = TILE) -> DataFrame:
    """Mean silhouette in plain Euclidean distance, and the rows it is over: (records, silhouette).

    Equal rows of a label are counted and compared once. The others are dealt out to groups of about ``tile``; all rows come by each group
    in the order of their clusters, and its task keeps, per row of the group, the sum of the open cluster, that of the row's own and the least
    mean of another. Distances do not cancel like squared ones, so all pairs of rows are computed, but none is stored, and no sum is
    shuffled. A row alone in its cluster scores 0; with fewer than two clusters the score is null.
    """
    v = F.col(vector) if dict(df.dtypes)[vector].startswith("array") else vector_to_array(vector)
    rows = df.select(v.cast("array<double>").alias("v"), F.col(labels).cast("int").alias("cluster")).where("v IS NOT NULL AND cluster IS NOT NULL")
    distinct = cut_lineage(rows.groupBy("v", "cluster").agg(F.count(F.lit(1)).alias("copies")))
    count = distinct.count()
    groups = max(1, -(-count // tile), min(FEW_TILES, -(-count // SMALL_TILE)))
    left = distinct.withColumns({"i": F.pmod(F.xxhash64("v", "cluster"), F.lit(groups)).cast("int"), "right": F.lit(0)})
    right = distinct.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "right": F.lit(1)})
    both = left.unionByName(right).repartition(groups, "i").sortWithinPartitions("i", "right", "cluster")
    means = both.mapInArrow(_meet_sides, "copies long, n long, total double, b double").withColumn("a", F.try_divide("total", F.col("n") - 1))
    score = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.when(F.col("b").isNotNull(), 0.0)))
    return means.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("records"),
                     F.when(F.count("b") > 0, F.sum(score * F.col("copies")) / F.sum("copies")).alias("silhouette"))
