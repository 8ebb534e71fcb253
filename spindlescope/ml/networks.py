"""Feed-forward networks trained by data-parallel gradients, with row weights."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.ml.models import ArrayEstimator, ArrayModel, option
from spindlescope.ml.passes import block_sums
from spindlescope.session import cut_lineage

#: Adam's decay rates and floor.
FIRST, SECOND, FLOOR = 0.9, 0.999, 1e-8
#: Steps without an improvement of TOLERANCE after which training ends.
PATIENCE, TOLERANCE = 10, 1e-4


def shapes(layers: list[int]) -> list[tuple[int, int]]:
    return [(a + 1, b) for a, b in zip(layers, layers[1:])]


def unpacked(flat: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """Weight matrices of the layers, their last row the bias."""
    out, at = [], 0
    for a, b in shapes(layers):
        out.append(flat[at:at + a * b].reshape(a, b))
        at += a * b
    return out


def initial(layers: list[int], seed: int) -> np.ndarray:
    """Uniform weights by the layers' widths, biases 0."""
    rng, out = np.random.default_rng(seed), []
    for a, b in shapes(layers):
        m = rng.uniform(-1.0, 1.0, (a, b)) * np.sqrt(6.0 / (a - 1 + b))
        m[-1] = 0.0
        out.append(m.ravel())
    return np.concatenate(out)


def forward(flat: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer and the margin of class 1 at the end."""
    seen = [x]
    weights = unpacked(flat, layers)
    for i, m in enumerate(weights):
        z = seen[-1] @ m[:-1] + m[-1]
        seen.append(np.maximum(z, 0.0) if i < len(weights) - 1 else z)
    return seen


def weighted_gradient(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the rows: weight times logistic loss, weights, and the gradient."""
    seen, weights = forward(flat, layers, x), unpacked(flat, layers)
    margin = seen[-1][:, 0]
    loss = w @ (np.logaddexp(0.0, margin) - y * margin)
    delta = (w * (0.5 * (1.0 + np.tanh(0.5 * margin)) - y))[:, None]
    grads = []
    for i in range(len(weights) - 1, -1, -1):
        grads.append(np.vstack([seen[i].T @ delta, delta.sum(axis=0)]).ravel())
        if i:
            delta = (delta @ weights[i][:-1].T) * (seen[i] > 0)
    return np.concatenate([[loss, w.sum()], *grads[::-1]])


class NetworkModel(ArrayModel):
    """A fitted network; its margin is the logit of class 1."""

    @staticmethod
    def prepared(facts):
        return facts["layers"], np.array(facts["weights"]), np.array(facts["middle"]), np.array(facts["scale"])

    @staticmethod
    def margins(ready, x):
        layers, flat, middle, scale = ready
        return forward(flat, layers, (x - middle) * scale)[-1][:, 0]


class Network(ArrayEstimator):
    """Rectified layers of the widths ``hidden``, one logit, mean weighted logistic loss plus ``alpha`` / 2 times the squared weights.

    Inputs are standardised. A step is one pass: every task sums the weighted gradients of its rows, the driver holds the parameters and
    Adam's two averages of them, whatever the number of rows. Ends after ``maxIter`` steps or when the loss stands still.
    """

    hidden = option("hidden", "widths of the hidden layers")
    maxIter = option("maxIter", "steps at most")
    stepSize = option("stepSize", "Adam's step")
    alpha = option("alpha", "l2 penalty")
    DEFAULTS = {"hidden": (100,), "maxIter": 200, "stepSize": 0.02, "alpha": 1e-4}

    def _fit(self, df: DataFrame) -> NetworkModel:
        weight = self.value("weightCol")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = cut_lineage(df.select(vector_to_array("vector").alias("x"), F.col("label").cast("double").alias("label"), w.alias("w")))
        d = len((rows.first() or {"x": []})["x"])
        sums = block_sums(rows, lambda x, rest: np.r_[rest["w"].sum(), rest["w"] @ x], 1 + d)
        middle = sums[1:] / max(sums[0], 1e-300)
        spread = np.sqrt(block_sums(rows, lambda x, rest: rest["w"] @ np.square(x - middle), d) / max(sums[0], 1e-300))
        scale = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)
        layers = [d, *map(int, self.value("hidden")), 1]
        flat = initial(layers, self.value("seed"))
        bias = np.concatenate([np.r_[np.zeros((a - 1) * b), np.ones(b)] for a, b in shapes(layers)]) > 0
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        best, waited, kept = np.inf, 0, flat
        for step in range(1, self.value("maxIter") + 1):
            now = flat
            s = block_sums(rows, lambda x, rest: weighted_gradient(now, layers, (x - middle) * scale, rest["label"], rest["w"]), 2 + len(flat))
            penalised = np.where(bias, 0.0, flat) * self.value("alpha")
            loss = s[0] / max(s[1], 1e-300) + 0.5 * (penalised * flat).sum()
            gradient = s[2:] / max(s[1], 1e-300) + penalised
            waited = 0 if loss < best - TOLERANCE else waited + 1
            if loss < best:
                best, kept = loss, flat
            if waited >= PATIENCE:
                break
            first, second = FIRST * first + (1 - FIRST) * gradient, SECOND * second + (1 - SECOND) * gradient ** 2
            flat = flat - self.value("stepSize") * (first / (1 - FIRST ** step)) / (np.sqrt(second / (1 - SECOND ** step)) + FLOOR)
        return NetworkModel({"layers": layers, "weights": kept.tolist(), "middle": middle.tolist(), "scale": scale.tolist(), "loss": float(best)})
