"""Support vector machines with kernels: explicit feature maps ahead of Spark's linear solver.

``rbf``: random Fourier features, pairs of cosine and sine. ``poly``: tensor sketch, the product of count sketches in the frequency domain.
``sigmoid``: tanh z as z - z^3/3 + 2 z^5/15, its first term exact and the others sketched; the second enters with a minus sign, so
the map spans the kernel's functions although the kernel has no feature map of its own. It holds for |z| up to about 1.
With 8,192 features, kernel values are within 0.15 of the exact ones: for poly in units of (gamma |x| |y| + coef0) ** degree and for sigmoid in units
of (gamma |x| |y|) ** 5, where these are above 1.
A map depends on its seed and the number of input columns only, so every task makes the same one.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlescope.ml.models import AT_ONCE, ArrayEstimator, ArrayModel, option
from spindlescope.ml.passes import block_sums, stored_rows

KERNELS = ("linear", "poly", "rbf", "sigmoid")
SIGMOID_TERMS = ((3, 1 / 3), (5, 2 / 15))


@functools.lru_cache(maxsize=8)
def frequencies(d: int, pairs: int, seed: int) -> np.ndarray:
    """Standard normal draws (d, pairs), one generator per input column."""
    return np.stack([np.random.default_rng([seed, j]).standard_normal(pairs) for j in range(d)])


@functools.lru_cache(maxsize=16)
def sketches(d: int, degree: int, size: int, seed: int) -> list[np.ndarray]:
    """Count sketches (d, size), one per factor of the product: each input column goes to one drawn place with a drawn sign."""
    out = []
    for k in range(degree):
        m = np.zeros((d, size))
        for j in range(d):
            rng = np.random.default_rng([seed, degree, k, j])
            m[j, rng.integers(size)] = rng.choice((-1.0, 1.0))
        out.append(m)
    return out


def power_sketch(x: np.ndarray, degree: int, size: int, seed: int) -> np.ndarray:
    """Rows whose products estimate (x y) ** degree without bias."""
    product = 1.0
    for m in sketches(x.shape[1], degree, size, seed):
        product = product * np.fft.rfft(x @ m, axis=1)
    return np.fft.irfft(product, size, axis=1)


def mapped(x: np.ndarray, kernel: str, gamma: float, degree: int = 3, coef0: float = 0.0, features: int = 1024, seed: int = 42) -> np.ndarray:
    """The feature map of every row."""
    if kernel == "linear":
        return x
    if kernel == "rbf":
        angle = x @ (frequencies(x.shape[1], features // 2, seed) * np.sqrt(2.0 * gamma))
        return np.hstack([np.cos(angle), np.sin(angle)]) / np.sqrt(features // 2)
    scaled = x * np.sqrt(gamma)
    if kernel == "poly":
        if coef0 < 0:
            raise ValueError("coef0 must not be negative")
        return power_sketch(np.hstack([scaled, np.full((len(x), 1), np.sqrt(coef0))]), degree, features, seed)
    if kernel == "sigmoid":
        if coef0:
            raise ValueError("the sigmoid kernel takes no coef0")
        return np.hstack([scaled, *[np.sqrt(c) * power_sketch(scaled, p, features // 2, seed) for p, c in SIGMOID_TERMS]])
    raise ValueError(f"unknown kernel: {kernel}")


def signs(kernel: str, d: int, features: int) -> np.ndarray | float:
    """With which signs products of mapped rows add up to the kernel."""
    if kernel != "sigmoid":
        return 1.0
    return np.r_[np.ones(d), -np.ones(features // 2), np.ones(features // 2)]


def scale_gamma(rows: DataFrame) -> float:
    """1 / (columns * variance of all entries) of stored rows; 1 where nothing varies."""
    n, total = block_sums(rows, lambda x, rest: np.array([x.size, x.sum()]), 2)
    d = len((rows.first() or {"x": [0.0]})["x"])
    mean = total / max(n, 1.0)
    variance = block_sums(rows, lambda x, rest: np.array([((x - mean) ** 2).sum()]), 1)[0] / max(n, 1.0)
    return 1.0 / (d * variance) if variance > 0 else 1.0


class KernelSVMModel(ArrayModel):
    """A hyperplane in the mapped space."""

    @staticmethod
    def margins(facts, x):
        return mapped(x, **facts["map"]) @ np.array(facts["coefficients"]) + facts["intercept"]


class KernelSVM(ArrayEstimator):
    """Hinge loss with strength ``C`` as in C times the sum of the losses; ``gamma`` is a number or ``scale``."""

    C = option("C", "weight of the losses")
    kernel = option("kernel", "linear, poly, rbf or sigmoid")
    gamma = option("gamma", "factor of the inner product, or of the squared distance; scale: from the data")
    degree = option("degree", "power of the poly kernel")
    coef0 = option("coef0", "what poly adds to the inner product")
    features = option("features", "length of the mapped rows")
    maxIter = option("maxIter", "steps of the solver")
    DEFAULTS = {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3, "coef0": 0.0, "features": 1024, "maxIter": 100}

    def _fit(self, df: DataFrame) -> KernelSVMModel:
        weight = self.value("weightCol")
        rows = stored_rows(df, "label", *([weight] if weight else []))
        gamma = self.value("gamma")
        facts = {"kernel": self.value("kernel"), "gamma": scale_gamma(rows) if gamma == "scale" else float(gamma), "degree": int(self.value("degree")),
                 "coef0": float(self.value("coef0")), "features": int(self.value("features")), "seed": int(self.value("seed"))}
        made = mapped_rows(rows, facts).withColumn("_mapped", array_to_vector("_mapped"))
        solver = LinearSVC(featuresCol="_mapped", labelCol="label", regParam=1.0 / (self.value("C") * max(rows.count(), 1)), standardization=False, maxIter=self.value("maxIter"))
        found = (solver.setWeightCol(weight) if weight else solver).fit(made)
        return KernelSVMModel({"map": facts, "coefficients": found.coefficients.toArray().tolist(), "intercept": float(found.intercept)})


def mapped_rows(rows: DataFrame, facts: dict) -> DataFrame:
    """Stored rows with their feature map in ``_mapped`` instead of ``x``; a task holds the maps of AT_ONCE rows."""
    kept = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                m = mapped(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), **facts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], lists], [*[f.name for f in kept], "_mapped"])
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_mapped", T.ArrayType(T.DoubleType()))]))


def kernel_values(pairs: DataFrame, left: str, right: str, facts: dict, out: str = "approximate") -> DataFrame:
    """Add what the mapped rows of two columns of arrays give for the kernel of each pair."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        out = []
        for i in range(0, len(a), AT_ONCE):
            x, y = np.stack(a[i:i + AT_ONCE].to_numpy()), np.stack(b[i:i + AT_ONCE].to_numpy())
            out.append((mapped(x, **facts) * mapped(y, **facts) * signs(facts["kernel"], x.shape[1], facts["features"])).sum(axis=1))
        return pd.Series(np.concatenate(out))
    return pairs.withColumn(out, run(left, right))
