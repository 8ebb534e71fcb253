"""Base of the classifiers that are fitted by passes over stored rows: pipeline stages with their state as text."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a model looks at together; what it makes of a row may be many times the row.
AT_ONCE = 512


def option(name: str, doc: str, kind=None) -> Param:
    return Param(Params._dummy(), name, doc, kind or TypeConverters.identity)


class ArrayModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted two-class model; ``margins`` gives a number per row of a matrix, positive for class 1."""

    state = option("state", "fitted values as JSON", TypeConverters.toString)
    numClasses = 2

    def __init__(self, facts: dict | None = None):
        super().__init__()
        if facts is not None:
            self._set(state=json.dumps(facts))

    @property
    def facts(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @staticmethod
    def prepared(facts: dict):
        """What ``margins`` works with; made once per task."""
        return facts

    @staticmethod
    def margins(ready, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def margin(self, vector: Column) -> Column:
        facts, kind = self.facts, type(self)

        @F.pandas_udf("double")
        def score(batches: "pd.Series") -> "pd.Series":
            ready, rows = kind.prepared(facts), batches.to_numpy()
            return pd.Series(np.concatenate([np.zeros(0), *[kind.margins(ready, np.stack(rows[a:a + AT_ONCE])) for a in range(0, len(rows), AT_ONCE)]]), dtype=float)
        return score(vector_to_array(vector))

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("_margin", self.margin(F.col("vector")))
        m = F.col("_margin")
        return scored.withColumns({"rawPrediction": array_to_vector(F.array(-m, m)), "prediction": (m > 0).cast("double")}).drop("_margin")


class ArrayEstimator(Estimator):
    """Options as pipeline parameters, so that searches can set them; ``vector`` and ``label`` are fixed column names."""

    seed = option("seed", "seed of all draws", TypeConverters.toInt)
    weightCol = option("weightCol", "column of row weights, or nothing")

    def __init__(self, **params):
        super().__init__()
        self._setDefault(seed=42, weightCol=None, **self.DEFAULTS)
        self._set(**params)

    DEFAULTS: dict = {}

    def setSeed(self, seed: int):
        return self._set(seed=seed)

    def setWeightCol(self, name: str):
        return self._set(weightCol=name)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))
