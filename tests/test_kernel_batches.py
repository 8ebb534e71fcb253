import numpy as np
from pyspark.ml.functions import array_to_vector

from spindlescope.ml import kernels as kn
from spindlescope.ml import models as md


def test_maps_and_margins_of_few_rows_at_once(spark, monkeypatch):
    """The feature map of a row is many times the row: no call may see a whole batch."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 3))
    facts = {"kernel": "rbf", "gamma": 0.3, "degree": 3, "coef0": 0.0, "features": 64, "seed": 42}
    rows = spark.createDataFrame([(v.tolist(), float(i)) for i, v in enumerate(x)], "x array<double>, label double").coalesce(1)
    real = kn.mapped

    def small(part, **kw):
        assert len(part) <= md.AT_ONCE
        return real(part, **kw)
    monkeypatch.setattr(kn, "mapped", small)
    got = sorted(kn.mapped_rows(rows, facts).collect(), key=lambda r: r["label"])
    assert np.allclose([r["_mapped"] for r in got], real(x, **facts))

    class Few(md.ArrayModel):
        @staticmethod
        def margins(ready, part):
            return np.full(len(part), float(len(part)))
    seen = rows.select(Few({}).margin(array_to_vector("x")).alias("n")).collect()
    assert len(seen) == 1500 and max(r["n"] for r in seen) <= md.AT_ONCE
