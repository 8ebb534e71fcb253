import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlescope.operators import ordering as od
from spindlescope.session import lookup_join


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows are one value in one class."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.pmod(F.col("id") * 7919, F.lit(1009)) / 7).otherwise(0.0).alias("value"),
        (F.col("id") % 10 == 0).cast("int").alias("label"))


@pytest.mark.parametrize("single", [10**6, 0])
def test_running_totals_agree_in_one_and_in_many_ranges(skewed, monkeypatch, single):
    monkeypatch.setattr(od, "SINGLE_RANGE_ROWS", single)
    counts = od.value_counts(skewed, [], ["value"])
    got = {r["value"]: r["cum_n"] for r in od.running_totals(counts, ["feature"], "value", ["n"]).collect()}
    values = np.array([r["value"] for r in skewed.select("value").collect()])
    assert got == {v: int((values <= v).sum()) for v in np.unique(values)}


@pytest.mark.parametrize("single", [10**6, 0])
def test_quantiles_are_exact(skewed, monkeypatch, single):
    monkeypatch.setattr(od, "FEW_ROWS", single)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["label"]: r for r in od.exact_quantiles(skewed, ["label"], ["value"], probs).collect()}
    for label in (0, 1):
        values = [r["value"] for r in skewed.filter(F.col("label") == label).collect()]
        assert [got[label][p] for p in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


@pytest.mark.parametrize("single", [10**6, 50, 0])
@pytest.mark.parametrize("sketch", [10_000, 3])
def test_narrowed_ranges_hold_the_quantiles_of_hard_columns(spark, monkeypatch, single, sketch):
    """Heavy ties, one value only, huge spread, infinities, negative numbers, nulls; a sketch of almost no accuracy too."""
    monkeypatch.setattr(od, "FEW_ROWS", single)
    monkeypatch.setattr(od, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    n = 1500
    cols = {
        "ties": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 40, n).astype(float)), "same": np.full(n, -2.5),
        "spread": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n), "ends": np.where(rng.random(n) < 0.1, np.inf, rng.normal(size=n)),
    }
    rows = [("x" if i % 3 else "y", *[None if i % 17 == 0 and c != "ends" else float(v[i]) for c, v in cols.items()]) for i in range(n)]
    df = spark.createDataFrame(rows, "kind string, ties double, same double, spread double, ends double").repartition(5)
    probs = {"low": 0.0, "q": 0.25, "mid": 0.5, "odd": 0.837, "top": 1.0}
    got = {(r["kind"], r["feature"]): r for r in od.exact_quantiles(df, ["kind"], list(cols), probs).collect()}
    assert len(got) == 8
    for k in "xy":
        for at, c in enumerate(cols, start=1):
            values = np.sort([r[at] for r in rows if r[0] == k and r[at] is not None])
            for name, q in probs.items():
                spot = (len(values) - 1) * q
                lo, hi = values[int(np.floor(spot))], values[int(np.ceil(spot))]
                if spot == np.floor(spot):
                    assert got[k, c][name] == lo
                elif np.isfinite(lo) and np.isfinite(hi):
                    assert got[k, c][name] == pytest.approx(lo + (hi - lo) * (spot - np.floor(spot)), rel=1e-12)


def test_quantiles_of_no_rows_are_no_rows(spark):
    empty = spark.createDataFrame([("x", None)], "kind string, v double")
    assert od.exact_quantiles(empty, ["kind"], ["v"], {"m": 0.5}).collect() == []


def test_hash_choice_is_exact_and_repeatable(spark, skewed):
    picked = od.pick_by_hash(skewed, ["label"], ["id"], 1, lambda n: F.floor(n * 0.3))
    counts = {r["label"]: r["count"] for r in picked.filter("picked").groupBy("label").count().collect()}
    assert counts == {0: 810, 1: 90}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = od.pick_by_hash(skewed.repartition(5), ["label"], ["id"], 1, lambda n: F.floor(n * 0.3))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["id"] for r in picked.filter("picked").collect()} == {r["id"] for r in again.filter("picked").collect()}


def test_quota_zero_and_quota_above_the_class(skewed):
    assert od.pick_by_hash(skewed, [], ["id"], 1, lambda n: F.lit(0)).filter("picked").count() == 0
    assert od.pick_by_hash(skewed, [], ["id"], 1, lambda n: n + 5).filter("picked").count() == 3000


def test_lookup_join_beyond_the_bound_gives_the_same_rows(spark):
    a, b = spark.range(100).withColumn("v", F.col("id") * 2), spark.range(50).withColumn("w", F.col("id") + 1)
    small = lookup_join(a, b, ["id"]).collect()
    large = lookup_join(a, b, ["id"], max_rows=10).collect()
    assert sorted(small) == sorted(large) and len(small) == 50
