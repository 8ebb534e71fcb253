import numpy as np
import pytest
from conftest import day
from pyspark.sql import functions as F

from spindlescope.operators import sampling as sp


@pytest.fixture
def labelled(spark):
    rows = [(f"d{s:02d}", day(d), int(s % 5 == 0 and d == 9), int(s % 5 == 0 and d >= 7), float(s + d)) for s in range(20) for d in range(10)]
    return spark.createDataFrame(rows, "serial_number string, date date, failure int, predict_val int, smart_5_raw double").repartition(3)


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(int(i < 12), 1, 3)], int(i < 12), float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "vec_id long, vec array<double>, predict_val int, t double")


def test_drive_split_never_shares_a_drive(labelled):
    got = sp.split_by_drive(labelled, 0.3)
    per = got.groupBy("serial_number").agg(F.count_distinct("is_test").alias("sides"), F.max("failure").alias("f"), F.max(F.col("is_test").cast("int")).alias("t"))
    assert per.filter("sides > 1").count() == 0
    assert {r["f"]: r["n"] for r in per.filter("t = 1").groupBy("f").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 1}


def test_time_split_orders_the_sides(labelled):
    got = sp.split_by_time(labelled, 0.25)
    assert got.filter("NOT is_test").count() == 150
    late = got.filter("NOT is_test").agg(F.max("date")).first()[0]
    early = got.filter("is_test").agg(F.min("date")).first()[0]
    assert late <= early
    assert sp.split_by_time(labelled, 0.0).filter("is_test").count() == 0
    assert sp.split_by_time(labelled, 1.0).filter("NOT is_test").count() == 0


def test_row_split_keeps_class_shares_and_seeds(labelled):
    one = sp.split_random(labelled, 0.3, 1).filter("is_test")
    assert {r["predict_val"]: r["count"] for r in one.groupBy("predict_val").count().collect()} == {0: 57, 1: 4}
    two = sp.split_random(labelled, 0.3, 2).filter("is_test")
    assert set(one.select("serial_number", "date").collect()) != set(two.select("serial_number", "date").collect())


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_differ_by_at_most_one_row_per_class(labelled, k):
    counts = sp.stratified_kfold(labelled, k).groupBy("predict_val", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["predict_val"] == label]
        assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_synthetic_rows_lie_between_parent_and_neighbour(points):
    made = sp.smote(points, k=3).collect()
    vec = {r["vec_id"]: np.array(r["vec"]) for r in points.collect()}
    assert len(made) == 48 - 12
    for r in made:
        a, b, x = vec[r["parent"]], vec[r["neighbour"]], np.array(r["vec"])
        assert r["parent"] < 12 and r["neighbour"] < 12 and r["parent"] != r["neighbour"]
        u = (x - a) @ (b - a) / ((b - a) @ (b - a))
        assert -1e-9 <= u < 1 and np.allclose(a + u * (b - a), x)
    spread = [sum(m["parent"] == p for m in made) for p in range(12)]
    assert set(spread) == {3}


def test_balance_reaches_both_ratios_and_refuses_majority_over_minority(points):
    even = sp.balance(points, over=0.5, under=0.8, k=3)
    assert {r["predict_val"]: r["count"] for r in even.groupBy("predict_val").count().collect()} == {1: 24, 0: 30}
    assert even.select("vec_id").distinct().count() == even.count()
    with pytest.raises(ValueError):
        sp.balance(points, over=20)
    with pytest.raises(ValueError):
        sp.smote(points, k=12)


def test_time_slices_close_the_last_slice(points):
    got = sp.time_slices(points, "t", 10).groupBy("slice").count().collect()
    assert {r["slice"] for r in got} == set(range(10)) and {r["count"] for r in got} == {6}


def test_time_smote_stays_in_slice_and_skips_small_classes(points):
    made = sp.time_smote(points, "t", k=3, n_slices=5, label="predict_val").collect()
    by = {}
    for r in made:
        by[(r["slice"], r["predict_val"])] = by.get((r["slice"], r["predict_val"]), 0) + 1
        assert r["parent"] // 12 == r["neighbour"] // 12 == r["slice"]
    assert by == {(0, 1): (48 - 12) // 2}
    vec = {r["vec_id"]: np.array(r["vec"]) for r in points.collect()}
    for r in made:
        a, b = vec[r["parent"]], vec[r["neighbour"]]
        assert (np.array(r["vec"]) - a) @ (b - a) / ((b - a) @ (b - a)) < 0.5


@pytest.mark.parametrize("strategy,want", [
    ("minority", {1: 90}), ("not minority", {0: 0, 2: 40}), ("not majority", {1: 90, 2: 40}), ("all", {0: 0, 1: 90, 2: 40}),
    (0.5, {1: 40}), ({1: 7}, {1: 7}), ("auto", {})])
def test_sampling_targets(strategy, want):
    assert sp.sampling_targets({0: 100, 1: 10, 2: 60}, strategy) == want


def test_class_weights_default_to_one(labelled):
    got = sp.class_weights(labelled, {1: 0.3}).groupBy("predict_val").agg(F.max("weight").alias("w")).collect()
    assert {r["predict_val"]: r["w"] for r in got} == {0: 1.0, 1: 0.3}
