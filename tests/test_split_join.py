import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlescope.ml.neighbour_models import components, dbscan, knn_classify
from spindlescope.session import split_join


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_split_join_equals_the_plain_join(spark, how):
    """A key with a third of the rows, keys without a partner, null keys, repeated rows and an empty side."""
    big = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
                                  (F.col("id") % 450).alias("a.b"))
    small = spark.createDataFrame([(i, f"v{i}") for i in (*range(30), 99)], "k long, v string")
    assert rows_of(split_join(big, small, ["k"], how)) == rows_of(big.join(small, "k", how))
    assert rows_of(split_join(big, small.limit(0), ["k"], how)) == rows_of(big.join(small.limit(0), "k", how))
    assert rows_of(split_join(big.limit(0), small, ["k"], how)) == []


def test_a_hot_key_is_dealt_to_parts(spark):
    big = spark.range(6000).select(F.lit(1).alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    dealt = big.withColumn("p", F.pmod(F.xxhash64("k", "id"), F.lit(32))).groupBy("p").count()
    assert dealt.count() == 32 and dealt.agg(F.max("count")).first()[0] < 2 * 6000 / 32
    assert split_join(big, small, ["k"]).where("v = 'x'").count() == 6000


def test_hubs_and_chains_are_whole_components(spark):
    """A hub with half of all edges, a long chain and lone nodes."""
    edges = [("h", f"s{i:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    got = {r["_key"]: r["_root"] for r in components(spark.createDataFrame(edges, "_a string, _b string"), spark.createDataFrame([(n,) for n in nodes], "_key string")).collect()}
    assert got == {n: "lone" if n == "lone" else "c000" if n[0] == "c" else "h" for n in nodes}


def test_one_training_row_is_everybodys_neighbour(spark):
    """All test rows vote through the same hub, a third of them with one vector."""
    train = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [100.0, 0.0], 0), (2, [0.0, 100.0], 0)], "vec_id long, vec array<double>, label int")
    spots = [(0.1, 0.1) if i % 3 == 0 else (float(i % 7) / 10, float(i % 11) / 10) for i in range(300)]
    test = spark.createDataFrame([(i, list(p)) for i, p in enumerate(spots)], "vec_id long, vec array<double>")
    got = knn_classify(train, test, k=1).collect()
    assert len(got) == 300 and all(r["prediction"] == 1 and r["p1"] == 1.0 for r in got)


def test_border_rows_around_one_dense_vector(spark):
    """A vector with a third of the rows is the only core; rows on a circle about it are its border, the rest is noise."""
    angle = np.linspace(0, 2 * np.pi, 41)[:-1]
    spots = [(0.0, 0.0)] * 60 + [(np.cos(a), np.sin(a)) for a in angle] + [(50.0 + 10 * i, 0.0) for i in range(20)]
    df = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(spots)], "vec_id long, vec array<double>")
    got = {r["vec_id"]: (r["cluster"], r["core"]) for r in dbscan(df, eps=1.0000001, min_samples=80).collect()}
    assert got == {i: (0, True) if i < 60 else (0, False) if i < 100 else (-1, False) for i in range(120)}
