import numpy as np
import pytest

from spindlescope.ml.neighbour_models import components, dbscan, isolation_forest, knn_classify
from spindlescope.operators import neighbours as nb


def frame(spark, points, groups=None):
    rows = [(i, [float(v) for v in p], int(groups[i]) if groups is not None else 0) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id long, vec array<double>, label int")


def distance(a, b, metric):
    gap = np.abs(a - b)
    return {"euclidean": np.sqrt((gap * gap).sum()), "manhattan": gap.sum(), "chebyshev": gap.max()}[metric]


def brute(points, others, k, metric="euclidean", allowed=lambda i, j: True):
    out = {}
    for i, p in enumerate(points):
        best = sorted((round(distance(p, q, metric), 9), j) for j, q in enumerate(others) if allowed(i, j))[:k]
        for rank, (d, j) in enumerate(best, start=1):
            out[(i, rank)] = (j, d)
    return out


def found(df):
    return {(r["vec_id"], r["rank"]): (r["neighbour"], round(r["distance"], 9)) for r in df.collect()}


@pytest.fixture
def points():
    """Clusters, a third of all points identical, and exact ties on a grid."""
    rng = np.random.default_rng(7)
    blobs = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in (0, 3, 9)])
    same = np.tile([1.0, 1.0, 1.0], (80, 1))
    grid = np.array([[x, y, 0.0] for x in range(6) for y in range(6)], dtype=float)
    return np.vstack([blobs, same, grid])


@pytest.mark.parametrize("chunk,metric", [(1024, "euclidean"), (16, "euclidean"), (16, "manhattan"), (16, "chebyshev")])
def test_self_join_is_exact_with_ties_and_copies(spark, points, monkeypatch, chunk, metric):
    monkeypatch.setattr(nb, "CHUNK", chunk)
    df = frame(spark, points)
    got = found(nb.knn_join(df, df, 4, exclude_self=True, metric=metric))
    assert got == brute(points, points, 4, metric, lambda i, j: i != j)


@pytest.mark.parametrize("chunk", [16])
def test_join_within_blocks_and_against_another_frame(spark, points, monkeypatch, chunk):
    monkeypatch.setattr(nb, "CHUNK", chunk)
    groups = np.arange(len(points)) % 3
    a, b = frame(spark, points, groups), frame(spark, points[::-1], groups[::-1])
    got = found(nb.knn_join(a, b, 3, within="label"))
    assert got == brute(points, points[::-1], 3, allowed=lambda i, j: groups[i] == groups[::-1][j])


def test_fewer_rows_than_k(spark):
    df = frame(spark, np.array([[0.0], [1.0], [5.0]]))
    assert found(nb.knn_join(df, df, 5, exclude_self=True)) == brute(np.array([[0.0], [1.0], [5.0]]), np.array([[0.0], [1.0], [5.0]]), 5, allowed=lambda i, j: i != j)


def plain_dbscan(points, eps, m):
    near = [[j for j in range(len(points)) if distance(points[i], points[j], "euclidean") <= eps] for i in range(len(points))]
    core = [len(n) >= m for n in near]
    root = {i: i for i in range(len(points)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in root:
            low = min(root[j] for j in near[i] if core[j])
            if low < root[i]:
                root[i], changed = low, True
    return core, root, near


@pytest.mark.parametrize("chunk", [1024, 16])
def test_dbscan_against_a_plain_model(spark, points, monkeypatch, chunk):
    monkeypatch.setattr(nb, "CHUNK", chunk)
    core, root, near = plain_dbscan(points, 0.5, 5)
    got = {r["vec_id"]: r for r in dbscan(frame(spark, points), 0.5, 5).collect()}
    assert len(got) == len(points)
    clusters = {}
    for i in range(len(points)):
        assert got[i]["core"] == core[i]
        if core[i]:
            clusters.setdefault(got[i]["cluster"], set()).add(root[i])
        elif any(core[j] for j in near[i]):
            assert got[i]["cluster"] in {got[j]["cluster"] for j in near[i] if core[j]}
        else:
            assert got[i]["cluster"] == -1
    assert all(len(r) == 1 for r in clusters.values()) and len(clusters) == len(set(root.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40) if i != 20], "_a string, _b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(41)], "_key string")
    got = {r["_key"]: r["_root"] for r in components(edges, nodes).collect()}
    assert {got[f"{i:03d}"] for i in range(21)} == {"000"} and {got[f"{i:03d}"] for i in range(21, 41)} == {"021"}


def test_vote_prefers_exact_matches_by_distance(spark):
    train = frame(spark, np.array([[0.0], [0.1], [0.1], [5.0]]), [1, 0, 0, 1])
    test = frame(spark, np.array([[0.0]]))
    assert knn_classify(train, test, 3).first()["prediction"] == 0
    assert knn_classify(train, test, 3, "distance").first()["prediction"] == 1


def test_isolation_forest_ranks_outliers_first_and_repeats(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(300, 2)), [[9.0, 9.0], [-9.0, 8.0]]])
    df = frame(spark, points)
    model = isolation_forest(df, trees=40, sample=64, contamination=0.01)
    scored = model.predict(df).orderBy("anomaly", ascending=False).collect()
    assert {scored[0]["vec_id"], scored[1]["vec_id"]} == {300, 301}
    assert sum(r["prediction"] == -1 for r in scored) == 4
    again = isolation_forest(df.repartition(3), trees=40, sample=64).score(df).orderBy("anomaly", ascending=False).first()
    assert again["anomaly"] == scored[0]["anomaly"]


def test_component_rounds_keep_no_constraints(spark):
    """Constraints of one round would be multiplied by the next, until planning a round takes minutes."""
    n = 200
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)], "_a string, _b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)], "_key string")
    labels = components(edges, nodes)
    assert {r["_root"] for r in labels.collect()} == {"000"}
    assert labels._jdf.queryExecution().analyzed().constraints().size() <= 4


def test_far_search_moves_rows_per_tile_not_per_cell(spark, monkeypatch):
    """In high dimension every row has to see most cells; a row goes once to a tile of them."""
    monkeypatch.setattr(nb, "CHUNK", 8)
    points = np.random.default_rng(1).normal(size=(120, 24))
    shapes = []
    real = nb._meet_far

    def spied(probes, targets, pivots, *rest):
        shapes.append((probes.count(), len(pivots)))
        far = real(probes, targets, pivots, *rest)
        shapes.append(far.count())
        return far

    monkeypatch.setattr(nb, "_meet_far", spied)
    df = frame(spark, points)
    got = found(nb.knn_join(df, df, 3, exclude_self=True))
    assert got == brute(points, points, 3, allowed=lambda i, j: i != j)
    (rows, cells), sent = shapes
    assert cells > 4 and sent <= 4 * rows
