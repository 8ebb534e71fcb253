"""Exact nearest neighbours and distance-threshold neighbourhoods.

Rows are blocked by their nearest pivot and compared cell by cell; the triangle inequality proves
which other cells a row has to visit, so nothing is approximated and nothing is capped. Equal
vectors are folded first: however many rows share a vector, it is compared once, and only its
smallest ids can ever appear among the k nearest. Cells are cut into chunks of about ``CHUNK``
rows on both sides; one task compares one chunk with another as a numpy block and returns only
its k best per row (or a count, or a spanning forest), never the pairs. Searches beyond a row's own cell bring tiles of
``TILE`` chunks together, so that a row that has to see most cells does not travel once per cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindlescope.session import cut_lineage, lookup_join, split_join

CHUNK = 1024
#: Chunks of rows that one side of a task holds at most, when far cells are searched.
TILE = 16
SLACK = 1e-9


def _keyed(df: DataFrame, vec: str, within: list[str]) -> DataFrame:
    """Add the block ``_w``, the vector ``_v`` and its identity ``_key``."""
    block = F.concat_ws("|", *[F.col(c).cast("string") for c in within]) if within else F.lit("")
    values = F.transform(F.col(vec).cast("array<double>"), lambda x: x + 0.0)
    return df.withColumns({"_w": block, "_v": values}).withColumn("_key", F.md5(F.col("_v").cast("string")))


def _distinct(df: DataFrame) -> DataFrame:
    return df.groupBy("_w", "_key").agg(F.first("_v").alias("_v"), F.count(F.lit(1)).alias("_copies"))


def _with_ids(df: DataFrame, id_col: str, m: int) -> DataFrame:
    """Distinct vectors with their ``m`` smallest ids.

    The rank filter is pushed below the shuffle, so a vector shared by a third of the rows sends at
    most ``m`` rows per map task.
    """
    by = Window.partitionBy("_w", "_key").orderBy("_id")
    few = df.select("_w", "_key", "_v", F.col(id_col).alias("_id")).withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= m)
    return few.groupBy("_w", "_key").agg(F.first("_v").alias("_v"), F.sort_array(F.collect_list("_id")).alias("_ids"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in column])


METRICS = {
    "euclidean": lambda gap: np.sqrt((gap * gap).sum(axis=2)),
    "manhattan": lambda gap: np.abs(gap).sum(axis=2),
    "chebyshev": lambda gap: np.abs(gap).max(axis=2),
}


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances, a few rows at a time to bound memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = METRICS[metric](a[i:i + step, None, :] - b[None, :, :])
    return out


def _rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared Euclidean distances by one matrix product, and a bound on their rounding error."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 1e-11 * (float(na.max(initial=0.0)) + float(nb.max(initial=0.0))) + 1e-300
    return na[:, None] + nb[None, :] - 2.0 * (a @ b.T), slack


def _pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of chosen pairs."""
    out = np.empty(len(i))
    step = max(1, 4_000_000 // a.shape[1])
    for k in range(0, len(i), step):
        gap = a[i[k:k + step]] - b[j[k:k + step]]
        out[k:k + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _closest(a: np.ndarray, b: np.ndarray, m: int, metric: str, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of every pair that can be among the ``m`` closest of its row, ties included.

    Pairs surely farther apart than the row's ``reach`` are left out.
    """
    if metric == "euclidean":
        value, slack = _rough_squares(a, b)
    else:
        value, slack = _distances(a, b, metric), 0.0
    limit = None if reach is None else (reach * reach if metric == "euclidean" else reach)[:, None] * (1 + SLACK)
    if m < value.shape[1] and (limit is None or not np.isfinite(limit).all()):
        best = np.partition(value, m - 1, axis=1)[:, m - 1:m]
        limit = best if limit is None else np.minimum(best, limit)
    if limit is not None:
        i, j = np.nonzero(value <= limit + 2 * slack)
    else:
        i, j = np.divmod(np.arange(value.size), value.shape[1])
    return i, j, _pair_distances(a, b, i, j) if metric == "euclidean" else value[i, j]


def _within(a: np.ndarray, b: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """Which pairs are at most ``eps`` apart; pairs too near the limit for rough numbers are redone exactly."""
    if metric != "euclidean":
        return _distances(a, b, metric) <= eps
    value, slack = _rough_squares(a, b)
    close = value <= eps * eps
    i, j = np.nonzero(np.abs(value - eps * eps) <= 2 * slack)
    close[i, j] = _pair_distances(a, b, i, j) <= eps
    return close


def choose_pivots(distinct: DataFrame, rows: int) -> np.ndarray:
    """Distinct vectors in hash order: one per ``CHUNK`` rows, but the square root of the rows at most.

    So cells keep shrinking against the table, and the driver holds 100,000 vectors for ten billion rows.
    """
    count = max(1, min(math.isqrt(rows), -(-rows // CHUNK)))
    picked = distinct.select("_key", "_v").orderBy("_key").limit(count).collect()
    return np.array([r["_v"] for r in picked], dtype=float)


def _assign(df: DataFrame, pivots: np.ndarray, metric: str, bands: np.ndarray | None = None) -> DataFrame:
    """Add the nearest pivot ``_cell`` and the distance ``_d`` to it, and with ``bands`` the band of the cell."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_d", T.DoubleType()),
                           *([T.StructField("_band", T.IntegerType())] if bands is not None else [])])

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i:i + CHUNK]
                gaps = _distances(_matrix(part["_v"]), pivots, metric)
                cell = gaps.argmin(axis=1)
                part = part.assign(_cell=cell.astype("int32"), _d=gaps[np.arange(len(part)), cell])
                yield part if bands is None else part.assign(_band=bands[cell].astype("int32"))

    return df.mapInPandas(run, schema)


def _rings(points: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance to the pivot in every cell, over all blocks; no distance reaches an empty cell."""
    lo, hi = np.full(cells, np.inf), np.full(cells, -np.inf)
    for r in points.groupBy("_cell").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).collect():
        lo[r["_cell"]], hi[r["_cell"]] = r["_lo"], r["_hi"]
    return lo, hi


def _bounds(gaps: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What the distance from a row to any vector of a cell is at least.

    ``gaps``: distances from the rows to the cells' pivots, ``own``: to the rows' own pivots. The hyperplane bound and the ring
    bound hold in every metric.
    """
    return np.maximum(np.maximum((gaps - own[:, None]) / 2.0, gaps - hi), lo - gaps)


def _reachable(pdf: pd.DataFrame, pivots: np.ndarray, rings: tuple[np.ndarray, np.ndarray], reach: str, metric: str) -> np.ndarray:
    """Rows x cells: which cells may hold a vector within ``reach`` of a row."""
    gaps = _distances(_matrix(pdf["_v"]), pivots, metric)
    bound = _bounds(gaps, gaps[np.arange(len(pdf)), pdf["_cell"].to_numpy()], *rings)
    return bound <= pdf[reach].to_numpy()[:, None] * (1 + SLACK) + SLACK


def _visit(rows: DataFrame, rings: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, reach: str, metric: str) -> DataFrame:
    """One row per cell that may hold a vector within ``reach`` of the row."""
    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i:i + CHUNK]
                home, target = np.nonzero(_reachable(part, pivots, rings, reach, metric))
                for k in range(0, len(home), 8 * CHUNK):
                    yield part.iloc[home[k:k + 8 * CHUNK]].assign(_cell=target[k:k + 8 * CHUNK].astype("int32"))

    return rows.mapInPandas(run, rows.schema)


def _bands(pivots: np.ndarray, rows: int, metric: str) -> np.ndarray:
    """The band of every cell: neighbouring cells of about ``TILE`` chunks of rows together."""
    return _distances(pivots, pivots[:max(1, -(-rows // (TILE * CHUNK)))], metric).argmin(axis=1)


def _tiled(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Deal the rows of a band to tiles of about ``TILE`` chunks; also (block, band, number of tiles)."""
    tiles = df.groupBy("_w", "_band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE * CHUNK)).cast("int").alias("_n"))
    dealt = lookup_join(df, tiles, ["_w", "_band"]).withColumn(f"_{side}tile", F.pmod(F.xxhash64("_key"), F.col("_n")).cast("int")).drop("_n")
    return dealt.withColumnRenamed("_band", f"_{side}band"), tiles.withColumnRenamed("_band", f"_{side}band")


def _meet_far(probes: DataFrame, targets: DataFrame, pivots: np.ndarray, bands: np.ndarray, m: int, schema: T.StructType, metric: str) -> DataFrame:
    """The ``m`` best within ``_reach`` of every probe, of the cells other than its own, per pair of tiles.

    A row travels once per tile on the other side that any row of its own tile may need, not once per cell; which cells a
    row has to be compared with is decided by the bounds inside the task.
    """
    rings = _rings(targets, len(pivots))
    left, _ = _tiled(probes, "l")
    right, shape = _tiled(targets, "r")
    kind = T.StructType([*[f for f in left.schema.fields if f.name in ("_w", "_lband", "_ltile")], T.StructField("_rband", T.IntegerType())])
    names = ["_w", "_lband", "_ltile"]

    def needed(batches):
        for pdf in batches:
            found = []
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i:i + CHUNK]
                go = _reachable(part, pivots, rings, "_reach", metric)
                go[np.arange(len(part)), part["_cell"].to_numpy()] = False
                for key, rows in part.reset_index(drop=True).groupby(names).indices.items():
                    found += [(*key, int(band)) for band in np.unique(bands[go[rows].any(axis=0)])]
            out = pd.DataFrame(found, columns=kind.names).drop_duplicates()
            yield out.astype({"_w": object, "_lband": "int32", "_ltile": "int32", "_rband": "int32"})

    pairs = cut_lineage(left.mapInPandas(needed, kind).distinct().join(shape, ["_w", "_rband"]).withColumn(
        "_rtile", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n"))
    keys = [*names, "_rband", "_rtile"]
    a = lookup_join(left, pairs, names)
    b = lookup_join(right, pairs, ["_w", "_rband", "_rtile"])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_nearest_far(m, schema.names, metric, pivots), schema)


def _meet(left: DataFrame, right: DataFrame, compare: Callable, schema: T.StructType) -> DataFrame:
    """Bring both sides of every cell together, chunk against chunk, and apply ``compare``."""
    def parts(df, name):
        return df.groupBy("_w", "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias(name))

    shape = parts(left, "_ln").join(parts(right, "_rn"), ["_w", "_cell"])
    chunk = lambda n: F.pmod(F.xxhash64("_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = lookup_join(left, shape, ["_w", "_cell"]).withColumn("_lc", chunk("_ln")).withColumn("_rc", every("_rn"))
    b = lookup_join(right, shape, ["_w", "_cell"]).withColumn("_rc", chunk("_rn")).withColumn("_lc", every("_ln"))
    keys = ["_w", "_cell", "_lc", "_rc"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compare, schema)


def _nearest(m: int, columns: list[str], metric: str) -> Callable:
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        i, j, far = _closest(_matrix(left["_v"]), _matrix(right["_v"]), m, metric)
        copies = right["_ids"].map(len).to_numpy()
        ids = np.concatenate([np.asarray(x) for x in right["_ids"]])
        start = np.concatenate([[0], np.cumsum(copies)[:-1]])
        pair = np.repeat(np.arange(len(i)), copies[j])
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(copies[j]) - copies[j], copies[j])
        who, rows, far = ids[start[j[pair]] + inner], i[pair], far[pair]
        order = np.lexsort((who, far, rows))
        who, rows, far = who[order], rows[order], far[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < m
        return pd.DataFrame({"_w": left["_w"].to_numpy()[rows[keep]], "_key": left["_key"].to_numpy()[rows[keep]],
                             "_dist": far[keep], "_nid": who[keep]})

    return compare


def _nearest_far(m: int, columns: list[str], metric: str, pivots: np.ndarray) -> Callable:
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        right = right.sort_values("_cell", kind="stable")
        others, cell = _matrix(right["_v"]), right["_cell"].to_numpy()
        copies = right["_ids"].map(len).to_numpy()
        ids = np.concatenate([np.asarray(x) for x in right["_ids"]])
        start = np.cumsum(copies) - copies
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        last, cells, ring = np.r_[first[1:], len(cell)], cell[first], right["_d"].to_numpy()
        lo, hi = np.minimum.reduceat(ring, first), np.maximum.reduceat(ring, first)
        out = []
        for begin in range(0, len(left), CHUNK):
            part = left.iloc[begin:begin + CHUNK]
            x, reach = _matrix(part["_v"]), part["_reach"].to_numpy(dtype=float, copy=True)
            bound = _bounds(_distances(x, pivots[cells], metric), part["_d"].to_numpy(), lo, hi)
            bound[part["_cell"].to_numpy()[:, None] == cells] = np.inf
            rows, far, who = np.empty(0, int), np.empty(0), ids[:0]
            for c in np.argsort(bound.min(axis=0), kind="stable"):
                for s in range(first[c], last[c], CHUNK):
                    go = np.flatnonzero(np.isfinite(bound[:, c]) & (bound[:, c] <= reach * (1 + SLACK) + SLACK))
                    if not len(go):
                        break
                    e = min(s + CHUNK, last[c])
                    i, j, d = _closest(x[go], others[s:e], m, metric, reach[go])
                    i = go[i]
                    near = d <= reach[i]
                    i, j, d = i[near], j[near] + s, d[near]
                    if not len(i):
                        continue
                    pair = np.repeat(np.arange(len(i)), copies[j])
                    inner = np.arange(len(pair)) - np.repeat(np.cumsum(copies[j]) - copies[j], copies[j])
                    rows, far, who = np.r_[rows, i[pair]], np.r_[far, d[pair]], np.r_[who, ids[start[j[pair]] + inner]]
                    order = np.lexsort((who, far, rows))
                    rows, far, who = rows[order], far[order], who[order]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    keep = place < m
                    full = place == m - 1
                    reach[rows[full]] = np.minimum(reach[rows[full]], far[full])
                    rows, far, who = rows[keep], far[keep], who[keep]
            out.append(pd.DataFrame({"_w": part["_w"].to_numpy()[rows], "_key": part["_key"].to_numpy()[rows], "_dist": far, "_nid": who}))
        return pd.concat(out, ignore_index=True)

    return compare


def _keep_best(found: DataFrame, m: int) -> DataFrame:
    by = Window.partitionBy("_w", "_key").orderBy("_dist", "_nid")
    return found.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= m).drop("_rn")


def knn_join(a: DataFrame, b: DataFrame, k: int, within: list[str] | str | None = None, id_col: str = "vec_id",
             vec: str = "vec", exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """The ``k`` nearest rows of ``b`` for every row of ``a``, ties by id.

    Result: (``within``…, ``id_col``, neighbour, rank, distance), rank from 1. ``within`` restricts
    neighbours to the same block; ``exclude_self`` leaves out the row with the same id.
    """
    within = [within] if isinstance(within, str) else list(within or [])
    m = k + 1 if exclude_self else k
    left, right = _keyed(a, vec, within), _keyed(b, vec, within)
    targets = cut_lineage(_with_ids(right, id_col, m))
    rows = targets.count()
    pivots = choose_pivots(targets, rows)
    if not len(pivots):
        return a.select(*within, id_col).withColumns({"neighbour": F.col(id_col), "rank": F.lit(0), "distance": F.lit(0.0)}).limit(0)
    bands = _bands(pivots, rows, metric)
    targets = _assign(targets, pivots, metric, bands)
    probes = _assign(_distinct(left).drop("_copies"), pivots, metric, bands)
    if len(pivots) > 1:
        targets, probes = cut_lineage(targets), cut_lineage(probes)
    nid = T.StructField("_nid", a.schema[id_col].dataType)
    schema = T.StructType([T.StructField("_w", T.StringType()), T.StructField("_key", T.StringType()),
                           T.StructField("_dist", T.DoubleType()), nid])
    compare = _nearest(m, schema.names, metric)
    found = _keep_best(_meet(probes, targets, compare, schema), m)
    if len(pivots) > 1:
        found = cut_lineage(found)
        known = found.groupBy("_w", "_key").agg(
            F.when(F.count(F.lit(1)) >= m, F.max("_dist")).otherwise(F.lit(float("inf"))).alias("_reach"))
        eager = probes.join(known, ["_w", "_key"], "left").na.fill(float("inf"), subset=["_reach"])
        far = _meet_far(cut_lineage(eager), targets, pivots, bands, m, schema, metric)
        found = _keep_best(found.unionByName(far), m)
    lists = found.groupBy("_w", "_key").agg(F.sort_array(F.collect_list(F.struct("_dist", "_nid"))).alias("_near"))
    rows = split_join(left.select("_w", "_key", *within, id_col), lists, ["_w", "_key"])
    near = F.filter("_near", lambda x: x["_nid"] != F.col(id_col)) if exclude_self else F.col("_near")
    best = rows.select(*within, id_col, F.posexplode(F.slice(near, 1, k)).alias("_pos", "_n"))
    return best.select(*within, id_col, F.col("_n._nid").alias("neighbour"), (F.col("_pos") + 1).alias("rank"),
                       F.col("_n._dist").alias("distance"))


class Neighbourhood:
    """Distinct vectors of a frame, blocked so that all pairs within ``eps`` meet in some cell."""

    def __init__(self, df: DataFrame, eps: float, vec: str = "vec", metric: str = "euclidean"):
        self.eps, self.metric = eps, metric
        self.rows = _keyed(df, vec, [])
        points = cut_lineage(_distinct(self.rows))
        self.pivots = choose_pivots(points, points.count())
        self.points = cut_lineage(_assign(points, self.pivots, metric))
        rings = _rings(self.points, len(self.pivots))
        probes = self.points.withColumn("_reach", F.lit(float(eps)))
        self.visits = cut_lineage(_visit(probes, rings, self.pivots, "_reach", metric))

    def _meet_within(self, left: DataFrame, right: DataFrame, compare: Callable, schema: T.StructType) -> DataFrame:
        """Chunks of the cells that ``left`` vectors visit against the ``right`` vectors living there."""
        return _meet(self.visits.join(left.select("_key"), "_key", "left_semi"), right, compare, schema)

    def weights(self) -> DataFrame:
        """Rows within ``eps`` of each distinct vector, itself included: (_key, _weight)."""
        eps, metric = self.eps, self.metric
        schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_weight", T.LongType())])

        def compare(left, right):
            if left.empty or right.empty:
                return pd.DataFrame(columns=["_key", "_weight"])
            close = _within(_matrix(left["_v"]), _matrix(right["_v"]), eps, metric)
            return pd.DataFrame({"_key": left["_key"].to_numpy(), "_weight": close @ right["_copies"].to_numpy()})

        counted = self._meet_within(self.points, self.points, compare, schema)
        return counted.groupBy("_key").agg(F.sum("_weight").alias("_weight"))

    def forest(self, members: DataFrame) -> DataFrame:
        """Edges that connect ``members`` exactly as all their pairs within ``eps`` would.

        Each chunk pair returns a spanning forest of its own pairs: fewer edges than rows.
        """
        eps, metric = self.eps, self.metric
        schema = T.StructType([T.StructField("_a", T.StringType()), T.StructField("_b", T.StringType())])

        def compare(left, right):
            if left.empty or right.empty:
                return pd.DataFrame(columns=["_a", "_b"])
            close = _within(_matrix(left["_v"]), _matrix(right["_v"]), eps, metric)
            lk, rk = left["_key"].to_numpy(), right["_key"].to_numpy()
            edges, seen_l, seen_r = [], np.zeros(len(lk), bool), np.zeros(len(rk), bool)
            for start in range(len(lk)):
                if seen_l[start]:
                    continue
                seen_l[start] = True
                front = [(0, start)]
                while front:
                    side, i = front.pop()
                    fresh = np.flatnonzero(close[i] & ~seen_r) if side == 0 else np.flatnonzero(close[:, i] & ~seen_l)
                    (seen_r if side == 0 else seen_l)[fresh] = True
                    for j in fresh:
                        edges.append((lk[i], rk[j]) if side == 0 else (rk[i], lk[j]))
                        front.append((1 - side, j))
            return pd.DataFrame([e for e in edges if e[0] != e[1]], columns=["_a", "_b"])

        return self._meet_within(members, members, compare, schema)

    def touching(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs (_key, _near) with a ``right`` vector within ``eps`` of a ``left`` one.

        For left sides whose neighbourhoods are known to be small.
        """
        eps, metric = self.eps, self.metric
        schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_near", T.StringType())])

        def compare(left, right):
            if left.empty or right.empty:
                return pd.DataFrame(columns=["_key", "_near"])
            i, j = np.nonzero(_within(_matrix(left["_v"]), _matrix(right["_v"]), eps, metric))
            return pd.DataFrame({"_key": left["_key"].to_numpy()[i], "_near": right["_key"].to_numpy()[j]})

        return self._meet_within(left, right, compare, schema)
