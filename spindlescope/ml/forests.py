"""Forests whose trees are grown in tasks and stay in a stored table; the driver holds the few nodes of very many rows.

Nodes of more than MOST_ROWS rows are split by passes over all rows. Of a table of at most ROOM bytes every growing task then gets one
copy, as bytes, and grows everything below the other nodes of its trees; of a larger one, the rows of each node meet in one task. To
predict, stripes of rows meet groups of trees in tasks: rows travel once per group, trees once per stripe, each in few bytes, and there
are only as many of both as fit into a task's ROOM or as give all tasks work.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.ml.models import ArrayEstimator, ArrayModel, option
from spindlescope.ml.passes import blocks, keyed
from spindlescope.session import ensure_checkpoint_dir, written

#: Rows of a node that one task grows a subtree from.
MOST_ROWS = 1 << 16
#: Tasks that grow or predict at most, and those that there are at least unless the rows or trees are few.
TASKS, FEW_TASKS = 192, 48
#: Bytes of rows, and of trees, that one task holds; bytes of rows sent to all growing tasks together, if that leaves FEW_TASKS.
ROOM, SENT_ROOM = 1 << 26, 1 << 29
#: Trees whose rows are sent in one batch, nodes of a level that are split at once, and rows that walk through a tree at once.
SENT, TOGETHER, WALKED = 32, 512, 1 << 15
#: A node's split must be worth more than this share of its rows.
TINY = 1e-12
#: Poisson(1): chance of at most 0, 1, 2, ... copies of a row in a bootstrap sample.
COPIES = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per row hash and salt."""
    h = hashes.astype(np.int64).view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(float) / 2.0 ** 53


def copies_of(hashes: np.ndarray, seed: int, tree: int, resampled: bool) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    return np.searchsorted(COPIES, uniform(hashes, seed * 1_000_003 + tree)) if resampled else np.ones(len(hashes), np.int64)


class Walk:
    """Trees as flat arrays: ``feature`` is -1 where a row stops; the right child follows the left one."""

    def __init__(self, feature, cut, left):
        self.feature, self.cut, self.left = np.asarray(feature, int), np.asarray(cut, float), np.asarray(left, int)

    def __call__(self, x: np.ndarray, root: int, strict: bool) -> np.ndarray:
        """Where each row stops; it goes left if its value is below the cut (``strict``) or at most the cut."""
        out = np.full(len(x), root)
        rows = np.arange(len(x))
        while len(rows):
            at = out[rows]
            f = self.feature[at]
            inner = f >= 0
            rows, at, f = rows[inner], at[inner], f[inner]
            v = x[rows, f]
            out[rows] = self.left[at] + (v >= self.cut[at] if strict else v > self.cut[at])
        return out


def below(x, y, w, copies, tree: int, root: int, most: int, choose) -> dict:
    """Everything below heap number ``root`` of a tree as flat arrays, level by level.

    ``choose(x, w, w1, copies, tree, heap, depth)`` takes rows sorted by node with the first row of each node and gives the feature
    (-1: none) and cut per node; ``w1``: weights of the rows of class 1.
    """
    w = w * copies
    w1 = w * y
    rows, at, heap, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.array([root], np.int64), 0
    out: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "n0", "n1", "heap")}
    while m := len(heap):
        n, n1 = np.bincount(at, w[rows], m), np.bincount(at, w1[rows], m)
        feature, cut, left = np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
        able = (n1 > 0) & (n1 < n) & (int(root + 1).bit_length() - 1 + len(out["heap"]) < most)
        keep = able[at]
        rows, at = rows[keep], at[keep]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        spots = np.flatnonzero(able)
        first = np.searchsorted(at, spots)
        for a in range(0, len(spots), TOGETHER):
            b = min(a + TOGETHER, len(spots))
            part = rows[first[a]:first[b] if b < len(spots) else len(rows)]
            feature[spots[a:b]], cut[spots[a:b]] = choose(x[part], w[part], w1[part], copies[part], first[a:b] - first[a], tree, heap[spots[a:b]])
        split = np.flatnonzero(feature >= 0)
        left[split] = total + m + 2 * np.arange(len(split))
        for k, v in (("feature", feature), ("cut", cut), ("left", left), ("n0", n - n1), ("n1", n1), ("heap", heap)):
            out[k].append(v)
        keep = feature[at] >= 0
        rows, at = rows[keep], at[keep]
        at = left[at] - total - m + (x[rows, feature[at]] > cut[at])
        heap = (2 * heap[split][:, None] + [1, 2]).ravel()
        total += m
    return {k: np.concatenate(v) for k, v in out.items()}


_KINDS = {"feature": np.int32, "cut": np.float64, "left": np.int32, "n0": np.float64, "n1": np.float64, "heap": np.int64}
_TREES = "place int, tree int, " + ", ".join(f"{k} binary" for k in _KINDS)


def _subtree(place: int, tree: int, heap: int, x, y, w, c, most: int, choose) -> tuple:
    found = below(x, y, w, c, tree, heap, most, choose)
    return (place, tree, *[found[k].astype(t).tobytes() for k, t in _KINDS.items()])


def _as_trees(rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int32() if k in ("place", "tree") else pa.binary()) for k, v in zip(("place", "tree", *_KINDS), zip(*rows))})


def grown(rows: DataFrame, top: dict, trees: int, seed: int, resampled: bool, most: int, choose, kind, size: int) -> str:
    """Grow what is open below ``top`` and write it; returns the folder. ``kind``: type of the values of x; ``size``: bytes of all rows."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    make = _grown_from_all if size <= ROOM else _grown_from_nodes
    make(rows, top, trees, seed, resampled, most, choose, kind, size).write.parquet(path)
    return path


def row_bytes(width: int, kind) -> int:
    """Bytes of a row that is sent: its values, label, weight and hash."""
    return width * np.dtype(kind).itemsize + 17


def _grown_from_all(rows: DataFrame, top: dict, trees: int, seed: int, resampled: bool, most: int, choose, kind, size: int) -> DataFrame:
    """Every task gets all rows once and grows the trees of its chunk, one by one."""
    walk, is_open, tree_of, heap = Walk(top["feature"], top["cut"], top["left"]), np.array(top["open"]), np.array(top["tree"]), top["heap"]
    chunks = max(1, min(trees, TASKS, max(FEW_TASKS, SENT_ROOM // max(1, size))))

    def send(batches):
        for x, rest in blocks(batches):
            w = rest["w"].tobytes() if (rest["w"] != 1.0).any() else b""
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((len(x), pa.int32()), (x.astype(kind).tobytes(), pa.binary()), (rest["label"].astype(np.uint8).tobytes(), pa.binary()),
                                                                              (rest["h"].tobytes(), pa.binary()), (w, pa.binary()))], ["n", "x", "y", "h", "w"])

    def trees_of(chunk: int, parts: list[dict]):
        n = sum(p["n"] for p in parts)
        x = np.frombuffer(b"".join(p["x"] for p in parts), kind).reshape(n, -1)
        y, h = (np.frombuffer(b"".join(p[k] for p in parts), t) for k, t in (("y", np.uint8), ("h", np.int64)))
        w = np.concatenate([np.frombuffer(p["w"]) if p["w"] else np.ones(p["n"]) for p in parts])
        parts.clear()
        for t in range(chunk, trees, chunks):
            copies = copies_of(h, seed, t, resampled)
            at = walk(x, t, False)
            for place in np.flatnonzero(is_open & (tree_of == t)).tolist():
                use = np.flatnonzero((copies > 0) & (at == place))
                if len(use):
                    yield _as_trees([_subtree(place, t, heap[place], x[use], y[use].astype(float), w[use], copies[use].astype(float), most, choose)]).to_batches()[0]

    def grow(batches):
        chunk, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk and parts:
                    yield from trees_of(chunk, parts)
                chunk = r["chunk"]
                parts.append(r)
        if parts:
            yield from trees_of(chunk, parts)

    sent = rows.mapInArrow(send, "n int, x binary, y binary, h binary, w binary").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return sent.repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInArrow(grow, _TREES)


def _grown_from_nodes(rows: DataFrame, top: dict, trees: int, seed: int, resampled: bool, most: int, choose, kind, size: int) -> DataFrame:
    """The rows of a node, with their copies in its tree's sample, meet in one task."""
    walk, is_open, tree_of, heap = Walk(top["feature"], top["cut"], top["left"]), np.array(top["open"]), top["tree"], top["heap"]

    def deal(batches):
        for x, rest in blocks(batches):
            x, weighted = x.astype(kind), bool((rest["w"] != 1.0).any())
            for a in range(0, trees, SENT):
                out = []
                for t in range(a, min(a + SENT, trees)):
                    copies = copies_of(rest["h"], seed, t, resampled)
                    at = walk(x, t, False)
                    use = np.flatnonzero((copies > 0) & is_open[at])
                    use = use[np.argsort(at[use], kind="stable")]
                    for part in np.split(use, np.flatnonzero(np.diff(at[use])) + 1) if len(use) else ():
                        w = rest["w"][part].tobytes() if weighted else b""
                        out.append((int(at[part[0]]), len(part), x[part].tobytes(), rest["label"][part].astype(np.uint8).tobytes(), copies[part].astype(np.uint8).tobytes(), w))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["place", "n", "x", "y", "c", "w"])

    def finish(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        parts = table.to_pydict()
        n, tree = parts["n"], tree_of[place]
        x = np.frombuffer(b"".join(parts["x"]), kind).reshape(sum(n), -1)
        y, c = (np.frombuffer(b"".join(parts[k]), np.uint8).astype(float) for k in ("y", "c"))
        w = np.concatenate([np.frombuffer(v) if v else np.ones(k) for v, k in zip(parts["w"], n)])
        return _as_trees([_subtree(place, tree, heap[place], x, y, w, c, most, choose)])

    sent = rows.mapInArrow(deal, "place int, n int, x binary, y binary, c binary, w binary")
    return sent.repartition(max(1, min(TASKS, int(is_open.sum()))), "place").groupBy("place").applyInArrow(finish, _TREES)


def _slim(kind):
    """Subtrees as predicting needs them: a feature per node, a cut per inner node, a share per leaf.

    Nodes lie level by level and children in the order of their parents, so the left child of inner node k (from 0) is node 2 k + 1.
    """
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                feature, cut, n0, n1 = (np.frombuffer(r[k], _KINDS[k]) for k in ("feature", "cut", "n0", "n1"))
                leaf = feature < 0
                n = (n0 + n1)[leaf]
                share = np.divide(n1[leaf], n, out=np.zeros(len(n)), where=n > 0)
                small = feature.astype(np.int16) if feature.max() < 1 << 15 else feature
                arrays = [pa.array([v], k) for v, k in ((r["place"], pa.int32()), (r["tree"], pa.int32()), (len(feature), pa.int32()), (small.tobytes(), pa.binary()),
                                                         (cut[~leaf].astype(kind).tobytes(), pa.binary()), (share.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "tree", "n", "feature", "cut", "share"])
    return run


def _fat(r: dict, kind) -> tuple[Walk, np.ndarray]:
    feature = np.frombuffer(r["feature"], np.int16 if len(r["feature"]) == 2 * r["n"] else np.int32)
    inner = feature >= 0
    cut, left, share = np.zeros(r["n"]), np.zeros(r["n"], np.int64), np.zeros(r["n"])
    cut[inner], left[inner], share[~inner] = np.frombuffer(r["cut"], kind), 2 * np.arange(int(inner.sum())) + 1, np.frombuffer(r["share"])
    return Walk(feature, cut, left), share


def stripes_and_groups(rows: int, row: int, forest: int, trees: int) -> tuple[int, int]:
    """Stripes of rows and groups of trees. ``row``: bytes of a row; ``forest``: bytes of all trees."""
    stripes, groups = max(1, -(-rows * row // ROOM)), max(1, min(trees, -(-forest // ROOM)))
    most = max(1, rows // WALKED), trees
    while stripes * groups < FEW_TASKS and (stripes < most[0] or groups < most[1]):
        # a stripe more costs all trees once more, a group all rows and their sums; the product costs least where both cost the same
        if groups >= most[1] or (stripes < most[0] and stripes * forest <= groups * rows * (row + 16)):
            stripes += 1
        else:
            groups += 1
    return stripes, groups


def joined(top: dict, found: list[dict]) -> dict:
    """Flat arrays of ``top`` and of the subtrees below its open places."""
    n0, n1 = (np.array([c[i] for c in top["counts"]], float) for i in (0, 1))
    out = {"feature": np.array(top["feature"]), "cut": np.array(top["cut"], float), "left": np.array(top["left"]), "n0": n0, "n1": n1, "heap": np.array(top["heap"], np.int64)}
    parts, total = [out], len(out["feature"])
    for r in found:
        sub = {k: np.frombuffer(r[k], t).copy() for k, t in _KINDS.items()}
        sub["left"] = np.where(sub["feature"] >= 0, sub["left"] + total, 0)
        for k in out:
            out[k][r["place"]] = sub[k][0]
        total += len(sub["feature"])
        parts.append(sub)
    return {k: np.concatenate([p[k] for p in parts]) for k in out}


class ForestWriter(DefaultParamsWriter):
    """Saves the trees beside the settings."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        SparkSession.getActiveSession().read.schema(_TREES).parquet(self.instance.held["folder"]).write.parquet(f"{path}/trees")


class ForestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return type(model)({**model.held, "folder": f"{path}/trees"})


class ForestModel(ArrayModel):
    """Mean share of class 1 in the leaves a row reaches, less one half. The trees stay in their table."""

    @property
    def held(self) -> dict:
        return ArrayModel.facts.fget(self)

    @property
    def numFeatures(self) -> int:
        return self.held["width"]

    def _rows(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(_TREES).parquet(self.held["folder"])

    @property
    def facts(self) -> dict:
        """The whole forest as flat arrays on the driver; prediction does without."""
        whole = joined(self.held["top"], [r.asDict() for r in self._rows().orderBy("place").collect()])
        n = whole["n0"] + whole["n1"]
        return {**{k: whole[k].tolist() for k in ("feature", "cut", "left")}, "share": np.divide(whole["n1"], n, out=np.zeros(len(n)), where=n > 0).tolist(),
                "counts": list(zip(whole["n0"].tolist(), whole["n1"].tolist())), "roots": list(range(self.held["trees"])), "edges": self.held["edges"]}

    @staticmethod
    def prepared(facts):
        edges = facts["edges"] and [np.array(e, float) for e in facts["edges"]]
        return Walk(facts["feature"], facts["cut"], facts["left"]), np.array(facts["share"]), facts["roots"], edges

    @staticmethod
    def margins(ready, x):
        walk, share, roots, edges = ready
        x = values_of(x, edges)
        return sum(share[walk(x, r, False)] for r in roots) / len(roots) - 0.5

    def write(self):
        return ForestWriter(self)

    @classmethod
    def read(cls):
        return ForestReader(cls)

    def margin_rows(self, df: DataFrame) -> DataFrame:
        """(_rid, _margin) for stored rows ``df`` (_rid, vector)."""
        held = self.held
        top, trees = held["top"], held["trees"]
        edges = held["edges"] and [np.array(e, float) for e in held["edges"]]
        kind = code_kind(edges)
        nodes = (self._rows().agg(F.sum(F.octet_length("feature"))).first()[0] or 0) // 4
        count, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array("vector")))).first()
        stripes, groups = stripes_and_groups(count, (width or 0) * np.dtype(kind).itemsize + 8, nodes * (6 + np.dtype(kind).itemsize // 2), trees)

        def cut(batches):
            for x, rest in blocks(batches):
                x = values_of(x, edges).astype(kind)
                stripe = int(uniform(rest["_rid"][:1], 1)[0] * stripes)
                yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([rest["_rid"].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["stripe", "rid", "x"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"_rid": pa.array([], pa.int64()), "_sum": pa.array([], pa.float64())})
            group = left.column("part")[0].as_py()
            rid = np.frombuffer(b"".join(left.column("rid").to_pylist()), np.int64)
            x = np.frombuffer(b"".join(left.column("x").to_pylist()), kind).reshape(len(rid), -1)
            found: dict[int, list[int]] = {}
            for i, t in enumerate(right.column("tree").to_pylist()):
                found.setdefault(t, []).append(i)
            above, is_open = Walk(top["feature"], top["cut"], top["left"]), np.array(top["open"])
            n0, n1 = (np.array([c[i] for c in top["counts"]], float) for i in (0, 1))
            closed = np.where(is_open, 0.0, np.divide(n1, n0 + n1, out=np.zeros(len(n0)), where=n0 + n1 > 0))
            sums = np.zeros(len(rid))
            for t in range(group, trees, groups):
                below_it = {r["place"]: _fat(r, kind) for r in right.take(found[t]).to_pylist()} if t in found else {}
                for a in range(0, len(rid), WALKED):
                    part, out = x[a:a + WALKED], sums[a:a + WALKED]
                    at = above(part, t, False)
                    out += closed[at]
                    for place, (walk, share) in below_it.items():
                        use = np.flatnonzero(at == place)
                        out[use] += share[walk(part[use], 0, False)]
            return pa.table({"_rid": rid, "_sum": sums})

        every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        rows = df.select(vector_to_array("vector").alias("x"), "_rid").mapInArrow(cut, "stripe int, rid binary, x binary").withColumn("part", every)
        slim = self._rows().select("place", "tree", "feature", "cut", "n0", "n1").mapInArrow(_slim(kind), "place int, tree int, n int, feature binary, cut binary, share binary")
        parts = slim.withColumn("part", F.pmod("tree", F.lit(groups))).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        keys, tasks = ["part", "stripe"], min(TASKS, groups * stripes)
        met = rows.repartition(tasks, *keys).groupBy(*keys).cogroup(parts.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(meet, "_rid long, _sum double")
        return met.groupBy("_rid").agg((F.sum("_sum") / trees - 0.5).alias("_margin"))

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = written(df.withColumn("_rid", F.monotonically_increasing_id()))
        m = F.col("_margin")
        scored = rows.join(self.margin_rows(rows.select("_rid", "vector")), "_rid")
        return scored.withColumns({"rawPrediction": array_to_vector(F.array(-m, m)), "prediction": (m > 0).cast("double")}).drop("_margin", "_rid")


def code_kind(edges: list | None):
    """Type of the values that trees compare: codes of ranges, or numbers as they are."""
    return np.float64 if edges is None else np.uint8 if max(map(len, edges), default=0) < 256 else np.int16


def values_of(x: np.ndarray, edges: list | None) -> np.ndarray:
    return x if edges is None else np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]) if edges else x[:, :0]


def closed_top(trees: int) -> dict:
    """Nothing but open roots."""
    return {"feature": [-1] * trees, "cut": [0.0] * trees, "left": [0] * trees, "counts": [(0.0, 0.0)] * trees, "tree": list(range(trees)), "heap": [0] * trees, "open": [True] * trees}


# forests of bootstrap samples

def worth(n1: np.ndarray, n: np.ndarray, impurity: str) -> np.ndarray:
    """Rows times purity, up to a constant: higher is purer; 0 rows are worth 0."""
    n0 = n - n1
    safe = np.maximum(n, 1e-300)
    if impurity == "gini":
        return (n0 * n0 + n1 * n1) / safe
    return sum(p * np.log2(np.maximum(p, 1e-300) / safe) for p in (n0, n1))


def best_cuts(sums: np.ndarray, least: float, impurity: str) -> tuple[np.ndarray, np.ndarray]:
    """Per node which of the offered features to cut (-1: none) and the last code on the left. ``sums``: (3, nodes, features, codes) of weight, weight of class 1 and copies."""
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    left = left[..., :-1]
    right = whole - left
    gain = worth(left[1], left[0], impurity) + worth(right[1], right[0], impurity) - worth(whole[1], whole[0], impurity)
    gain = np.where((left[2] >= max(least, 1)) & (right[2] >= max(least, 1)), gain, -np.inf).reshape(len(gain), -1)
    if not gain.shape[1]:
        return np.full(len(gain), -1), np.zeros(len(gain))
    top = gain.argmax(axis=1)
    j, code = np.divmod(top, sums.shape[3] - 1)
    return np.where(gain[np.arange(len(gain)), top] > TINY * whole[0, :, 0, 0], j, -1), code.astype(float)


class RandomForest(ArrayEstimator):
    """A forest of bootstrap samples: at each node some features are tried at the borders of ``maxBins`` ranges of their values."""

    numTrees = option("numTrees", "trees")
    minInstancesPerNode = option("minInstancesPerNode", "rows of a sample on each side of a cut at least")
    featureSubsetStrategy = option("featureSubsetStrategy", "features tried per node: sqrt, auto (the same), log2, onethird, all, or a number")
    maxDepth = option("maxDepth", "levels below the root")
    impurity = option("impurity", "gini or entropy")
    bootstrap = option("bootstrap", "whether each tree sees a resampled table")
    maxBins = option("maxBins", "ranges of values per feature")
    DEFAULTS = {"numTrees": 1000, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt", "maxDepth": 30, "impurity": "gini", "bootstrap": True, "maxBins": 32}

    def _fit(self, df: DataFrame) -> ForestModel:
        from spindlescope.ml.trees import BoostedTrees, cut_places, stored

        rows = stored(df, self.value("weightCol"), *[c for c in ("row_id",) if c in df.columns])
        count, edges = rows.count(), cut_places(rows, self.value("maxBins"))
        ranged = BoostedTrees._ranged(rows, edges)
        trees, seed, d, width = self.value("numTrees"), self.value("seed"), len(edges), max(map(len, edges), default=0) + 1
        kind = self.value("featureSubsetStrategy")
        tried = {"sqrt": math.ceil(math.sqrt(d)), "auto": math.ceil(math.sqrt(d)) if trees > 1 else d, "log2": math.ceil(math.log2(max(d, 2))), "onethird": math.ceil(d / 3), "all": d}.get(kind, kind)
        tried, least, impurity = max(1, min(d, int(tried))), self.value("minInstancesPerNode"), self.value("impurity")

        def offered(tree: int, heap: np.ndarray) -> np.ndarray:
            """The features tried at nodes of a tree (nodes, tried)."""
            keys = uniform((np.asarray(heap, np.int64) + (tree << 40))[:, None] * np.int64(d) + np.arange(d), seed)
            return np.sort(np.argsort(keys, axis=1)[:, :tried], axis=1)

        def choose(x, w, w1, copies, first, tree, heap):
            m, features = len(first), offered(tree, heap)
            node = np.repeat(np.arange(m), np.diff(np.r_[first, len(x)]))
            spot = ((node * tried)[:, None] + np.arange(tried)) * width + x[np.arange(len(x))[:, None], features[node]]
            sums = np.stack([np.bincount(spot.ravel(), np.repeat(v, tried), m * tried * width) for v in (w, w1, copies)]).reshape(3, m, tried, width)
            j, code = best_cuts(sums, least, impurity)
            return np.where(j >= 0, features[np.arange(m), j], -1), code

        resampled, most = bool(self.value("bootstrap")), self.value("maxDepth")
        top = self._top(ranged, count, trees, most, width, tried, offered, least, impurity)
        folder = grown(ranged.drop("margin"), top, trees, seed, resampled, most, choose, code_kind(edges), count * row_bytes(d, code_kind(edges)))
        return ForestModel({"folder": folder, "top": top, "trees": trees, "width": d, "edges": [e.tolist() for e in edges]})

    def _top(self, ranged: DataFrame, count: int, trees: int, most: int, width: int, tried: int, offered, least, impurity) -> dict:
        """Nodes of more than MOST_ROWS rows, split level by level by sums over all rows."""
        top = closed_top(trees)
        large = list(range(trees)) if count > MOST_ROWS else []
        seed, resampled = self.value("seed"), bool(self.value("bootstrap"))
        for depth in range(most):
            if not large:
                break
            walk, tree, heap = Walk(top["feature"], top["cut"], top["left"]), top["tree"], top["heap"]
            tries = {p: offered(tree[p], np.array([heap[p]]))[0] for p in large}

            def sums(x, rest):
                out, size = {}, tried * width
                for t in sorted({tree[p] for p in tries}):
                    copies, at = copies_of(rest["h"], seed, t, resampled), walk(x, t, False)
                    for p in np.unique(at[copies > 0]).tolist():
                        if p in tries:
                            use = np.flatnonzero((at == p) & (copies > 0))
                            w = rest["w"][use] * copies[use]
                            spot = (np.arange(tried) * width + x[use][:, tries[p]]).ravel()
                            out[p] = np.concatenate([np.bincount(spot, np.repeat(v, tried), size) for v in (w, w * rest["label"][use], copies[use])])
                return out

            def finish(p, v):
                v = v.reshape(3, 1, tried, width)
                j, code = best_cuts(v, least, impurity)
                left, whole = v[:, 0, max(int(j[0]), 0), :int(code[0]) + 1].sum(axis=1), v[:, 0, 0].sum(axis=1)
                return (p, int(tries[p][j[0]]) if j[0] >= 0 else -1, float(code[0]), *map(float, left), *map(float, whole))

            found = keyed(ranged.drop("margin"), sums, np.add, finish, "place int, feature int, cut double, lw double, l1 double, lc double, w double, w1 double, c double")
            large = []
            for r in sorted(found):
                p = r["place"]
                top["open"][p], top["counts"][p] = False, (r["w"] - r["w1"], r["w1"])
                if r["feature"] < 0 or r["w1"] <= 0 or r["w1"] >= r["w"]:
                    continue
                top["feature"][p], top["cut"][p], top["left"][p] = r["feature"], r["cut"], len(top["feature"])
                for side, (w, w1, c) in enumerate(((r["lw"], r["l1"], r["lc"]), (r["w"] - r["lw"], r["w1"] - r["l1"], r["c"] - r["lc"]))):
                    if c > MOST_ROWS and depth + 1 < most:
                        large.append(len(top["feature"]))
                    for k, v in (("feature", -1), ("cut", 0.0), ("left", 0), ("counts", (w - w1, w1)), ("tree", top["tree"][p]), ("heap", 2 * top["heap"][p] + 1 + side), ("open", True)):
                        top[k].append(v)
        return top
