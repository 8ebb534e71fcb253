"""Trees grown level by level over stored rows: extremely randomised forests and second-order boosting."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.ml.forests import MOST_ROWS, ForestModel, Walk, closed_top, copies_of, grown, row_bytes, uniform
from spindlescope.ml.models import ArrayEstimator, ArrayModel, option
from spindlescope.ml.passes import BLOCK, block_sums, blocks, keyed
from spindlescope.session import cut_lineage

#: A node's key is its tree times NODES plus its heap number (children of i: 2 i + 1 and 2 i + 2).
NODES = 1 << 40
#: Sums of a boosting pass at most; a level with more nodes takes several passes.
MOST_NUMBERS = 1 << 23
#: Trees after which the margins are stored anew, so that a pass walks through this many trees at most.
REFRESH = 20
TINY_GAIN = 1e-6
#: Worths that differ by less than this share are equal; the first column and cut win.
SAME = 1e-9


def drawn(seed: int, tree: int, node: int, feature: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a feature at a node, the same in any engine with md5: the order it is tried in, and its cut."""
    digits = hashlib.md5(f"{seed}|{tree}|{node}|{feature}".encode()).hexdigest()
    return int(digits[:8], 16) / 2 ** 32, int(digits[8:16], 16) / 2 ** 32


def drawn_cuts(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, tried: int) -> list[tuple[int, float]]:
    """(feature, cut) of the features tried at a node, of those that vary in it."""
    found = []
    for (_, u), f in sorted((drawn(seed, tree, node, f), f) for f in np.flatnonzero(high > low).tolist())[:tried]:
        at = low[f] + (high[f] - low[f]) * u
        found.append((f, float(at if at < high[f] else low[f])))
    return found


def side_counts(x, w, w1, fs, cs) -> np.ndarray:
    """Weights of class 0 and 1 on the left, then on the right, of every offered cut."""
    right = x[:, fs] > cs
    return np.r_[w @ ~right - w1 @ ~right, w1 @ ~right, w @ right - w1 @ right, w1 @ right]


def purest(sides: np.ndarray) -> int:
    """The offered cut with the least Gini impurity."""
    l0, l1, r0, r1 = sides.reshape(4, -1)
    return int(np.argmax((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)))


def stored(df: DataFrame, weight: str | None, *names: str) -> DataFrame:
    """Stored rows x, label, w and a hash of them (``h``) and of the columns ``names``; rows with equal hashes share their draws."""
    x = vector_to_array("vector")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return cut_lineage(df.select(x.alias("x"), F.col("label").cast("double").alias("label"), w.alias("w"), F.xxhash64(x, F.col("label"), w, *names).alias("h")))


# extremely randomised trees

class ExtraTreesModel(ForestModel):
    """Mean share of class 1 in the leaves a row reaches, less one half."""


class ExtraTrees(ArrayEstimator):
    """A forest whose cuts are drawn: at each node, ``maxFeatures`` varying features are tried, each at one random place of its range.

    Nodes of more than MOST_ROWS rows are split for all trees together. A level takes two passes: ranges and class counts per node,
    from which the tasks draw features and cuts; then class counts on both sides of every drawn cut, from which they pick the one with
    the least Gini impurity. What is below the other nodes is grown in one task per node, by the same draws.
    """

    numTrees = option("numTrees", "trees")
    maxFeatures = option("maxFeatures", "features tried per node: sqrt, auto (the same), log2, all, or a number")
    bootstrap = option("bootstrap", "whether each tree sees a resampled table")
    maxDepth = option("maxDepth", "levels below the root at most, up to 38")
    DEFAULTS = {"numTrees": 100, "maxFeatures": "sqrt", "bootstrap": False, "maxDepth": 38}

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        rows = stored(df, self.value("weightCol"))
        shape = rows.agg(F.count(F.lit(1)), F.sum("w"), F.max(F.size("x"))).first()
        count, d, trees = shape[0], shape[2] or 0, self.value("numTrees")
        top = closed_top(trees)
        if count > MOST_ROWS:
            top = self.grow(rows, d, MOST_ROWS * shape[1] / count)
        folder = grown(rows, top, trees, self.value("seed"), self.value("bootstrap"), self.value("maxDepth"), self._chooser(d), np.float64, count * row_bytes(d, np.float64))
        kept = {k: top[k] for k in closed_top(0)}
        return ExtraTreesModel({"folder": folder, "top": kept, "trees": trees, "width": d, "edges": None})

    def _tried(self, d: int) -> int:
        kind = self.value("maxFeatures")
        return max(1, int({"sqrt": int(math.sqrt(d)), "auto": int(math.sqrt(d)), "log2": int(math.log2(max(d, 1))), "all": d}.get(kind, kind)))

    def _chooser(self, d: int):
        """What one task does at the nodes of a level (see ``forests.below``)."""
        seed, tried = self.value("seed"), self._tried(d)

        def choose(x, w, w1, copies, first, tree, heap):
            feature, cut = np.full(len(first), -1), np.zeros(len(first))
            if not d:
                return feature, cut
            low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            for i, (a, b) in enumerate(zip(first, np.r_[first[1:], len(x)])):
                offer = drawn_cuts(seed, tree, int(heap[i]), low[i], high[i], tried)
                if offer:
                    fs, cs = (np.array(v) for v in zip(*offer))
                    j = purest(side_counts(x[a:b], w[a:b], w1[a:b], fs, cs))
                    feature[i], cut[i] = fs[j], cs[j]
            return feature, cut
        return choose

    def grow(self, rows: DataFrame, d: int, above: float = 0.0) -> dict:
        """Flat arrays of all nodes; nodes that weigh ``above`` or less stay open."""
        trees, seed, resampled = self.value("numTrees"), self.value("seed"), self.value("bootstrap")
        tried = self._tried(d)
        tree_of, heap, is_open = list(range(trees)), [0] * trees, [False] * trees
        feature, cut, left, counts = [-1] * trees, [0.0] * trees, [0] * trees, [(0.0, 0.0)] * trees
        open_nodes = {t: (t, 0) for t in range(trees)}  # place -> tree, heap number

        def spread(x, rest, walk, places, one):
            """Per open node the arrays that ``one`` makes of its rows (order of rows, first row of each node)."""
            out = {}
            for t in sorted({t for t, _ in places.values()}):
                w = rest["w"] * copies_of(rest["h"], seed, t, resampled)
                at = walk(x, t, False)
                use = np.flatnonzero((w > 0) & np.isin(at, [p for p, (u, _) in places.items() if u == t]))
                if not len(use):
                    continue
                order = use[np.argsort(at[use], kind="stable")]
                nodes = at[order]
                first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
                for p, v in zip(nodes[first], one(x, rest["label"], w, order, first, nodes)):
                    out[t * NODES + places[int(p)][1]] = v
            return out

        most = self.value("maxDepth")
        for depth in range(most + 1):
            if not open_nodes:
                break
            walk, places = Walk(feature, cut, left), dict(open_nodes)

            def ranges(x, y, w, order, first, nodes):
                part = x[order]
                n1, n = np.add.reduceat(w[order] * y[order], first), np.add.reduceat(w[order], first)
                return np.hstack([(n - n1)[:, None], n1[:, None], np.minimum.reduceat(part, first), np.minimum.reduceat(-part, first)])

            def joined(a, b):
                return np.r_[a[:2] + b[:2], np.minimum(a[2:], b[2:])]

            def draw(key, v):
                tree, node = divmod(key, NODES)
                low, high = v[2:2 + d], -v[2 + d:]
                found = []
                if v[0] > 0 and v[1] > 0 and depth < most and v[0] + v[1] > above:
                    found = drawn_cuts(seed, tree, node, low, high, tried)
                return key, float(v[0]), float(v[1]), [f for f, _ in found], [c for _, c in found]

            drawn_nodes = keyed(rows, lambda x, rest: spread(x, rest, walk, places, ranges), joined, draw,
                                "key bigint, n0 double, n1 double, features array<int>, cuts array<double>")
            where = {t * NODES + node: p for p, (t, node) in places.items()}
            for r in drawn_nodes:
                counts[where[r["key"]]] = (r["n0"], r["n1"])
                is_open[where[r["key"]]] = r["n0"] > 0 and r["n1"] > 0 and depth < most and r["n0"] + r["n1"] <= above
            offers = {where[r["key"]]: (np.array(r["features"]), np.array(r["cuts"])) for r in drawn_nodes if r["features"]}
            places = {p: places[p] for p in offers}
            open_nodes = {}
            if not offers:
                break

            def sides(x, y, w, order, first, nodes):
                ends = np.r_[first[1:], len(order)]
                for a, b, p in zip(first, ends, nodes[first]):
                    part = order[a:b]
                    yield side_counts(x[part], w[part], w[part] * y[part], *offers[int(p)])

            offered = {t * NODES + node: offers[p] for p, (t, node) in places.items()}

            def pick(key, v):
                i = purest(v)
                fs, cs = offered[key]
                return key, int(fs[i]), float(cs[i])

            picked = keyed(rows, lambda x, rest: spread(x, rest, walk, places, sides), np.add, pick, "key bigint, feature int, cut double")
            for r in sorted(picked):
                p, (t, node) = where[r["key"]], divmod(r["key"], NODES)
                feature[p], cut[p], left[p] = r["feature"], r["cut"], len(feature)
                for side in (1, 2):
                    open_nodes[len(feature)] = (t, 2 * node + side)
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(0)
                    counts.append((0.0, 0.0))
                    tree_of.append(t)
                    heap.append(2 * node + side)
                    is_open.append(False)
        share = [n1 / (n0 + n1) if n0 + n1 else 0.0 for n0, n1 in counts]
        return {"feature": feature, "cut": cut, "left": left, "share": share, "counts": counts, "roots": list(range(trees)),
                "tree": tree_of, "heap": heap, "open": is_open}


def node_table(facts: dict) -> list[tuple]:
    """(tree, heap number, feature or None, cut or None, n0, n1) of every node."""
    out, todo = [], [(t, 0, t) for t in facts["roots"]]
    while todo:
        tree, node, p = todo.pop()
        split = facts["feature"][p] >= 0
        out.append((tree, node, facts["feature"][p] if split else None, facts["cut"][p] if split else None, *facts["counts"][p]))
        if split:
            todo += [(tree, 2 * node + 1, facts["left"][p]), (tree, 2 * node + 2, facts["left"][p] + 1)]
    return sorted(out, key=lambda r: r[:2])


# second-order boosting

def cut_places(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature the distinct values at ``bins`` - 1 quantiles; a cut c sends values below it to the left."""
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    found = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, max(10_000, 10 * bins)).alias("q")).orderBy("f").collect()
    return [np.unique(r["q"])[1:] for r in found]


class BoostedModel(ArrayModel):
    """Sum of the leaf weights a row reaches."""

    @staticmethod
    def prepared(facts):
        return Walk(facts["feature"], facts["cut"], facts["left"]), np.array(facts["weight"]), facts["roots"]

    @staticmethod
    def margins(ready, x):
        walk, weight, roots = ready
        return sum((weight[walk(x, r, True)] for r in roots), np.zeros(len(x)))


class BoostedTrees(ArrayEstimator):
    """Gradient boosting of the logistic loss with second derivatives.

    Values are cut into ``maxBins`` ranges. A level of a tree is one pass: sums of gradients G and second derivatives H per (node,
    feature, range), added up in Spark. A cut is worth GL^2/(HL + lambda) + GR^2/(HR + lambda) - G^2/(H + lambda), both
    sides need ``minChildWeight`` of H, and a branch whose cuts are all worth less than ``gamma`` is taken back. A leaf
    weighs -stepSize G/(H + lambda). Rows are drawn per tree by hash, columns by the order of their hashes.
    """

    stepSize = option("stepSize", "shrinkage of the leaf weights")
    maxIter = option("maxIter", "trees")
    maxDepth = option("maxDepth", "levels below the root")
    minChildWeight = option("minChildWeight", "least sum of second derivatives on a side")
    gamma = option("gamma", "least worth of a cut")
    regLambda = option("regLambda", "l2 penalty of the leaf weights")
    subsample = option("subsample", "share of the rows per tree")
    colsampleByTree = option("colsampleByTree", "share of the columns per tree")
    maxBins = option("maxBins", "ranges of values per feature")
    DEFAULTS = {"stepSize": 0.1, "maxIter": 100, "maxDepth": 3, "minChildWeight": 1.0, "gamma": 0.1, "regLambda": 1.0, "subsample": 1.0,
                "colsampleByTree": 1.0, "maxBins": 256}

    def _fit(self, df: DataFrame) -> BoostedModel:
        rows = stored(df, self.value("weightCol"))
        return BoostedModel(self.boost(rows))

    def boost(self, rows: DataFrame) -> dict:
        """Trees as flat arrays, with G and H per node and the cuts as values."""
        edges = cut_places(rows, self.value("maxBins"))
        d, width = len(edges), max([len(e) + 1 for e in edges], default=1)
        ranged = self._ranged(rows, edges)
        feature, cut, left, g, h, worth = [], [], [], [], [], []
        roots: list[int] = []
        fixed = 0  # trees whose weights are in the stored margin
        for t in range(self.value("maxIter")):
            order = sorted(range(d), key=lambda f: drawn(self.value("seed"), t, -1, f))
            columns = np.sort(order[:max(1, math.ceil(self.value("colsampleByTree") * d - 1e-9))]) if d else np.zeros(0, int)
            root = len(feature)
            roots.append(root)
            for store in (feature, left):
                store.append(-1)
            for store in (cut, g, h, worth):
                store.append(0.0)
            level, depth = [root], 0
            while level and d:
                sums = self._level(ranged, feature, cut, left, g, h, roots[fixed:-1], root, level, columns, width, t)
                following = []
                for p, s in zip(level, sums):
                    g[p], h[p] = float(s[0, 0].sum()), float(s[1, 0].sum())
                    if depth == self.value("maxDepth"):
                        continue
                    found = self._best(s, g[p], h[p], [len(edges[f]) for f in columns])
                    if found is None:
                        continue
                    gain, j, b = found
                    feature[p], cut[p], left[p], worth[p] = int(columns[j]), float(b), len(feature), gain
                    for _ in range(2):
                        following.append(len(feature))
                        for store in (feature, left):
                            store.append(-1)
                        for store in (cut, g, h, worth):
                            store.append(0.0)
                level, depth = following, depth + 1
            self._prune(root, feature, left, worth)
            if t + 1 - fixed >= REFRESH and t + 1 < self.value("maxIter"):
                ranged = self._refreshed(ranged, feature, cut, left, g, h, roots[fixed:])
                fixed = t + 1
        cuts = [float(edges[f][int(c) - 1]) if f >= 0 else 0.0 for f, c in zip(feature, cut)]
        return {"feature": feature, "cut": cuts, "left": left, "weight": self._weights(g, h).tolist(), "g": g, "h": h, "worth": worth, "roots": roots}

    def _weights(self, g, h) -> np.ndarray:
        return -self.value("stepSize") * np.asarray(g) / (np.asarray(h) + self.value("regLambda"))

    def _best(self, s: np.ndarray, g: float, h: float, cuts: list[int]):
        """(worth, column, range) of the best cut: ranges below the returned one go left. None if no cut is worth anything."""
        lam, least = self.value("regLambda"), self.value("minChildWeight")
        gl, hl = np.cumsum(s[0], axis=1)[:, :-1], np.cumsum(s[1], axis=1)[:, :-1]
        gr, hr = g - gl, h - hl
        gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)
        fits = (hl >= least) & (hr >= least) & (np.arange(gain.shape[1]) < np.array(cuts)[:, None])
        gain = np.where(fits, gain, -np.inf)
        if not gain.size or gain.max() <= TINY_GAIN:
            return None
        near = gain >= gain.max() - SAME * max(1.0, gain.max())  # the order of additions must not decide
        j, b = np.unravel_index(int(np.argmax(near)), gain.shape)
        return float(gain[j, b]), int(j), int(b) + 1

    def _prune(self, root: int, feature, left, worth) -> None:
        """Take back cuts worth less than gamma from the bottom up."""
        def leaf(p: int) -> bool:
            if feature[p] < 0:
                return True
            below = [leaf(left[p]), leaf(left[p] + 1)]
            if all(below) and worth[p] < self.value("gamma"):
                feature[p] = left[p] = -1
                return True
            return False
        leaf(root)

    @staticmethod
    def _ranged(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
        """Rows with the number of their range per feature and a margin of 0, stored."""
        def run(batches):
            for batch in batches:
                for x, rest in blocks([batch]):
                    out = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]).astype(np.int16)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([lists, *[pa.array(rest[c]) for c in ("label", "w", "h")], pa.array(np.zeros(len(x)))], ["x", "label", "w", "h", "margin"])
        return cut_lineage(rows.mapInArrow(run, "x array<smallint>, label double, w double, h bigint, margin double"))

    def _refreshed(self, ranged: DataFrame, feature, cut, left, g, h, roots) -> DataFrame:
        """The stored rows with the weights of ``roots`` added to their margin."""
        walk, weight, roots = Walk(feature, cut, left), self._weights(g, h), list(roots)

        def run(batches):
            for batch in batches:
                for a, (x, rest) in enumerate(blocks([batch])):
                    m = rest["margin"] + sum(weight[walk(x, r, True)] for r in roots)
                    part = batch.slice(a * BLOCK, len(x))
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(m)], part.schema.names)
        return cut_lineage(ranged.mapInArrow(run, ranged.schema))

    def _level(self, ranged, feature, cut, left, g, h, recent, root, level, columns, width, tree) -> np.ndarray:
        """Sums of gradients and second derivatives: (nodes of the level, 2, columns, ranges)."""
        walk, weight, recent = Walk(feature, cut, left), self._weights(g, h), list(recent)
        share, seed = self.value("subsample"), self.value("seed")
        per = max(1, MOST_NUMBERS // (2 * len(columns) * width))
        out = []
        for a in range(0, len(level), per):
            group = level[a:a + per]
            spot = np.full(len(feature), -1)
            spot[group] = np.arange(len(group))

            def sums(x, rest, spot=spot, group=group):
                m = rest["margin"] + sum(weight[walk(x, r, True)] for r in recent)
                p = 0.5 * (1.0 + np.tanh(0.5 * m))
                at = spot[walk(x, root, True)]
                use = at >= 0
                if share < 1.0:
                    use &= uniform(rest["h"], seed * 1_000_003 + tree) < share
                at, w, p, y, part = at[use], rest["w"][use], p[use], rest["label"][use], x[use]
                found = np.zeros((2, len(columns), len(group) * width))
                for i, values in enumerate((w * (p - y), w * p * (1.0 - p))):
                    for j, f in enumerate(columns):
                        found[i, j] = np.bincount(at * width + part[:, f], values, len(group) * width)
                return found.reshape(2, len(columns), len(group), width).transpose(2, 0, 1, 3)
            out.append(block_sums(ranged, sums, len(group) * 2 * len(columns) * width).reshape(len(group), 2, len(columns), width))
        return np.concatenate(out)


def tree_table(facts: dict) -> list[tuple]:
    """(tree, heap number, feature or None, cut or None, g, h, leaf weight or None) of every node that is left after pruning."""
    out, todo = [], [(t, 0, p) for t, p in enumerate(facts["roots"])]
    while todo:
        tree, node, p = todo.pop()
        split = facts["feature"][p] >= 0
        out.append((tree, node, facts["feature"][p] if split else None, facts["cut"][p] if split else None, facts["g"][p], facts["h"][p], None if split else facts["weight"][p]))
        if split:
            todo += [(tree, 2 * node + 1, facts["left"][p]), (tree, 2 * node + 2, facts["left"][p] + 1)]
    return sorted(out, key=lambda r: r[:2])
