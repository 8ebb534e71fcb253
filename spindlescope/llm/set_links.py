"""Links between sets inside a bucket, chunk against chunk in tasks: sets travel once per chunk pair, pairs never become rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Set elements per chunk of a bucket; a task holds two chunks at most, or two sets where a set is larger.
CHUNK_ELEMENTS = 1 << 20
#: Sets per side, and elements at a time, of one matrix product.
TILE, COLUMNS = 512, 4096


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every set of ``a`` with every set of ``b``, as products of 0/1 matrices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(both), COLUMNS):
        part, sides = both[at:at + COLUMNS], []
        for flat, row, sets in ((flat_a, row_a, a), (flat_b, row_b, b)):
            place = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            there = part[place] == flat
            side = np.zeros((len(sets), len(part)), np.float32)
            side[row[there], place[there]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def forest(sets: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (one of ``left``, one of ``right``) that connect all groups which linked sets connect.

    ``group``: what is connected from the start; it is changed. Every pair of different groups is compared.
    """
    sizes, found, same = np.array([len(s) for s in sets], np.int64), [], np.array_equal(left, right)
    left, right = (x[np.argsort(sizes[x], kind="stable")] for x in (left, right))
    for i in range(0, len(left), TILE):
        a = left[i:i + TILE]
        for j in range(i if same else 0, len(right), TILE):
            b = right[j:j + TILE]
            if sizes[b[-1]] * 100 < sizes[a[0]] * percent or sizes[a[-1]] * 100 < sizes[b[0]] * percent:
                continue
            if len(np.unique(group[np.concatenate([a, b])])) == 1:
                continue
            common = common_counts([sets[k] for k in a], [sets[k] for k in b])
            linked = common * 100 >= (sizes[a][:, None] + sizes[b][None, :] - common) * percent
            for r in np.flatnonzero(linked.any(axis=1)):
                near = b[linked[r]]
                while len(near := near[group[near] != group[a[r]]]):
                    found.append((int(a[r]), int(near[0])))
                    group[group == group[near[0]]] = group[a[r]]
    return found


def compare_chunks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids that connect what the links inside each bucket connect; a link: a similarity of ``percent`` / 100 or more.

    ``rows``: bucket, id, note (with the size n of the set), root (ids with equal roots are connected already); ``sets``: id, set
    of distinct longs, where an id may have several. The members of a bucket are dealt to chunks by a hash of the id, as many as
    its elements need; every pair of chunks is one group of rows, so a large bucket is many groups, each of bounded size. All
    pairs of different roots are compared on full sets; a task returns a spanning forest of its links, not the links.
    """
    need = rows.groupBy("bucket").agg(F.ceil(F.sum(F.col("note.n")) / F.lit(CHUNK_ELEMENTS)).cast("int").alias("chunks"))
    dealt = rows.join(need, "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = dealt.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "root")
    kind = rows.schema["id"].dataType.simpleString()

    def links(table: pa.Table) -> pa.Table:
        ids, chunk = table.column("id").combine_chunks(), table.column("chunk").to_numpy()
        lists = table.column("set").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        members = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
        group = np.array(table.column("root").combine_chunks().dictionary_encode().indices, np.int64)
        low, high = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
        pairs = np.array(forest(members, group, low, high, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": ids.take(pa.array(pairs[:, 0])), "b": ids.take(pa.array(pairs[:, 1]))})

    found = keyed.join(sets, "id").groupBy("bucket", "i", "j").applyInArrow(links, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
