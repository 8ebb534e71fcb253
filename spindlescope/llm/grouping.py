"""Groups of linked rows: pairs from shared buckets, verified, then connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import may_be_in, spread, stage

#: Pivot rounds at most before all pairs that are still open inside a bucket are compared.
PIVOT_ROUNDS = 4
#: Open pairs per member of an open bucket above which one more pivot round comes first. Comparing costs little: only
#: pairs that pass the cheap test become rows.
OPEN_PAIRS = 256
#: Buckets of more than HOT members are dealt to PARTS tasks.
HOT, PARTS = 1024, 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): one row (id, root) per id in a pair, root the smallest id of its component.

    Alternating large and small stars: each round hangs neighbours on the smallest one known, until nothing changes. Every
    round is stored, keys with many neighbours are split.
    """
    e = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread(both.where("v > u"), least, "u", "v", parts=PARTS).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = spread(large, least, "u", "v", parts=PARTS).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = stage(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return stage(e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct())


def _part(hot: Column) -> Column:
    return F.when(hot, F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0)).alias("part")


def _parts(hot: Column) -> Column:
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part")


def _meet(rows: DataFrame, small: DataFrame, hot: Column) -> DataFrame:
    """Join rows (bucket, id, ...) to ``small`` (one row per bucket), hot buckets in parts; ``hot`` depends on the bucket alone."""
    return rows.withColumn("part", _part(hot)).join(small.select("*", _parts(hot)).drop("n"), ["bucket", "part"]).drop("part")


def _pairs(met: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    return met.where(near(F.col("note"), F.col("pnote"))).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()


def linked_groups(members: DataFrame, notes: DataFrame, near: Callable[[Column, Column], Column],
                  tests: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame] | None]],
                  compare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of all links inside buckets, without building all pairs of a bucket.

    ``members``: bucket, id (read twice); ``notes``: id, note (stored). ``near(note, note)``: cheap test that links pass.
    ``tests``: the ids (id) that share a bucket at all to (verify, sharpen). ``verify``: pairs (a, b) to the linked ones among
    them. ``sharpen``, or None: the ids of all open buckets to better notes (id, note); an id it leaves out has no link to
    another of them. ``compare``, or None: the members of all open buckets (bucket, id, note, root) to pairs (a, b) that connect
    what their links connect; without it, the last round builds the pairs of different components as rows and verifies each.

    Each bucket first compares its members with one pivot. What that links needs no further comparison; while a bucket's
    members are in many components it takes another pivot by a hash, then its members of different components are compared,
    part by part. No link between two components is lost: any pair that shares a bucket and passes ``near`` is either verified
    or already connected. Returns (id, root) for ids with a link.
    """
    multi = stage(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    hot = may_be_in(multi.where(F.col("n") > HOT), "bucket")
    shared = members.where(may_be_in(multi, "bucket"))
    met = shared.withColumn("part", _part(hot)).join(multi.select("bucket", "n", _parts(hot)), ["bucket", "part"])
    rows = stage(met.join(notes, "id").select("bucket", "id", "note", F.col("id").alias("root"), "n"))
    large = F.col("n") > HOT
    verify, sharpen = tests(stage(rows.select("id").distinct()))
    done, roots, turn = None, None, 0
    while True:
        if roots is None:
            pick, last = F.min(F.struct("id", "note", "root")), False
        else:
            named = rows.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
            sizes = named.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.max("n").alias("n"))
            still = stage(sizes.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("r"), F.max("n").alias("n")).where("r > 1"))
            left = still.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("open"), F.sum("m").alias("m")).first()
            if not left["m"]:
                return roots
            rows = stage(_meet(named, still.select("bucket", "n"), large))
            if sharpen and turn == 1:
                rows = stage(rows.drop("note").join(stage(sharpen(rows.select("id").distinct())), "id"))
            last = turn > PIVOT_ROUNDS or left["open"] <= OPEN_PAIRS * left["m"]
            pick = F.min_by(F.struct("id", "note", "root"), F.xxhash64("id", "bucket", F.lit(turn)))
        if last and compare:
            found = stage(compare(rows.select("bucket", "id", "note", "root")))
            if found.limit(1).count():
                roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found))
            return roots
        if last:
            other = rows.select("bucket", *[F.col(c).alias(f"p{c}") for c in ("id", "note", "root")], _parts(large))
            met = rows.withColumn("part", _part(large)).join(other, ["bucket", "part"]).where("root < proot")
        else:
            pivots = rows.groupBy("bucket").agg(pick.alias("p"), F.max("n").alias("n")).select("bucket", "n", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("id", "note", "root")])
            met = _meet(rows, pivots, large).where("root != proot")
        fresh = _pairs(met, near)
        fresh = stage(fresh if done is None else fresh.join(done, ["a", "b"], "left_anti"))
        done = fresh if done is None else done.unionByName(fresh)
        found = stage(verify(fresh))
        if roots is None:
            roots = components(found)
        elif found.limit(1).count():
            roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found))
        if last:
            return roots
        turn += 1
