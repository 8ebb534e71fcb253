"""Exact ranks, cut-offs and quantiles without sorting a whole class in one task.

Two facts carry this module. A selection of exactly q rows in hash order needs only the hash of
the q-th row: 65,536 hash buckets are counted first, and only the one bucket that holds the
cut-off is ranked; quantiles likewise narrow ranges of values until each holds one. Running totals over a sorted column need only distinct values: equal values
are counted first, so a value that fills a third of the table is one row afterwards, and the
distinct values are cut into ranges that are summed separately and then offset.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlescope.session import cut_lineage, lookup_join

SINGLE_RANGE_ROWS = 200_000
#: Rows left in open ranges from which on their distinct values are counted.
FEW_ROWS = 1_000_000
RANGES = 256
#: Accuracy of the quantile sketches that choose cuts, and how far beside a wanted quantile the first cuts are set.
SKETCH, SKETCH_SLACK = 10_000, 2e-4


def row_hash(keys: list[str], seed) -> Column:
    """Repeatable pseudo-random key of a row; equal in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_number(keys: list[str], seed) -> Column:
    """Repeatable whole number in [0, 2^32) from the first eight hex digits of the row hash."""
    return F.conv(F.substring(row_hash(keys, seed), 1, 8), 16, 10).cast("long")


def hash_cutoffs(hashed: DataFrame, strata: list[str], quota: Callable[[Column], Column] | DataFrame) -> DataFrame:
    """Per stratum the hash of the quota-th row in hash order (``_cut``); none where the quota is 0.

    ``hashed`` holds the strata columns and ``_h``. ``quota`` is a function of the stratum's row
    count ``n`` or a frame (strata, ``quota``).
    """
    by = Window.partitionBy(*strata)
    counts = hashed.groupBy(*strata, F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cum", F.sum("_n").over(by.orderBy("_b"))).withColumn("_all", F.sum("_n").over(by))
    if isinstance(quota, DataFrame):
        counts = lookup_join(counts, quota.select(*strata, F.col("quota").alias("_q")), strata)
    else:
        counts = counts.withColumn("_q", quota(F.col("_all")))
    counts = counts.withColumn("_q", F.least(F.col("_q").cast("long"), F.col("_all")))
    edge = counts.filter("_cum >= _q AND _cum - _n < _q").select(*strata, "_b", F.expr("_q - (_cum - _n)").alias("_need"))
    rows = lookup_join(hashed.withColumn("_b", F.substring("_h", 1, 4)), edge, [*strata, "_b"])
    ranked = rows.withColumn("_rn", F.row_number().over(by.orderBy("_h")))
    return ranked.filter("_rn = _need").select(*strata, F.col("_h").alias("_cut"))


def hash_quantile_cuts(hashed: DataFrame, strata: list[str], parts: int) -> DataFrame:
    """Per stratum the ``parts`` - 1 hashes that end each of ``parts`` equal stretches (``_cuts``, ascending)."""
    by = Window.partitionBy(*strata)
    bucket = F.substring("_h", 1, 4)
    counts = hashed.groupBy(*strata, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cum", F.sum("_n").over(by.orderBy("_b"))).withColumn("_all", F.sum("_n").over(by))
    ends = F.array(*[F.floor(F.col("_all") * i / F.lit(parts)) for i in range(1, parts)])
    inside = F.filter(ends, lambda e: (e <= F.col("_cum")) & (e > F.col("_cum") - F.col("_n")))
    edge = counts.select(*strata, "_b", F.transform(inside, lambda e: e - (F.col("_cum") - F.col("_n"))).alias("_needs"))
    rows = lookup_join(hashed.withColumn("_b", bucket), edge.filter(F.size("_needs") > 0), [*strata, "_b"])
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h")).cast("long"))
    cuts = ranked.filter(F.array_contains("_needs", F.col("_rn")))
    return cuts.groupBy(*strata).agg(F.sort_array(F.collect_list("_h")).alias("_cuts"))


def pick_by_hash(df: DataFrame, strata: list[str], keys: list[str], seed,
                 quota: Callable[[Column], Column] | DataFrame, flag: str = "picked") -> DataFrame:
    """Mark exactly quota rows per stratum, chosen in hash order of ``keys``.

    ``keys`` must identify a row within its stratum.
    """
    work = df.withColumn("_h", row_hash(keys, seed))
    by = strata
    if not strata:
        work, by = work.withColumn("_s", F.lit(0)), ["_s"]
    cuts = hash_cutoffs(work.select(*by, "_h"), by, quota)
    marked = lookup_join(work, cuts, by, "left")
    out = marked.withColumn(flag, F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)))
    return out.select(*df.columns, flag)


def long_form(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """One row per feature value: (keep…, feature, value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(*keep, F.inline(pairs)).filter("value IS NOT NULL")


def value_counts(df: DataFrame, groups: list[str], features: list[str], splits: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with counts; ``splits`` adds conditional counts under their names."""
    rows = long_form(df, sorted({*groups, *_inputs(splits)}), features)
    extra = [F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, (c, _) in (splits or {}).items()]
    return rows.groupBy(*groups, "feature", "value").agg(F.count(F.lit(1)).alias("n"), *extra)


def _inputs(splits) -> set[str]:
    return {name for _, (_, names) in (splits or {}).items() for name in names}


def running_totals(counts: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_<c>`` per column of ``sums``: totals over rows of the group with value <= this one.

    ``counts`` has one row per (groups, order) value. Few rows are summed in one window; more
    are cut at approximate quantiles of the distinct values, so no task sorts a whole group.
    """
    counts = cut_lineage(counts)
    if counts.count() <= SINGLE_RANGE_ROWS:
        w = Window.partitionBy(*groups).orderBy(order)
        return counts.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums})
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = counts.groupBy(*groups).agg(F.percentile_approx(order, probs, 10_000).alias("_bounds"))
    cut = lookup_join(counts, bounds, groups)
    cut = cut.withColumn("_r", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")
    before = Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*groups, "_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*groups, "_r", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*groups, "_r").orderBy(order)
    out = lookup_join(cut, offsets, [*groups, "_r"])
    out = out.withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"_o_{c}") for c in sums})
    return out.select(*counts.columns, *[f"cum_{c}" for c in sums])


def exact_quantiles(df: DataFrame, groups: list[str], features: list[str], probs: dict[str, float], sizes: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per (groups, feature), one column per entry of ``probs``; null values and groups are left out.

    ``df`` is read a few times (counts and limits, then two scans a round), so it should be a table or a cheap view of one;
    per round only counts of value ranges are shuffled. ``sizes`` may hand in stored (groups, feature, n, lo, hi): count and
    limits of the values that are not null.
    """
    keys = [*groups, "feature"]
    rows = long_form(df, groups, features)
    if sizes is None:
        sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    spots = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in probs.items()}
    ranks = F.array_distinct(F.array(*[side(s).cast("long") for s in spots.values() for side in (F.floor, F.ceil)]))
    found = values_at_ranks(rows, keys, sizes.withColumn("ranks", ranks), list(probs.values()))
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    out = []
    for name, spot in spots.items():
        low, high = (F.col("_at")[side(spot).cast("long")] for side in (F.floor, F.ceil))
        share = spot - F.floor(spot)
        out.append(F.when(share == 0, low).otherwise(low + (high - low) * share).alias(name))
    return lookup_join(sizes, at, keys).select(*keys, *out)


def values_at_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, probs: list[float]) -> DataFrame:
    """(keys, rank, value): the values at given 0-based ranks, found by narrowing ranges.

    ``rows`` holds ``keys`` and ``value``; ``wanted`` has one row per key with its count ``n``, limits ``lo`` and ``hi`` and ``ranks``;
    ``probs`` says about where the ranks lie. A round cuts every open range at values of a quantile sketch, counts the rows at and
    between the cuts, and keeps open only ranges that hold a wanted rank and more than one value. Counts decide, the sketch
    only chooses cuts, so results are exact; a cut that is itself a heavy value is settled at once, and every round leaves its
    cuts behind, so ranges shrink. When few rows are left in open ranges, their distinct values are counted.
    """
    near = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-SKETCH_SLACK, SKETCH_SLACK)})
    grid = [i / RANGES for i in range(RANGES + 1)]
    state = wanted.select(*keys, "lo", "hi", "n", "ranks", F.lit(0).cast("long").alias("below"))
    settled, spot = [], [*keys, "lo"]
    while (left := state.agg(F.sum("n")).first()[0]):
        inside = lookup_join(rows, state.drop("n"), keys).filter("value BETWEEN lo AND hi")
        if left <= FEW_ROWS:
            slot = F.col("value")
        else:
            cuts = F.percentile_approx("value", F.array(*map(F.lit, grid if settled else near)), SKETCH)
            inside = lookup_join(inside, inside.groupBy(*spot).agg(F.array_distinct(cuts).alias("_cuts")), spot)
            slot = F.size(F.filter("_cuts", lambda c: c < F.col("value"))) * 2 + F.array_contains("_cuts", F.col("value")).cast("int")
        counts = inside.groupBy(*spot, slot.alias("_slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
            F.first("below").alias("below"), F.first("ranks").alias("ranks"))
        before = F.sum("n").over(Window.partitionBy(*spot).orderBy("least")) - F.col("n") + F.col("below")
        counts = counts.withColumn("_before", before)
        held = F.filter("ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("n")))
        hit = counts.withColumn("ranks", held).filter(F.size("ranks") > 0)
        last = left <= FEW_ROWS
        hit = hit if last else cut_lineage(hit)
        settled.append(hit.filter("least = most").select(*keys, F.explode("ranks").alias("rank"), F.col("least").alias("value")))
        if last:
            break
        state = hit.filter("least < most").select(*keys, F.col("least").alias("lo"), F.col("most").alias("hi"), "n", "ranks", F.col("_before").alias("below"))
    if not settled:
        return rows.select(*keys, F.lit(0).cast("long").alias("rank"), "value").limit(0)
    return reduce(DataFrame.union, settled)
