"""Splits, class balancing and synthetic rows; every choice is a hash of the row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.operators.neighbours import knn_join
from spindlescope.operators.ordering import exact_quantiles, hash_cutoffs, hash_number, hash_quantile_cuts, pick_by_hash, row_hash
from spindlescope.session import cut_lineage, lookup_join, lookup_rows, split_join

ROW_KEYS = ["serial_number", "date"]


def split_random(df: DataFrame, test: float = 0.3, seed: int = 42, label: str = "predict_val", keys=ROW_KEYS,
                 flag: str = "is_test") -> DataFrame:
    """Stratified row split: exactly ceil(test * n) rows of each class are marked as test rows."""
    return pick_by_hash(df, [label], list(keys), seed, lambda n: F.ceil(n * F.lit(float(test))), flag)


def split_by_drive(df: DataFrame, test: float = 0.3, seed: int = 42, label: str = "failure", flag: str = "is_test") -> DataFrame:
    """Whole drives to one side: floor(test * n) of the failed and of the healthy drives are test drives."""
    drives = df.groupBy("serial_number").agg(F.max(label).alias("_ever"))
    marked = pick_by_hash(drives, ["_ever"], ["serial_number"], seed, lambda n: F.floor(n * F.lit(float(test))), flag)
    return df.join(marked.select("serial_number", flag), "serial_number")


def split_drives_stratified(df: DataFrame, train: float = 0.7, seed: int = 42, flag: str = "is_test") -> DataFrame:
    """Drive-level split with the class shares kept on both sides."""
    drives = df.groupBy("serial_number").agg(F.max("failure").alias("_ever"))
    share = 1.0 - train
    marked = pick_by_hash(drives, ["_ever"], ["serial_number"], seed, lambda n: F.ceil(F.round(n * F.lit(share), 9)), flag)
    return df.join(marked.select("serial_number", flag), "serial_number")


def split_by_time(df: DataFrame, test: float = 0.3, seed: int = 42, keys=ROW_KEYS, flag: str = "is_test") -> DataFrame:
    """The first floor((1 - test) * n) rows by date train, the rest test; ties in hash order.

    The cut day follows from one count per calendar day; only that day's rows are ranked.
    """
    days = lookup_rows(df.groupBy("date").agg(F.count(F.lit(1)).alias("n")))
    total = sum(r["n"] for r in days)
    left, cut_day, need = int(total * (1.0 - test)), None, 0
    for r in sorted(days, key=lambda r: r["date"]):
        if left <= r["n"]:
            cut_day, need = r["date"], left
            break
        left -= r["n"]
    if cut_day is None:
        return df.withColumn(flag, F.lit(False))
    edge = df.filter(F.col("date") == F.lit(cut_day)).select(F.lit(0).alias("_s"), row_hash(list(keys), seed).alias("_h"))
    cuts = lookup_rows(hash_cutoffs(edge, ["_s"], lambda n: F.lit(need)))
    limit = cuts[0]["_cut"] if cuts else ""
    early = (F.col("date") == F.lit(cut_day)) & (row_hash(list(keys), seed) <= F.lit(limit))
    return df.withColumn(flag, ~((F.col("date") < F.lit(cut_day)) | early))


def label_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in lookup_rows(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))}


def _check_ratio(ratio) -> None:
    if ratio != "auto" and not (isinstance(ratio, (int, float)) and 0 < ratio <= 1):
        raise ValueError(f"ratio is minority / majority after resampling, in (0, 1] or 'auto': {ratio}")


def undersample(df: DataFrame, ratio="auto", label: str = "predict_val", keys=ROW_KEYS, seed: int = 42) -> DataFrame:
    """Drop rows of the larger classes until minority / class size reaches ``ratio``."""
    _check_ratio(ratio)
    counts = label_counts(df, label)
    few = min(counts.values())
    target = few if ratio == "auto" else int(few / ratio)
    quota = df.sparkSession.createDataFrame([(c, min(n, target)) for c, n in counts.items()],
                                            f"{label} {df.schema[label].dataType.simpleString()}, quota long")
    return pick_by_hash(df, [label], list(keys), seed, quota).filter("picked").drop("picked")


def _copies(rows: DataFrame, strata: list[str], plan: DataFrame, id_col: str, seed) -> DataFrame:
    """Spread ``new`` synthetic rows of each stratum over its ``n`` rows: n // rows each, one more by hash.

    ``plan`` is (strata, n, new). Result: one row per synthetic row with its ``_copy`` number.
    """
    work = pick_by_hash(rows, strata, [id_col], seed, plan.select(*strata, F.expr("new % n").alias("quota")), "_one_more")
    work = lookup_join(work, plan, strata)
    count = F.floor(F.col("new") / F.col("n")) + F.col("_one_more").cast("int")
    out = work.withColumn("_count", count.cast("int")).filter("_count > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count", "_one_more", "n", "new")


def _between_neighbours(copies: DataFrame, near: DataFrame, vectors: DataFrame, id_col: str, vec: str, keep: list[str],
                        seed, step: float) -> DataFrame:
    """x + step * u * (neighbour - x), neighbour and u drawn by hash of (row, copy, seed)."""
    lists = near.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))
    pick = F.pmod(hash_number([id_col, "_copy"], f"{seed}-neighbour"), F.size("_near")).cast("int")
    drawn = copies.join(lists, id_col).withColumn("_nid", F.col("_near")[pick]["neighbour"]).drop("_near")
    others = vectors.select(F.col(id_col).alias("_nid"), F.col(vec).alias("_other"))
    u = hash_number([id_col, "_copy"], f"{seed}-step") / F.lit(float(1 << 32)) * F.lit(float(step))
    mixed = split_join(cut_lineage(drawn), others, ["_nid"]).withColumn("_u", u)
    new = F.zip_with(vec, "_other", lambda x, y: x + F.col("_u") * (y - x))
    return mixed.select(F.col(id_col).alias("parent"), F.col("_nid").alias("neighbour"), F.col("_copy").alias("copy"), new.alias(vec), *keep)


def smote(df: DataFrame, ratio="auto", k: int = 5, seed: int = 42, label: str = "predict_val", id_col: str = "vec_id",
          vec: str = "vec") -> DataFrame:
    """Synthetic rows of the smallest class: (parent, neighbour, copy, vec, label).

    ``auto`` fills it up to the largest class, a number to that share of it. Neighbours come from
    the smallest class only.
    """
    _check_ratio(ratio)
    counts = label_counts(df, label)
    small = min(counts, key=lambda c: (counts[c], str(c)))
    new = (max(counts.values()) if ratio == "auto" else int(ratio * max(counts.values()))) - counts[small]
    if counts[small] <= k:
        raise ValueError(f"class {small} has {counts[small]} rows, fewer than k + 1 = {k + 1}")
    few = df.filter(F.col(label) == F.lit(small)).select(id_col, vec, label)
    near = knn_join(few, few, k, id_col=id_col, vec=vec, exclude_self=True)
    kind = df.schema[label].dataType.simpleString()
    plan = df.sparkSession.createDataFrame([(small, counts[small], max(new, 0))], f"{label} {kind}, n long, new long")
    return _between_neighbours(_copies(few, [label], plan, id_col, seed), near, few, id_col, vec, [label], seed, 1.0)


def balance(df: DataFrame, over=None, under=None, k: int = 5, seed: int = 42, label: str = "predict_val",
            id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """Over-sampling, then under-sampling, each with its own ratio; for the training side only.

    Synthetic rows get the id ``<parent>+<copy>``; ids become strings.
    """
    rows = df.select(F.col(id_col).cast("string").alias(id_col), vec, label, F.lit(False).alias("synthetic"))
    if over is not None:
        made = smote(df, over, k, seed, label, id_col, vec)
        name = F.concat_ws("+", F.col("parent").cast("string"), F.col("copy").cast("string"))
        rows = rows.unionByName(made.select(name.alias(id_col), vec, label, F.lit(True).alias("synthetic")))
    return undersample(rows, under, label, [id_col], seed) if under is not None else rows


def slice_edges(df: DataFrame, time: Column, n: int = 10) -> list[float]:
    """Quantile edges of the times, from counts per distinct time."""
    probs = {f"e{i}": i / n for i in range(n + 1)}
    row = lookup_rows(exact_quantiles(df.select(time.cast("double").alias("t")), [], ["t"], probs))[0]
    return [row[f"e{i}"] for i in range(n + 1)]


def time_slices(df: DataFrame, time: str = "date", n: int = 10, out: str = "slice") -> DataFrame:
    """Equal-frequency time slices, numbered from 0; the last slice includes its upper edge."""
    value = F.unix_date(time) if df.schema[time].dataType.typeName() == "date" else F.col(time).cast("double")
    edges = slice_edges(df, value, n)
    spot = sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn(out, spot)


def time_smote(df: DataFrame, time: str, k: int = 5, n_slices: int = 10, step: float = 0.5, seed: int = 42,
               label: str = "label", id_col: str = "vec_id", vec: str = "vec", strategy=None) -> DataFrame:
    """Synthetic rows between neighbours of the same time slice: (slice, parent, neighbour, vec, label).

    Per slice and class half the gap to the largest class is filled; slices and classes with fewer
    than k + 1 rows are skipped. ``strategy`` replaces the gap by ``sampling_targets``.
    """
    sliced = time_slices(df, time, n_slices).select("slice", id_col, vec, label)
    counts = label_counts(sliced, label)
    if strategy is None:
        gaps = {c: (max(counts.values()) - n) // 2 for c, n in counts.items()}
    else:
        gaps = sampling_targets(counts, strategy)
    kind = df.schema[label].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(c, int(n)) for c, n in gaps.items() if n > 0], f"{label} {kind}, new long")
    sizes = cut_lineage(sliced.groupBy("slice", label).agg(F.count(F.lit(1)).alias("n")))
    full = sizes.groupBy("slice").agg(F.sum("n").alias("_rows")).filter(F.col("_rows") > k).select("slice")
    plan = sizes.filter(F.col("n") > k).join(full, "slice", "left_semi").join(F.broadcast(wanted), label).select("slice", label, "n", "new")
    parents = lookup_join(sliced, plan.select("slice", label), ["slice", label])
    near = knn_join(parents, sliced, k, "slice", id_col, vec, exclude_self=True)
    copies = _copies(parents, ["slice", label], plan, id_col, seed)
    return _between_neighbours(copies, near, sliced, id_col, vec, ["slice", label], seed, step)


def sampling_targets(counts: dict, strategy) -> dict:
    """New rows per class for a strategy name, a minority share or explicit numbers."""
    if isinstance(strategy, dict):
        return dict(strategy)
    top = max(counts.values())
    smallest = min(counts, key=lambda c: (counts[c], str(c)))
    largest = max(counts, key=lambda c: (counts[c], str(c)))
    if isinstance(strategy, float):
        return {smallest: int(strategy * top) - counts[smallest]}
    chosen = {
        "minority": lambda c: c == smallest,
        "not minority": lambda c: c != smallest,
        "not majority": lambda c: c != largest,
        "all": lambda c: True,
    }.get(strategy, lambda c: False)
    return {c: top - n for c, n in counts.items() if chosen(c)}


def sampling_target_report(df: DataFrame, strategy, label: str = "label") -> DataFrame:
    counts = label_counts(df, label)
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(sampling_targets(counts, strategy).items()), f"{label} {kind}, new_rows long")


def shuffle(df: DataFrame, seed: int = 42, keys=ROW_KEYS) -> DataFrame:
    """Repeatable random row order: a range-partitioned sort on a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), *keys)


def class_weights(df: DataFrame, weights: dict, label: str = "predict_val", out: str = "weight") -> DataFrame:
    """Weight column for learners that take one; classes without an entry weigh 1."""
    w = F.lit(1.0)
    for cls, value in weights.items():
        w = F.when(F.col(label) == F.lit(cls), F.lit(float(value))).otherwise(w)
    return df.withColumn(out, w)


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "predict_val", keys=ROW_KEYS, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold number per row, with each class spread evenly.

    Folds are consecutive stretches of the class in hash order, found from k - 1 cut-off hashes per
    class, so no class is ever sorted in one place.
    """
    work = df.withColumn("_h", row_hash(list(keys), seed))
    cut = lookup_join(work, hash_quantile_cuts(work.select(label, "_h"), [label], k), [label], "left")
    fold = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_h"))), F.lit(0))
    return cut.withColumn(out, fold.cast("int")).select(*df.columns, out)
