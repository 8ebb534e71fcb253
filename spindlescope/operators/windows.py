"""Sliding windows over a drive's days, thinning, reshaping and history extension."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.config import smart_columns
from spindlescope.functions.names import pad_to, prime_factors
from spindlescope.operators.history import drive, forward
from spindlescope.session import lookup_rows


def dilated_lags(window: int, mode: str = "cumulative") -> list[int]:
    """Lag offsets for a window split into prime factors; the width is sum(f - 1) + 1.

    ``cumulative`` steps each factor by the product of the earlier ones (8 gives 0, 1, 3, 7);
    ``literal`` restarts at 1 for every factor (8 gives 0, 1, 1, 1).
    """
    steps, stride = [], 1
    for f in prime_factors(window):
        steps += [stride] * (f - 1) if mode == "cumulative" else [0] * (f - 1)
        stride *= f
    if mode == "cumulative":
        return [0, *accumulate(steps)]
    return [0, *[i + 1 for f in prime_factors(window) for i in range(f - 1)]]


def _buffer(cols: list[str], reach: int, label: str | None) -> Column:
    """The last ``reach`` + 1 days of a drive up to each row, as structs: one sliding buffer feeds all columns."""
    carried = [F.col(c).cast("double").alias(c) for c in cols] + ([F.col(label).alias("_label")] if label else [])
    return F.collect_list(F.struct(*carried)).over(forward().rowsBetween(-reach, 0))


def _picked(buf: str, cols: list[str], lags: list[int], label: str | None, exclude_oldest: bool, pad: str | None) -> tuple[Column, dict]:
    """Whether a row with the buffer ``buf`` has a window of these lags, and the window's columns."""
    reach, days = max(lags), F.col(buf)
    full = F.size(buf) == reach + 1 if pad is None else F.lit(True)
    if pad is not None:
        filler = F.element_at(buf, 1) if pad == "bfill" else F.lit(None)
        days = F.concat(F.array_repeat(filler, F.lit(reach + 1) - F.size(buf)), days)
    if lags != list(range(reach + 1)):
        days = F.array(*[F.element_at(days, -(lag + 1)) for lag in sorted(lags, reverse=True)])
    out = {"features": F.array(*[days[c] for c in cols])}
    if label:
        considered = F.slice(days, 2, max(len(lags) - 1, 1)) if exclude_oldest and len(lags) > 1 else days
        out["window_label"] = F.array_max(considered["_label"]).cast("int")
    return full, out


def _window_rows(df: DataFrame, cols: list[str], lags: list[int], label: str | None, exclude_oldest: bool,
                 pad: str | None) -> DataFrame:
    """Attach ``features`` (features x lags, oldest first) and ``window_label`` to every row."""
    full, out = _picked("_buf", cols, lags, label, exclude_oldest, pad)
    return df.withColumn("_buf", _buffer(cols, max(lags), label)).filter(full).withColumns(out).drop("_buf")


def _hybrid_rows(df: DataFrame, cols: list[str], window: int, lags: list[int], label: str | None, exclude_oldest: bool,
                 pad: str | None, skip_tail: int, align: str) -> DataFrame:
    """Full and dilated windows from one sort of the drives: each row gives none, one or both of them.

    A union of the two would sort every drive once per kind, and in one task if its sides are partitioned alike.
    """
    wide = list(range(window))
    rows = df.withColumns({
        "_full": _buffer(cols, max(wide), label), "_dilated": _buffer(cols, max(lags), label),
        "_pos": F.row_number().over(forward()) - 1, "_size": F.count(F.lit(1)).over(drive())})
    rows = rows.withColumn("_kept", F.lit(True))
    for f in prime_factors(window):
        kept, position, size = thin_positions(F.col("_pos"), F.col("_size"), f, skip_tail, align)
        rows = rows.withColumns({"_kept": F.col("_kept") & kept, "_pos": position.cast("long"), "_size": size.cast("long")})
    chosen = []
    for kind, steps, wanted in (("full", wide, F.col("validate_val") == 1), ("dilated", lags, F.col("_kept"))):
        enough, out = _picked(f"_{kind}", cols, steps, label, exclude_oldest, pad)
        made = [c.alias(name) for name, c in out.items()] + [F.lit(kind).alias("window_kind")]
        chosen.append(F.when(wanted & enough, F.struct(*made)))
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.filter(F.array(*chosen), lambda w: w.isNotNull())).alias("_window"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "_window.*")


def thin_positions(position: Column, size: Column, factor: int, skip_tail: int, align: str) -> tuple[Column, Column, Column]:
    """(kept?, new position, new size) of a thinning step, from 0-based position and drive length."""
    if align == "start":
        return position % factor == 0, F.floor(position / factor), F.ceil(size / F.lit(factor))
    offset = (size - 1) % factor
    stop = size - skip_tail
    kept = (position >= offset) & ((position - offset) % factor == 0) & (position < stop)
    left = F.greatest(F.lit(0), F.ceil((stop - offset) / F.lit(factor)))
    return kept, F.floor((position - offset) / factor), left


def thin_rows(df: DataFrame, factor: int, skip_tail: int = 7, align: str = "end") -> DataFrame:
    """Every ``factor``-th row of a drive, aligned to its end (training) or its start (scoring)."""
    return _thin(df, [factor], skip_tail, align)


def _thin(df: DataFrame, factors: list[int], skip_tail: int, align: str) -> DataFrame:
    """Successive thinning from one position and one count, as plain arithmetic."""
    out = df.withColumns({"_pos": F.row_number().over(forward()) - 1, "_size": F.count(F.lit(1)).over(drive())})
    for f in factors:
        kept, position, size = thin_positions(F.col("_pos"), F.col("_size"), f, skip_tail, align)
        out = out.withColumns({"_keep": kept, "_next": position.cast("long"), "_left": size.cast("long")}).filter("_keep")
        out = out.withColumns({"_pos": F.col("_next"), "_size": F.col("_left")})
    return out.drop("_pos", "_size", "_keep", "_next", "_left")


def lag_windows(df: DataFrame, cols: list[str], window: int, overlap: str = "full", lags: str = "cumulative",
                label: str | None = "predict_val", exclude_oldest: bool = False, pad: str | None = None,
                skip_tail: int = 7, align: str = "end", windowing: bool = True) -> DataFrame:
    """Windows of each drive, one row per window with ``features`` as features x lags.

    ``full`` takes every run of ``window`` days, ``dilated`` the prime-factor lags with thinning per
    factor, ``hybrid`` full windows for rows with ``validate_val`` = 1 stacked on dilated windows of
    all rows (column ``window_kind``). Rows without enough history are dropped, or padded with the
    first day (``pad="bfill"``) or NULL (``pad="null"``). ``windowing=False`` passes rows through.
    """
    label = label if label and label in df.columns else None
    if not windowing:
        return _window_rows(df, cols, [0], label, False, None)
    if overlap == "full":
        return _window_rows(df, cols, list(range(window)), label, exclude_oldest, pad)
    if overlap == "dilated":
        rows = _window_rows(df.withColumns({
            "_pos": F.row_number().over(forward()) - 1, "_size": F.count(F.lit(1)).over(drive()),
        }), cols, dilated_lags(window, lags), label, exclude_oldest, pad)
        return _thin_marked(rows, prime_factors(window), skip_tail, align)
    if overlap == "hybrid":
        return _hybrid_rows(df, cols, window, dilated_lags(window, lags), label, exclude_oldest, pad, skip_tail, align)
    raise ValueError(f"unknown overlap: {overlap}")


def _thin_marked(rows: DataFrame, factors: list[int], skip_tail: int, align: str) -> DataFrame:
    """Thinning on positions taken before warm-up rows were dropped."""
    for f in factors:
        kept, position, size = thin_positions(F.col("_pos"), F.col("_size"), f, skip_tail, align)
        rows = rows.withColumns({"_keep": kept, "_next": position.cast("long"), "_left": size.cast("long")}).filter("_keep")
        rows = rows.withColumns({"_pos": F.col("_next"), "_size": F.col("_left")})
    return rows.drop("_pos", "_size", "_keep", "_next", "_left")


def window_label(df: DataFrame, window: int, label: str = "predict_val", exclude_oldest: bool = False) -> DataFrame:
    """Largest label over the days of the window ending on the row."""
    back = window - 2 if exclude_oldest and window > 1 else window - 1
    return df.withColumn("window_label", F.max(label).over(forward().rowsBetween(-back, 0)))


def drop_warmup(df: DataFrame, n: int) -> DataFrame:
    """Remove the first ``n`` rows of every drive."""
    return df.withColumn("_rn", F.row_number().over(forward())).filter(F.col("_rn") > n).drop("_rn")


def warmup_rows(window: int, overlap: str = "full") -> int:
    """Rows to cut: window - 1 for full windows, 2^(k-1) - 1 with k prime factors for dilated ones."""
    return window - 1 if overlap == "full" else 2 ** (len(prime_factors(window)) - 1) - 1


def to_window_array(df: DataFrame, flat: str, width: int, out: str = "features") -> DataFrame:
    """Reshape a flat array (feature after feature, oldest first) into features x window."""
    count = (F.size(flat) / F.lit(width)).cast("int")
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(F.col(flat), i * width + 1, width)))


def flatten_windows(df: DataFrame, features: str = "features", out: str = "vector") -> DataFrame:
    """Windows as one dense vector per row for tabular learners."""
    return df.withColumn(out, array_to_vector(F.flatten(features)))


def grouped_lists(df: DataFrame) -> DataFrame:
    """One row per drive: its days and, per column from ``failure`` on, the values in date order."""
    values = [c for c in df.columns if c not in ("serial_number", "date", "model", "capacity_bytes")]
    days = F.sort_array(F.collect_list(F.struct("date", *values)))
    lists = df.groupBy("serial_number").agg(days.alias("_days"))
    return lists.select("serial_number", *[F.col("_days")[c].alias(c) for c in ["date", *values]])


def longest_history(df: DataFrame) -> int:
    """Days of the longest drive history: partial counts per drive, one number back."""
    return lookup_rows(df.groupBy("serial_number").count().agg(F.max("count").alias("n")))[0]["n"] or 0


def pad_series(lists: DataFrame, columns: list[str], pad: float = 2.0, length: int | None = None) -> DataFrame:
    """Pad each drive's series to the longest history; ``length`` keeps the true length per drive."""
    size = F.size(F.col(columns[0]))
    if length is None:
        length = lookup_rows(lists.agg(F.max(size).alias("n")))[0]["n"] or 0
    padded = {c: pad_to(F.transform(F.col(c), lambda x: x.cast("double")), length, pad) for c in columns}
    return lists.withColumn("length", size).withColumns(padded)


def drive_series_samples(df: DataFrame, features: list[str], horizon: int = 7, tail: int = 8) -> DataFrame:
    """Row samples per drive: failed drives up to the day before failure, healthy ones without their tail.

    The last ``horizon`` rows before a failure are labelled 1. A healthy drive loses its last
    ``tail`` rows, or one fewer if it has the longest history. Incomplete rows are dropped last.
    """
    longest = longest_history(df)
    rn = F.row_number().over(forward())
    work = df.withColumns({"_rn": rn, "_size": F.count(F.lit(1)).over(drive())})
    work = work.withColumn("_fail", F.min(F.when(F.col("failure") == 1, F.col("_rn"))).over(drive()))
    cut = F.when(F.col("_size") < longest, tail).otherwise(tail - 1)
    keep = F.when(F.col("_fail").isNotNull(), F.col("_rn") < F.col("_fail")).otherwise(F.col("_rn") <= F.col("_size") - cut)
    label = F.when(F.col("_fail").isNotNull() & (F.col("_rn") >= F.col("_fail") - horizon), 1).otherwise(0)
    return work.filter(keep).select("serial_number", "date", *features, label.alias("label")).na.drop(subset=features)


def extend_short_history(df: DataFrame, need: int, method: str = "duplicate", cols: list[str] | None = None) -> DataFrame:
    """Bring drives with fewer than ``need`` rows to ``need`` rows; longer drives pass unchanged.

    ``duplicate`` repeats the series, ``interpolate`` samples it at j * n / need with linear values
    between points. Adds ``position``, the 0-based order within the drive.
    """
    cols = cols or smart_columns(df)
    sized = df.withColumns({"_rn": F.row_number().over(forward()) - 1, "_size": F.count(F.lit(1)).over(drive())})
    if method == "duplicate":
        copies = F.when(F.col("_size") < need, F.ceil(F.lit(need) / F.col("_size"))).otherwise(1)
        spread = sized.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
        spread = spread.withColumn("position", (F.col("_copy") * F.col("_size") + F.col("_rn")).cast("long"))
        return spread.filter((F.col("_size") >= need) | (F.col("position") < need)).drop("_rn", "_size", "_copy")
    if method != "interpolate":
        raise ValueError(f"unknown extension method: {method}")
    long_enough = sized.filter(F.col("_size") >= need).withColumn("position", F.col("_rn").cast("long")).drop("_rn", "_size")
    others = [c for c in df.columns if c != "serial_number"]
    short = sized.filter(F.col("_size") < need).groupBy("serial_number").agg(
        F.sort_array(F.collect_list(F.struct("_rn", *others))).alias("_s"))
    grid = short.withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(need - 1).cast("long"))))
    n = F.size("_s")
    spot = F.col("position") * n / F.lit(float(need))
    low = F.element_at("_s", (F.floor(spot) + 1).cast("int"))
    high = F.element_at("_s", F.least(F.floor(spot) + 2, n).cast("int"))
    grid = grid.withColumns({"_lo": low, "_hi": high, "_f": spot - F.floor(spot)})
    made = [
        (F.col("_lo")[c] + (F.col("_hi")[c] - F.col("_lo")[c]) * F.col("_f")).alias(c) if c in cols else F.col("_lo")[c].alias(c)
        for c in others
    ]
    return long_enough.unionByName(grid.select("serial_number", *made, "position"))
