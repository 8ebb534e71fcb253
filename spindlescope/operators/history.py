"""Per-drive calendar operators: spine, gap rule, interpolation, padding, horizon labels.

Every operator here partitions by serial number. A drive has at most one row per day, so a
window holds at most as many rows as the calendar has days, whatever the size of the table; the
spine, the gap rule, the fills and the labels all reuse one hash partitioning by serial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from spindlescope.config import LABELS
from spindlescope.functions.names import snap_to_zero
from spindlescope.operators.selection import drop_null_rows, drop_sparse_columns

def drive() -> WindowSpec:
    return Window.partitionBy("serial_number")


def forward() -> WindowSpec:
    return drive().orderBy("date")


def backward() -> WindowSpec:
    return drive().orderBy(F.col("date").desc())


def daily_spine(df: DataFrame, gap_flag: str | None = None) -> DataFrame:
    """One row per calendar day between a drive's first and last day; added days hold NULL.

    Each row is stretched to the day before the next one, so no join and no second shuffle runs.
    """
    follow = F.date_sub(F.lead("date").over(forward()), 1)
    stretched = df.withColumn("_until", F.greatest(F.col("date"), F.coalesce(follow, F.col("date"))))
    days = stretched.withColumn("_day", F.explode(F.sequence("date", "_until")))
    real = F.col("_day") == F.col("date")
    values = [c for c in df.columns if c not in ("serial_number", "date")]
    cols = [F.when(real, F.col(c)).alias(c) for c in values]
    if gap_flag:
        cols.append((~real).alias(gap_flag))
    return days.select("serial_number", F.col("_day").alias("date"), *cols)


def missing_window_flags(df: DataFrame, window_days: int, tolerance: float, max_missing: int | None = None,
                         columns: list[str] | None = None) -> DataFrame:
    """Rolling sum and mean of null flags over ``window_days`` days, and whether the day breaks the rule.

    The exact rule is sum > mean * ``tolerance``; with ``max_missing`` it is sum > ``max_missing``.
    On complete rows a day is either there or absent, so one flag stands for all columns; give
    ``columns`` to test each of them on rows that still hold nulls.
    """
    spine = daily_spine(df, "_gap")
    last_days = forward().rowsBetween(-(window_days - 1), 0)
    flags = [F.col(c).isNull() for c in columns] if columns else [F.col("_gap")]
    rolled = {f"_s{i}": F.sum(f.cast("int")).over(last_days) for i, f in enumerate(flags)}
    rolled["_days"] = F.count(F.lit(1)).over(last_days)
    sums = [F.col(f"_s{i}") for i in range(len(flags))]
    worst = F.greatest(*sums) if len(sums) > 1 else sums[0]
    share = worst / F.col("_days")
    limit = share * F.lit(float(tolerance)) if max_missing is None else F.lit(max_missing)
    return spine.withColumns(rolled).withColumns({
        "n_missing": worst.cast("long"), "mean_missing": share, "breaks_rule": worst > limit, "is_gap": F.col("_gap"),
    }).drop("_gap", *rolled)


def _judge_drives(df: DataFrame, min_days: int, window_days: int, tolerance: float, max_missing: int | None) -> DataFrame:
    """Complete rows with the verdict on their drive, in one partitioning by serial."""
    flagged = missing_window_flags(df, window_days, tolerance, max_missing)
    return flagged.withColumns({
        "_short": F.sum((~F.col("is_gap")).cast("int")).over(drive()) < min_days,
        "_gappy": F.max(F.col("breaks_rule").cast("int")).over(drive()) == 1,
    })


def filter_drives(df: DataFrame, min_days: int, window_days: int, tolerance: float, max_missing: int | None = None,
                  min_pct: float = 45.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sparse columns out, incomplete rows out, then drives that are short or break the gap rule.

    Returns (kept rows, serials breaking the gap rule, serials with too few days).
    """
    complete = drop_null_rows(drop_sparse_columns(df, min_pct))
    judged = _judge_drives(complete, min_days, window_days, tolerance, max_missing)
    kept = judged.filter("NOT _short AND NOT _gappy AND NOT is_gap").select(*complete.columns)
    short = judged.filter("_short").select("serial_number").distinct()
    gappy = judged.filter("NOT _short AND _gappy").select("serial_number").distinct()
    return kept, gappy, short


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _marks(c: str) -> dict[str, Column]:
    """Nearest filled day before and after, as (day number, value), under fixed helper names."""
    mark = F.when(F.col(c).isNotNull(), F.struct(F.unix_date("date").alias("d"), F.col(c).cast("double").alias("v")))
    return {f"_p_{c}": F.last(mark, ignorenulls=True).over(forward()), f"_n_{c}": F.last(mark, ignorenulls=True).over(backward())}


def _between(c: str) -> Column:
    """Linear value between the nearest filled days, or the nearest one at the ends."""
    prev, following = F.col(f"_p_{c}"), F.col(f"_n_{c}")
    share = F.try_divide(F.unix_date("date") - prev["d"], following["d"] - prev["d"])
    return F.coalesce(F.col(c).cast("double"), prev["v"] + (following["v"] - prev["v"]) * share, prev["v"], following["v"])


def interpolate(df: DataFrame, method: str = "linear", labels=LABELS) -> DataFrame:
    """Fill the spine: numbers on the line between neighbours, the nearest value at both ends.

    Label columns are snapped to 0 below 1e-10 and rounded half to even; other columns take the
    last, then the next value. On a daily spine ``linear`` and ``time`` give the same line. All
    columns share one ascending and one descending sort of the drive; the neighbours are computed
    once each and the lines drawn from them afterwards.
    """
    if method not in ("linear", "time"):
        raise ValueError(f"unknown interpolation method: {method}")
    marks, new, rounded = {}, {}, {}
    for field in df.schema:
        c = field.name
        if c in ("serial_number", "date"):
            continue
        if not _is_number(field):
            marks[f"_p_{c}"] = F.last(c, ignorenulls=True).over(forward())
            marks[f"_n_{c}"] = F.last(c, ignorenulls=True).over(backward())
            new[c] = F.coalesce(F.col(f"_p_{c}"), F.col(f"_n_{c}"))
            continue
        marks.update(_marks(c))
        new[c] = _between(c)
        if c in labels:
            rounded[c] = F.bround(snap_to_zero(F.col(c)), 0).cast(field.dataType)
    filled = daily_spine(df).withColumns(marks).withColumns(new)
    return (filled.withColumns(rounded) if rounded else filled).select(*df.columns)


def interpolation_report(df: DataFrame) -> DataFrame:
    """Cells filled with interpolated numbers, all cells after filling, and the percentage.

    Each missing day of a drive fills one cell for every numeric column the drive has at all.
    """
    numbers = [f.name for f in df.schema if f.name not in ("serial_number", "date") and _is_number(f)]
    width = len(df.columns) - 2
    span = F.datediff(F.max("date"), F.min("date")) + 1
    filled = sum((F.when(F.count(F.col(c)) > 0, span - F.count(F.col(c))).otherwise(0) for c in numbers), F.lit(0))
    per_drive = df.groupBy("serial_number").agg(filled.alias("f"), span.alias("d"))
    return per_drive.agg(
        F.sum("f").cast("long").alias("filled_cells"), F.sum(F.col("d") * width).cast("long").alias("cells"),
        (F.sum("f") / F.sum(F.col("d") * width) * 100.0).alias("filled_pct"),
    )


def fill_nulls(df: DataFrame, method: str, columns: list[str] | None = None) -> DataFrame:
    """Directional padding within a drive."""
    direction = {"ffill": forward(), "bfill": backward()}[method]
    names = columns or [c for c in df.columns if c not in ("serial_number", "date")]
    return df.withColumns({c: F.last(c, ignorenulls=True).over(direction) for c in names})


def failure_horizon_labels(df: DataFrame, days: int, window: int) -> DataFrame:
    """Drives with more than ``days`` + ``window`` rows; the last rows of failed drives become positive.

    ``predict_val`` marks the last ``days`` rows, ``validate_val`` the last ``days`` + ``window``.
    """
    marked = df.withColumns({"_size": F.count(F.lit(1)).over(drive()), "_rn": F.row_number().over(forward()),
                             "_failed": F.max("failure").over(drive())})
    marked = marked.filter(F.col("_size") > days + window).withColumns({
        "_from_end": F.col("_size") - F.col("_rn"), "_failed": F.col("_failed") == 1})
    return marked.withColumns({
        "predict_val": (F.col("_failed") & (F.col("_from_end") < days)).cast("int"),
        "validate_val": (F.col("_failed") & (F.col("_from_end") < days + window)).cast("int"),
    }).drop("_size", "_rn", "_from_end", "_failed")
