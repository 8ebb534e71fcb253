"""Projections, filters, null handling and key-based joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.config import CORE
from spindlescope.functions.names import split_list, vendor_of


def filter_models(df: DataFrame, models: str) -> DataFrame:
    """Rows of the models in a comma list."""
    return df.filter(F.col("model").isin(split_list(models)))


def filter_manufacturer(df: DataFrame, prefix: str, models: str = "") -> DataFrame:
    """Rows whose model starts with ``prefix``; ``custom`` falls back to the model list."""
    if prefix == "custom":
        return filter_models(df, models)
    return df.filter(F.col("model").startswith(prefix))


def failed_only(df: DataFrame) -> DataFrame:
    return df.filter("failure = 1")


def split_by_failure(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("failure = 1"), df.filter("failure = 0")


def valid_failure_flag(df: DataFrame) -> DataFrame:
    return df.filter(F.col("failure").isin(0, 1))


def cast_failure(df: DataFrame) -> DataFrame:
    return df.withColumn("failure", F.col("failure").cast("int"))


def _filled(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and non-null count per column, in one pass with map-side partial sums."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def drop_sparse_columns(df: DataFrame, min_pct: float = 45.0) -> DataFrame:
    """Drop columns whose non-null share is below ``min_pct`` percent."""
    rows, filled = _filled(df)
    return df.drop(*[c for c, n in filled.items() if rows and 100.0 * n / rows < min_pct])


def columns_within(df: DataFrame, max_null: float) -> list[str]:
    """Columns with at least (1 - ``max_null``) of their rows filled."""
    rows, filled = _filled(df)
    return [c for c, n in filled.items() if n >= rows * (1.0 - max_null)]


def column_retention(df: DataFrame, thresholds=(0.5, 0.25, 0.1, 0.01)) -> DataFrame:
    """Per null threshold: columns kept, columns dropped and the drop ratio."""
    width = len(df.columns)
    needs = [F.count(F.col(c)) for c in df.columns]
    kept = [
        sum((F.when(n >= F.count(F.lit(1)) * (1.0 - t), 1).otherwise(0) for n in needs), F.lit(0))
        for t in thresholds
    ]
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("max_null"), k.cast("long").alias("kept")) for t, k in zip(thresholds, kept)
    ])
    return (
        df.agg(rows.alias("r")).select(F.inline("r"))
        .withColumn("dropped", (F.lit(width) - F.col("kept")).cast("long"))
        .withColumn("drop_ratio", F.col("dropped") / F.lit(float(width)))
    )


def retain_columns(df: DataFrame, max_null: float) -> DataFrame:
    return df.select(*columns_within(df, max_null))


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop()


def null_row_report(df: DataFrame) -> DataFrame:
    """Rows before and after the complete-case filter and the dropped percentage."""
    complete = F.sum(F.when(_all_present(df.columns), 1).otherwise(0))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("rows_before"),
        complete.cast("long").alias("rows_after"),
        ((total - complete) / total * 100.0).alias("dropped_pct"),
    )


def _all_present(columns):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def drop_null_columns(df: DataFrame) -> DataFrame:
    rows, filled = _filled(df)
    return df.drop(*[c for c, n in filled.items() if n < rows])


def drop_normalized(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "normalized" in c])


def assign_vendor(df: DataFrame) -> DataFrame:
    return df.withColumn("vendor", vendor_of(F.col("model")))


def select_attributes(df: DataFrame, smart_list: list[str], keys=CORE) -> DataFrame:
    """The listed SMART columns and the key columns that are present."""
    wanted = [c for c in keys if c in df.columns] + [c for c in smart_list if c in df.columns]
    return df.select(*dict.fromkeys(wanted))


def apply_feature_weights(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    hits = {c: F.col(c) * F.lit(float(w)) for c, w in weights.items() if c in df.columns}
    return df.withColumns(hits) if hits else df


def drop_all_null_drives(df: DataFrame, features: list[str]) -> DataFrame:
    """Remove drives for which some feature is never filled.

    Counts are partial before the shuffle, so no drive's rows have to meet to be judged.
    """
    counts = df.groupBy("serial_number").agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(features)])
    whole = counts.filter(" AND ".join(f"n{i} > 0" for i in range(len(features))))
    return df.join(whole.select("serial_number"), "serial_number", "left_semi")


def require_keys(df: DataFrame, cols=("date", "serial_number", "capacity_bytes")) -> DataFrame:
    return df.na.drop(subset=list(cols))


def require_keys_report(df: DataFrame, cols=("date", "serial_number", "capacity_bytes")) -> DataFrame:
    kept = F.sum(F.when(_all_present(cols), 1).otherwise(0))
    return df.agg(F.count(F.lit(1)).alias("rows_before"), kept.cast("long").alias("rows_after"),
                  (F.count(F.lit(1)) - kept).cast("long").alias("rows_dropped"))


def keep_serials(df: DataFrame, serials: DataFrame) -> DataFrame:
    """Rows whose serial is listed. The planner picks a broadcast only from measured sizes."""
    return df.join(serials.select("serial_number"), "serial_number", "left_semi")


def drop_serials(df: DataFrame, bad: DataFrame) -> DataFrame:
    return df.join(bad.select("serial_number"), "serial_number", "left_anti")


def zip_by_key(a: DataFrame, b: DataFrame, keys=("serial_number", "date")) -> DataFrame:
    """Two frames side by side on the same key."""
    return a.join(b, list(keys), "inner")


def flag_ever_failed(stats: DataFrame, failures: DataFrame) -> DataFrame:
    """Boolean: the drive appears among the failure rows."""
    failed = failures.select("serial_number").distinct().withColumn("ever_failed", F.lit(True))
    return stats.join(failed, "serial_number", "left").na.fill(False, subset=["ever_failed"])
