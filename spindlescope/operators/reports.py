"""Counts, shares, null reports, distributions, correlations and top-k reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindlescope.config import CRITICAL_COLUMNS, smart_columns
from spindlescope.functions.names import bin_of, vendor_of
from spindlescope.ml.passes import keyed_frame
from spindlescope.operators.history import forward
from spindlescope.operators.ordering import exact_quantiles, long_form, pick_by_hash, row_hash
from spindlescope.session import cut_lineage



def _count_if(condition):
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs as an aggregate; NULL for a constant side."""
    whole = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(whole, a)) * F.stddev_pop(F.when(whole, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def drive_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("serial_number").agg(F.count(F.lit(1)).alias("days"))


def failure_summary(df: DataFrame) -> DataFrame:
    """Failure rows, remaining drives and the failed percentage, from one row per drive."""
    per_drive = df.groupBy("serial_number").agg(F.sum("failure").alias("f"))
    failed = F.sum("f")
    total = F.count(F.lit(1))
    return per_drive.agg(failed.cast("long").alias("failed"), (total - failed).cast("long").alias("healthy"),
                         (failed / total * 100.0).alias("failed_pct"))


def completeness_report(df: DataFrame, digits: int = 2) -> DataFrame:
    """Percentage of filled rows per column, one scan."""
    rows = F.count(F.lit(1))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.round(F.count(F.col(c)) / rows * 100.0, digits).alias("filled_pct")) for c in df.columns
    ])
    return df.agg(pairs.alias("r")).select(F.inline("r"))


def null_report(df: DataFrame, columns=CRITICAL_COLUMNS, by: str | None = None) -> DataFrame:
    """Null count and percentage per present column, overall or per value of ``by``."""
    present = [c for c in columns if c in df.columns]
    rows = F.count(F.lit(1))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), (rows - F.count(F.col(c))).alias("nulls"),
                 ((rows - F.count(F.col(c))) / rows * 100.0).alias("null_pct")) for c in present
    ])
    keys = [by] if by else []
    return df.groupBy(*keys).agg(pairs.alias("r")).select(*keys, F.inline("r"))


def _failure_counts(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(_count_if(F.col("failure") == 1).alias("failures"),
                                 _count_if(F.col("failure") == 0).alias("non_failures"),
                                 F.count(F.lit(1)).alias("total"))
    everything = Window.partitionBy()
    return counts.withColumn("total_pct", F.col("total") / F.sum("total").over(everything) * 100.0).withColumn(
        "fail_pct", F.col("failures") / F.col("total") * 100.0)


def model_report(df: DataFrame) -> DataFrame:
    """Per model: failures, non-failures, all rows, share and fail percentage; models with failures only.

    The window for shares sees one row per model, after the aggregation.
    """
    report = _failure_counts(df, "model").filter("failures > 0").withColumn("vendor", vendor_of(F.col("model")))
    return order_models(report)


def order_models(report: DataFrame) -> DataFrame:
    return report.orderBy(F.col("failures").desc(), "model")


def vendor_share(df: DataFrame) -> DataFrame:
    counts = df.groupBy(vendor_of(F.col("model")).alias("vendor")).agg(F.count(F.lit(1)).alias("records"))
    return counts.withColumn("pct", F.col("records") / F.sum("records").over(Window.partitionBy()) * 100.0)


def vendor_report(df: DataFrame) -> DataFrame:
    return _failure_counts(df.withColumn("vendor", vendor_of(F.col("model"))), "vendor")


def describe_by_failure(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per failure class and column."""
    moments = cut_lineage(long_form(df, ["failure"], cols).groupBy("failure", "feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")))
    sizes = moments.select("failure", "feature", F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))
    quartiles = exact_quantiles(df, ["failure"], cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, sizes)
    return moments.join(quartiles, ["failure", "feature"]).select(
        "failure", "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def drive_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per drive mean and sample deviation of each feature and the ever-failed flag; complete drives only."""
    cols = cols or smart_columns(df)
    means = [F.avg(c).alias(f"mean_{c}") for c in cols]
    spreads = [F.stddev_samp(c).alias(f"std_{c}") for c in cols]
    return df.groupBy("serial_number").agg(*means, *spreads, (F.max("failure") == 1).alias("ever_failed")).na.drop()


def model_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("records")).orderBy(F.col("records").desc(), "model")


def distinct_models(df: DataFrame) -> DataFrame:
    return df.select("model").distinct()


def class_counts(df: DataFrame, label: str = "predict_val") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("records"))


def max_series_length(df: DataFrame) -> DataFrame:
    return drive_lengths(df).agg(F.max("days").alias("longest"))


def series_class_counts(df: DataFrame) -> DataFrame:
    """Good and failed drives; a drive failed if any of its rows did."""
    per_drive = df.groupBy("serial_number").agg(F.max("failure").alias("failed"))
    return per_drive.groupBy("failed").agg(F.count(F.lit(1)).alias("drives"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen in hash order of ``keys``."""
    return pick_by_hash(df, [], keys, seed, lambda rows: F.least(rows, F.lit(n))).filter("picked").drop("picked")


def histogram(df: DataFrame, col: str, bins: int, rows: int | None = None, keys=("serial_number", "date"),
              seed: int = 42) -> DataFrame:
    """Equal-width histogram of all rows: (bin, low, high, records) and the null count.

    A column without values gives one row without a bin. ``rows`` asks for a sample of so many rows instead.
    """
    if rows is not None:
        df = sample_rows(df, rows, list(keys), seed)
    low, high, nulls = df.agg(F.min(col), F.max(col), F.count_if(F.col(col).isNull())).first()
    schema = "bin long, low double, high double, records long, null_records long"
    if low is None:
        return df.sparkSession.createDataFrame([(None, None, None, 0, nulls)], schema)
    width = (high - low) / bins
    counted = df.filter(F.col(col).isNotNull()).groupBy(bin_of(F.col(col), low, high, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("records"))
    return counted.select("bin", (F.lit(float(low)) + F.col("bin") * width).alias("low"),
                          (F.lit(float(low)) + (F.col("bin") + 1) * width).alias("high"), "records",
                          F.lit(nulls).cast("long").alias("null_records"))


def sample_drives(df: DataFrame, failed: int = 500, healthy: int = 75_000, seed: int = 42) -> DataFrame:
    """Serials of at most ``failed`` failed and ``healthy`` healthy drives, in hash order."""
    drives = df.groupBy("serial_number").agg(F.max("failure").alias("failed"))
    quota = df.sparkSession.createDataFrame([(1, failed), (0, healthy)], "failed int, quota long")
    return pick_by_hash(drives, ["failed"], ["serial_number"], seed, quota).filter("picked").select("serial_number")


def correlation_matrix(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Pairwise Pearson correlation in long form (feature_a < feature_b by position, complete pairs only).

    One scan for any number of columns: a task adds up four matrices per group, of products, of values and squares where the other column
    is present, and of counts. NaN counts as missing. ``by`` is a column with few values, which are read first. A pair is null if
    either side does not vary on the complete rows.
    """
    d = len(cols)
    names = [r[0] for r in df.select(by).distinct().collect()] if by else [None]
    group = F.array_position(F.array(*[F.lit(n) for n in names if n is not None] or [F.lit("")]), F.col(by)) - 1 if by else F.lit(0)
    order = [n for n in names if n is not None]
    values = [F.col(c).cast("double") for c in cols]
    start = df.select(*[F.first(v, ignorenulls=True).alias(f"c{i}") for i, v in enumerate(values)]).first() if d else []
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in start], float)
    rows = df.select(F.array(*values).alias("x"), F.coalesce(group, F.lit(len(order))).cast("double").alias("g"))
    upper = np.triu_indices(d, 1)

    def sums(x, rest):
        out = {}
        for g in np.unique(rest["g"]):
            z = x[rest["g"] == g] - shift
            there = ~np.isnan(z)
            z, m = np.where(there, z, 0.0), there.astype(float)
            out[int(g)] = np.stack([z.T @ z, z.T @ m, (z * z).T @ m, m.T @ m]).ravel()
        return out

    def finish(g, flat):
        product, value, square, n = flat.reshape(4, d, d)
        n = np.maximum(n, 1.0)
        spread = square - value * value / n
        spread = np.where(spread <= 1e-12 * square, 0.0, spread)
        both = np.sqrt(spread * spread.T)
        r = np.where(both > 0, (product - value * value.T / n) / np.where(both > 0, both, 1.0), np.nan)
        return int(g), [None if np.isnan(v) else float(min(1.0, max(-1.0, v))) for v in r[upper]]
    found = keyed_frame(rows, sums, np.add, finish, "g long, r array<double>")
    first, second = (F.array(*[F.lit(cols[i]) for i in side]) for side in upper)
    long = found.select("g", F.posexplode("r").alias("pos", "r"))
    pairs = [F.get(first, F.col("pos")).alias("feature_a"), F.get(second, F.col("pos")).alias("feature_b"), "r"]
    if not by:
        return long.select(*pairs)
    kind = df.schema[by].dataType
    called = F.get(F.array(*[F.lit(n).cast(kind) for n in order] or [F.lit(None).cast(kind)]), F.col("g").cast("int"))
    return long.select(called.alias(by), *pairs)


def correlation_by_vendor(df: DataFrame, cols: list[str], max_null: float = 0.01) -> DataFrame:
    """Per vendor, only columns with fewer than ``max_null`` nulls in that vendor."""
    named = df.withColumn("vendor", vendor_of(F.col("model")))
    dense = null_report(named, cols, "vendor").filter(F.col("null_pct") < max_null * 100.0)
    out = correlation_matrix(named, cols, "vendor")
    for side in ("feature_a", "feature_b"):
        out = out.join(dense.select("vendor", F.col("column").alias(side)), ["vendor", side], "left_semi")
    return out.select("vendor", "feature_a", "feature_b", "r")


def top_models(report: DataFrame, by: str, k: int = 10) -> DataFrame:
    return report.orderBy(F.col(by).desc(), "model").limit(k)


def top_features(pvals: DataFrame, k: int = 18) -> DataFrame:
    """The k smallest defined p-values in ascending order."""
    return pvals.filter(F.col("p_value").isNotNull() & ~F.isnan("p_value")).orderBy("p_value", "feature").limit(k)


def drive_trajectories(df: DataFrame, columns: list[str], n: int = 50, seed: int | None = 42) -> DataFrame:
    """Day index against each feature for ``n`` failed drives, in long form.

    ``seed=None`` takes the drives in key order instead of hash order.
    """
    failed = df.filter("failure = 1").select("serial_number").distinct()
    order = [F.col("serial_number")] if seed is None else [row_hash(["serial_number"], seed), F.col("serial_number")]
    chosen = failed.orderBy(*order).limit(n)
    days = df.join(chosen, "serial_number", "left_semi").withColumn("day_index", F.row_number().over(forward()).cast("long") - 1)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(T.DoubleType()).alias("value")) for c in columns])
    return days.select("serial_number", "day_index", F.inline(pairs))
