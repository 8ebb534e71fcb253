"""Queries over scans, sinks, filters, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.functions import names
from spindlescope.operators import selection as sel
from spindlescope.operators import statistics as st
from spindlescope.operators.history import filter_drives
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query
from spindlescope.sources import snapshots as snap
from spindlescope.sources import stages

ALL = "serial_number, date, model, capacity_bytes, failure, " + ", ".join(fx.SMART)


def _csv_days(spark: SparkSession, sf_dir: str) -> str:
    """Drive days written as daily snapshot files in the shared folder."""
    root = fx.shared_folder(spark, f"snapshots-{uuid.uuid4().hex}")
    snap.write_snapshots(fx.drive_day(spark, sf_dir), root)
    return f"{root}/*/*/*.csv"


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("serial_number", F.col("serial_number").cast("long"))


@query("read_snapshots", f"SELECT {ALL} FROM drive_day", dates=("date",))
def read_all(spark, sf_dir):
    return _typed(snap.read_snapshots(spark, _csv_days(spark, sf_dir)))


@query("read_snapshots_quarters", f"""SELECT {ALL} FROM (SELECT * FROM drive_day UNION ALL
  SELECT * REPLACE (CAST(date + INTERVAL 150 DAY AS DATE) AS date) FROM drive_day) WHERE year(date) = 2024 AND quarter(date) = 1""", dates=("date",))
def read_quarters(spark, sf_dir):
    """Every drive day twice, half a year apart; one half is asked for."""
    root = fx.shared_folder(spark, f"snapshots-{uuid.uuid4().hex}")
    days = fx.drive_day(spark, sf_dir)
    snap.write_snapshots(days.unionByName(days.withColumn("date", F.date_add("date", 150))), root)
    return _typed(snap.read_snapshots(spark, f"{root}/*/*/*.csv", years=["2024"], quarters=["Q1"]))


@query("read_snapshots_preset", """SELECT date, serial_number, model, failure, smart_5_normalized, smart_5_raw, smart_9_raw,
  smart_187_raw, smart_197_raw FROM drive_day""", dates=("date",))
def read_preset(spark, sf_dir):
    return _typed(snap.read_snapshots(spark, _csv_days(spark, sf_dir), columns="total_features"))


@query("read_snapshots_raw_columns", f"SELECT {ALL.replace(', smart_5_normalized', '')} FROM drive_day", dates=("date",))
def read_raw(spark, sf_dir):
    return _typed(snap.read_snapshots(spark, _csv_days(spark, sf_dir), columns="raw"))


@query("prune_days", f"SELECT {ALL} FROM supplier_day WHERE year(date) IN (1996, 1998) AND quarter(date) IN (1, 3)", ("supplier_day",), dates=("date",))
def prune_days(spark, sf_dir):
    return snap.prune_days(fx.supplier_day(spark, sf_dir), years=[1996, 1998], quarters=["Q1", "Q3"])


@query("union_snapshots", f"""SELECT serial_number, date, model, failure, smart_5_raw, NULL::DOUBLE AS smart_9_raw
  FROM drive_day WHERE day(date) % 2 = 0 UNION ALL
  SELECT serial_number, date, model, failure, NULL, smart_9_raw FROM drive_day WHERE day(date) % 2 = 1""", dates=("date",))
def union_snapshots(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    keys = ["serial_number", "date", "model", "failure"]
    even = days.filter(F.dayofmonth("date") % 2 == 0).select(*keys, "smart_5_raw")
    odd = days.filter(F.dayofmonth("date") % 2 == 1).select(*keys, "smart_9_raw")
    return snap.union_snapshots([even, odd])


@query("drop_nonstandard_smart", f"SELECT {ALL} FROM drive_day", dates=("date",))
def drop_nonstandard(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    wide = days.withColumns({"smart_22_raw": F.col("smart_5_raw"), "smart_220_normalized": F.col("smart_9_raw")})
    return snap.drop_nonstandard_smart(wide)


@query("serial_list", """SELECT DISTINCT serial_number FROM drive_day
  WHERE model IN ('ST4000DM000', 'ST3000DM001', 'WDC WD30EFRX') AND failure = 1""")
def serial_list(spark, sf_dir):
    path = fx.shared_folder(spark, f"serials-{uuid.uuid4().hex}")
    days = fx.drive_day(spark, sf_dir)
    stages.write_serial_list(stages.serial_list(days, "ST4000DM000, ST3000DM001, WDC WD30EFRX", failed_only=True), path)
    return spark.read.parquet(path)


@query("materialize", "SELECT model, COUNT(*) AS days, ROUND(SUM(smart_9_raw), 2) AS smart_9_sum FROM drive_day GROUP BY 1")
def materialize(spark, sf_dir):
    root = fx.shared_folder(spark, f"cache-{uuid.uuid4().hex}")
    build = lambda: fx.drive_day(spark, sf_dir)
    stages.materialize(spark, root, "imported", "v1", build)
    again = stages.materialize(spark, root, "imported", "v1", build)
    return again.groupBy("model").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("smart_9_raw"), 2).alias("smart_9_sum"))


@query("sort_drive_days", """SELECT serial_number, date, smart_9_raw,
  LAG(date) OVER (PARTITION BY serial_number ORDER BY date) AS previous_day FROM drive_day""", dates=("date", "previous_day"))
def sort_drive_days(spark, sf_dir):
    ordered = snap.sort_drive_days(fx.drive_day(spark, sf_dir))
    from spindlescope.operators.history import forward
    return ordered.select("serial_number", "date", "smart_9_raw", F.lag("date").over(forward()).alias("previous_day"))


@query("filter_models", f"SELECT {ALL} FROM drive_day WHERE model IN ('ST4000DM000', 'WDC WD30EFRX')", dates=("date",))
def filter_models(spark, sf_dir):
    return sel.filter_models(fx.drive_day(spark, sf_dir), " ST4000DM000 ,WDC WD30EFRX")


@query("filter_manufacturer", f"SELECT {ALL} FROM drive_day WHERE model LIKE 'ST%'", dates=("date",))
def filter_manufacturer(spark, sf_dir):
    return sel.filter_manufacturer(fx.drive_day(spark, sf_dir), "ST")


@query("failed_only", f"SELECT {ALL} FROM drive_day WHERE failure = 1", dates=("date",))
def failed_only(spark, sf_dir):
    return sel.failed_only(fx.drive_day(spark, sf_dir))


@query("split_by_failure", "SELECT failure, COUNT(*) AS records FROM drive_day GROUP BY 1")
def split_by_failure(spark, sf_dir):
    bad, good = sel.split_by_failure(fx.drive_day(spark, sf_dir))
    return bad.union(good).groupBy("failure").agg(F.count(F.lit(1)).alias("records"))


@query("valid_failure_flag", f"""SELECT {ALL.replace(' failure,', ' CAST(smart_5_raw AS INT) AS failure,')} FROM drive_day
  WHERE CAST(smart_5_raw AS INT) IN (0, 1)""", dates=("date",))
def valid_failure_flag(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).withColumn("failure", F.col("smart_5_raw").cast("int"))
    return sel.valid_failure_flag(days)


@query("cast_failure", f"SELECT {ALL} FROM drive_day", dates=("date",))
def cast_failure(spark, sf_dir):
    return sel.cast_failure(fx.drive_day(spark, sf_dir).withColumn("failure", F.col("failure").cast("double")))


@query("drop_sparse_columns", f"SELECT {ALL.replace(' smart_188_raw,', '')} FROM drive_day", dates=("date",))
def drop_sparse_columns(spark, sf_dir):
    return sel.drop_sparse_columns(fx.drive_day(spark, sf_dir))


_COUNTS = "SELECT COUNT(*) AS n, " + ", ".join(f"COUNT({c.strip()}) AS c{i}" for i, c in enumerate(ALL.split(","))) + " FROM drive_day"
_KEPT = " + ".join(f"CASE WHEN c{i} >= n * (1.0 - t) THEN 1 ELSE 0 END" for i in range(len(ALL.split(","))))


@query("column_retention", f"""SELECT CAST(t AS DOUBLE) AS max_null, CAST({_KEPT} AS BIGINT) AS kept,
  CAST(11 - ({_KEPT}) AS BIGINT) AS dropped, ROUND((11 - ({_KEPT})) / 11.0, 6) AS drop_ratio
  FROM ({_COUNTS}), (VALUES (0.5::DOUBLE), (0.25), (0.1), (0.01)) v(t)""")
def column_retention(spark, sf_dir):
    return sel.column_retention(fx.drive_day(spark, sf_dir)).withColumn("drop_ratio", F.round("drop_ratio", 6))


@query("retain_columns", f"SELECT {ALL.replace(' smart_188_raw,', '')} FROM drive_day", dates=("date",))
def retain_columns(spark, sf_dir):
    return sel.retain_columns(fx.drive_day(spark, sf_dir), 0.01)


@query("drop_null_rows", f"SELECT {ALL} FROM drive_day WHERE smart_188_raw IS NOT NULL", dates=("date",))
def drop_null_rows(spark, sf_dir):
    return sel.drop_null_rows(fx.drive_day(spark, sf_dir))


@query("null_row_report", """SELECT COUNT(*) AS rows_before, COUNT(smart_188_raw) AS rows_after,
  ROUND((COUNT(*) - COUNT(smart_188_raw)) / COUNT(*) * 100.0, 6) AS dropped_pct FROM drive_day""")
def null_row_report(spark, sf_dir):
    return sel.null_row_report(fx.drive_day(spark, sf_dir)).withColumn("dropped_pct", F.round("dropped_pct", 6))


@query("drop_null_columns", f"SELECT {ALL.replace(' smart_188_raw,', '')} FROM drive_day", dates=("date",))
def drop_null_columns(spark, sf_dir):
    return sel.drop_null_columns(fx.drive_day(spark, sf_dir))


@query("drop_normalized", f"SELECT {ALL.replace(', smart_5_normalized', '')} FROM drive_day", dates=("date",))
def drop_normalized(spark, sf_dir):
    return sel.drop_normalized(fx.drive_day(spark, sf_dir))


VENDOR_SQL = """CASE WHEN model LIKE 'S%' THEN 'Seagate' WHEN model LIKE 'HG%' THEN 'HGST' WHEN model LIKE 'T%' THEN 'Toshiba'
  WHEN model LIKE 'W%' THEN 'WDC' WHEN model LIKE 'Hi%' THEN 'Hitachi' ELSE 'Unknown' END"""


@query("assign_vendor", f"SELECT {ALL}, {VENDOR_SQL} AS vendor FROM drive_day", dates=("date",))
def assign_vendor(spark, sf_dir):
    return sel.assign_vendor(fx.drive_day(spark, sf_dir))


@query("select_attributes", """SELECT serial_number, date, model, capacity_bytes, failure, smart_5_raw, smart_197_raw
  FROM drive_day""", dates=("date",))
def select_attributes(spark, sf_dir):
    return sel.select_attributes(fx.drive_day(spark, sf_dir), ["smart_5_raw", "smart_197_raw", "smart_254_raw"])


@query("apply_feature_weights", """SELECT serial_number, date, ROUND(smart_5_raw * 0.25, 6) AS smart_5_raw,
  ROUND(smart_9_raw * 1.75, 6) AS smart_9_raw FROM drive_day""", dates=("date",))
def apply_feature_weights(spark, sf_dir):
    out = sel.apply_feature_weights(fx.drive_day(spark, sf_dir), {"smart_5_raw": 0.25, "smart_9_raw": 1.75})
    return out.select("serial_number", "date", F.round("smart_5_raw", 6).alias("smart_5_raw"),
                      F.round("smart_9_raw", 6).alias("smart_9_raw"))


@query("drop_all_null_drives", f"""SELECT {ALL} FROM drive_day WHERE serial_number % 5 != 0 AND serial_number IN (
  SELECT serial_number FROM drive_day GROUP BY 1 HAVING COUNT(smart_188_raw) > 0 AND COUNT(smart_9_raw) > 0)""", dates=("date",))
def drop_all_null_drives(spark, sf_dir):
    """A fifth of the drives never reports one of the two columns."""
    days = fx.drive_day(spark, sf_dir)
    silent = days.withColumn("smart_188_raw", F.when(F.col("serial_number") % 5 != 0, F.col("smart_188_raw")))
    return sel.drop_all_null_drives(silent, ["smart_188_raw", "smart_9_raw"])


_HOLES = "CASE WHEN smart_5_raw = 1 THEN NULL ELSE capacity_bytes END"


def _with_holes(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    return days.withColumn("capacity_bytes", F.when(F.col("smart_5_raw") != 1, F.col("capacity_bytes")))


@query("require_keys", f"SELECT {ALL} FROM drive_day WHERE {_HOLES} IS NOT NULL", dates=("date",))
def require_keys(spark, sf_dir):
    return sel.require_keys(_with_holes(spark, sf_dir))


@query("require_keys_report", f"""SELECT COUNT(*) AS rows_before, COUNT({_HOLES}) AS rows_after,
  COUNT(*) - COUNT({_HOLES}) AS rows_dropped FROM drive_day""")
def require_keys_report(spark, sf_dir):
    return sel.require_keys_report(_with_holes(spark, sf_dir))


@query("keep_serials", f"""SELECT {ALL} FROM drive_day WHERE serial_number IN (
  SELECT serial_number FROM drive_day WHERE failure = 1)""", dates=("date",))
def keep_serials(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    return sel.keep_serials(days, stages.serial_list(days, failed_only=True))


@query("drop_serials", f"""SELECT {ALL} FROM drive_day WHERE serial_number NOT IN (
  SELECT serial_number FROM drive_day WHERE failure = 1)""", dates=("date",))
def drop_serials(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    return sel.drop_serials(days, stages.serial_list(days, failed_only=True))


@query("zip_by_key", """SELECT a.serial_number, a.date, a.smart_9_raw, b.smart_187_raw AS other_smart_187_raw
  FROM drive_day a JOIN supplier_day b ON a.serial_number = b.serial_number AND a.date = b.date + INTERVAL 8766 DAY""",
       ("drive_day", "supplier_day"), dates=("date",))
def zip_by_key(spark, sf_dir):
    a = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_9_raw")
    b = fx.supplier_day(spark, sf_dir).select("serial_number", F.date_add("date", 8766).alias("date"),
                                              F.col("smart_187_raw").alias("other_smart_187_raw"))
    return sel.zip_by_key(a, b)


@query("flag_ever_failed", """SELECT serial_number, COUNT(*) AS days, MAX(failure) = 1 AS ever_failed FROM drive_day GROUP BY 1""")
def flag_ever_failed(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    stats = days.groupBy("serial_number").agg(F.count(F.lit(1)).alias("days"))
    return sel.flag_ever_failed(stats, sel.failed_only(days))


@query("model_pairs", """, m AS (SELECT model, 'smart_9_raw' AS feature, COUNT(*) AS n FROM drive_day GROUP BY 1)
  SELECT a.feature, a.model AS model_a, b.model AS model_b, a.n AS n_a, b.n AS n_b FROM m a JOIN m b ON a.model <> b.model""")
def model_pairs(spark, sf_dir):
    moments = st.model_moments(fx.drive_day(spark, sf_dir), ["smart_9_raw"]).select("feature", "model", "n")
    return st.model_pairs(moments)


@query("union_windows", f"SELECT {ALL} FROM drive_day UNION ALL SELECT {ALL} FROM supplier_day", ("drive_day", "supplier_day"), dates=("date",))
def union_windows(spark, sf_dir):
    return snap.union_snapshots([fx.drive_day(spark, sf_dir), fx.supplier_day(spark, sf_dir)])


@query("drive_set_difference", """SELECT DISTINCT serial_number FROM drive_day WHERE serial_number NOT IN (
  SELECT serial_number FROM drive_day WHERE failure = 1)""")
def drive_set_difference(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    return sel.drop_serials(stages.serial_list(days), stages.serial_list(days, failed_only=True))


@query("bad_drive_union", """SELECT serial_number FROM short_drives UNION SELECT serial_number FROM gappy_drives""",
       ("short_drives", "gappy_drives"))
def bad_drive_union(spark, sf_dir):
    _, gappy, short = filter_drives(fx.drive_day(spark, sf_dir), fx.MIN_DAYS, fx.GAP_WINDOW, 2, fx.MAX_MISSING)
    return gappy.union(short).distinct()


@query("string_functions", """SELECT DISTINCT model, starts_with(model, 'ST') AS is_st, contains(model, 'DM') AS has_dm,
  trim(split_part(model, ' ', 1)) AS first_word, replace('smart_9_raw', 'raw', 'normalized') AS twin,
  regexp_matches('date_3', '^date_[0-9]+$') AS is_copy, CAST(regexp_extract('smart_187_raw', '([0-9]+)', 1) AS INT) AS smart_id
  FROM drive_day""")
def string_functions(spark, sf_dir):
    m = F.col("model")
    return fx.drive_day(spark, sf_dir).select(
        "model", m.startswith("ST").alias("is_st"), m.contains("DM").alias("has_dm"),
        F.trim(F.split(m, " ")[0]).alias("first_word"), F.lit(names.normalized_twin("smart_9_raw")).alias("twin"),
        names.is_suffixed_copy(F.lit("date_3"), "date").alias("is_copy"),
        F.lit(names.smart_id("smart_187_raw")).alias("smart_id")).distinct()


@query("date_functions", """SELECT serial_number, date, CAST(quarter(date) AS INT) AS quarter, date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_span,
  date AS file_day FROM drive_day""", dates=("date", "file_day"))
def date_functions(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    path = F.concat(F.lit("/snapshots/"), F.year("date").cast("string"), F.lit("/"), F.col("date").cast("string"), F.lit(".csv"))
    return days.select("serial_number", "date", F.quarter("date").alias("quarter"),
                       F.col("date").between("2024-01-05", "2024-01-20").alias("in_span"),
                       names.day_from_path(path).alias("file_day"))


@query("math_functions", """SELECT serial_number, date, ABS(smart_197_raw - 5) AS distance,
  CAST(ROUND_EVEN(smart_9_raw / 2, 0) AS DOUBLE) AS half_even, ROUND(SQRT(smart_9_raw), 6) AS root,
  ROUND(POW(smart_187_raw, 2), 6) AS square,
  ROUND((smart_9_raw + 1e-10) * LN((smart_9_raw + 1e-10) / (smart_187_raw + 1e-10)), 5) AS log_ratio,
  CAST(GREATEST(0, LEAST(FLOOR(smart_5_normalized / 10), 9)) AS BIGINT) AS bin FROM drive_day""", dates=("date",))
def math_functions(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    return days.select(
        "serial_number", "date", F.abs(F.col("smart_197_raw") - 5).alias("distance"),
        F.bround(F.col("smart_9_raw") / 2, 0).alias("half_even"), F.round(F.sqrt("smart_9_raw"), 6).alias("root"),
        F.round(F.pow("smart_187_raw", F.lit(2)), 6).alias("square"),
        F.round(names.log_ratio(F.col("smart_9_raw"), F.col("smart_187_raw")), 5).alias("log_ratio"),
        names.bin_of(F.col("smart_5_normalized"), 0.0, 100.0, 10).alias("bin"))


@query("array_functions", """SELECT serial_number, CAST(len(l) AS BIGINT) AS days, CAST(30 AS BIGINT) AS padded_days, l[1] AS first_value,
  CASE WHEN len(l) < 30 THEN 2.0 ELSE l[30] END AS last_padded FROM (
    SELECT serial_number, LIST(smart_9_raw ORDER BY date) AS l FROM drive_day GROUP BY 1)""")
def array_functions(spark, sf_dir):
    lists = fx.drive_day(spark, sf_dir).groupBy("serial_number").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "smart_9_raw"))), lambda s: s["smart_9_raw"]).alias("l"))
    padded = names.pad_to(F.col("l"), 30, 2.0)
    return lists.select("serial_number", F.size("l").cast("long").alias("days"), F.size(padded).cast("long").alias("padded_days"),
                        F.element_at("l", 1).alias("first_value"), F.element_at(padded, 30).alias("last_padded"))
