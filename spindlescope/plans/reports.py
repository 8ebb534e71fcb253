"""Queries over counts, shares, null reports, distributions and top-k reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from spindlescope.operators import reports as rp
from spindlescope.operators.windows import grouped_lists
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query
from spindlescope.plans.sources_and_filters import VENDOR_SQL


def rounded(df, digits=6):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"})


@query("drive_lengths", "SELECT serial_number, COUNT(*) AS days FROM drive_day GROUP BY 1")
def drive_lengths(spark, sf_dir):
    return rp.drive_lengths(fx.drive_day(spark, sf_dir))


@query("failure_summary", """SELECT CAST(SUM(failure) AS BIGINT) AS failed,
  CAST(COUNT(DISTINCT serial_number) - SUM(failure) AS BIGINT) AS healthy,
  ROUND(SUM(failure) / COUNT(DISTINCT serial_number) * 100.0, 6) AS failed_pct FROM drive_day""")
def failure_summary(spark, sf_dir):
    return rounded(rp.failure_summary(fx.drive_day(spark, sf_dir)))


_COLUMNS = ["serial_number", "date", "model", "capacity_bytes", "failure", *fx.SMART]


@query("completeness_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ROUND(COUNT({c}) / COUNT(*) * 100.0, 2) AS filled_pct FROM drive_day" for c in _COLUMNS))
def completeness_report(spark, sf_dir):
    return rp.completeness_report(fx.drive_day(spark, sf_dir))


_CRITICAL = ["smart_5_raw", "smart_187_raw", "smart_188_raw", "smart_197_raw"]


@query("null_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls, ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100.0, 6) AS null_pct FROM drive_day"
    for c in _CRITICAL))
def null_report(spark, sf_dir):
    return rounded(rp.null_report(fx.drive_day(spark, sf_dir)))


@query("null_report_by_vendor", " UNION ALL ".join(
    f"""SELECT {VENDOR_SQL} AS vendor, '{c}' AS "column", COUNT(*) - COUNT({c}) AS nulls,
    ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100.0, 6) AS null_pct FROM drive_day GROUP BY 1""" for c in _CRITICAL))
def null_report_by_vendor(spark, sf_dir):
    from spindlescope.operators.selection import assign_vendor
    return rounded(rp.null_report(assign_vendor(fx.drive_day(spark, sf_dir)), by="vendor"))


_MODEL_REPORT = """SELECT model, CAST(SUM(failure) AS BIGINT) AS failures, COUNT(*) - CAST(SUM(failure) AS BIGINT) AS non_failures,
  COUNT(*) AS total, ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 100.0, 6) AS total_pct,
  ROUND(SUM(failure) / COUNT(*) * 100.0, 6) AS fail_pct FROM drive_day GROUP BY 1"""


@query("model_report", f"SELECT *, {VENDOR_SQL} AS vendor FROM ({_MODEL_REPORT}) WHERE failures > 0")
def model_report(spark, sf_dir):
    return rounded(rp.model_report(fx.drive_day(spark, sf_dir)))


@query("vendor_share", f"""SELECT {VENDOR_SQL} AS vendor, COUNT(*) AS records,
  ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 100.0, 6) AS pct FROM drive_day GROUP BY 1""")
def vendor_share(spark, sf_dir):
    return rounded(rp.vendor_share(fx.drive_day(spark, sf_dir)))


@query("vendor_report", _MODEL_REPORT.replace("SELECT model", f"SELECT {VENDOR_SQL} AS vendor"))
def vendor_report(spark, sf_dir):
    return rounded(rp.vendor_report(fx.drive_day(spark, sf_dir)))


@query("describe_by_failure", " UNION ALL ".join(
    f"""SELECT failure, '{c}' AS feature, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
    ROUND(MIN({c}), 6) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS q50,
    ROUND(QUANTILE_CONT({c}, 0.75), 6) AS q75, ROUND(MAX({c}), 6) AS max FROM drive_day GROUP BY 1""" for c in fx.RAW))
def describe_by_failure(spark, sf_dir):
    return rounded(rp.describe_by_failure(fx.drive_day(spark, sf_dir), fx.RAW))


@query("grouped_lists", """SELECT serial_number, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS position,
  date, failure, smart_9_raw, smart_188_raw FROM drive_day""", dates=("date",))
def grouped(spark, sf_dir):
    lists = grouped_lists(fx.drive_day(spark, sf_dir))
    rows = lists.select("serial_number", F.posexplode(F.arrays_zip("date", "failure", "smart_9_raw", "smart_188_raw")))
    return rows.select("serial_number", F.col("pos").cast("long").alias("position"), "col.*")


@query("drive_stats", "SELECT * FROM (SELECT serial_number, " + ", ".join(
    f"ROUND(AVG({c}), 6) AS mean_{c}, ROUND(STDDEV_SAMP({c}), 6) AS std_{c}" for c in fx.SMART) +
    ", MAX(failure) = 1 AS ever_failed FROM drive_day GROUP BY 1) WHERE " +
    " AND ".join(f"std_{c} IS NOT NULL" for c in fx.SMART))
def drive_stats(spark, sf_dir):
    return rounded(rp.drive_stats(fx.drive_day(spark, sf_dir)))


@query("model_frequency", "SELECT model, COUNT(*) AS records FROM drive_day GROUP BY 1")
def model_frequency(spark, sf_dir):
    return rp.model_frequency(fx.drive_day(spark, sf_dir))


@query("distinct_models", "SELECT DISTINCT model FROM drive_day")
def distinct_models(spark, sf_dir):
    return rp.distinct_models(fx.drive_day(spark, sf_dir))


@query("class_counts", "SELECT predict_val, COUNT(*) AS records FROM labelled_day GROUP BY 1", ("labelled_day",))
def class_counts(spark, sf_dir):
    return rp.class_counts(fx.labelled_days(spark, sf_dir))


@query("max_series_length", """SELECT MAX(n) AS longest FROM (SELECT COUNT(*) AS n FROM drive_day GROUP BY serial_number)""")
def max_series_length(spark, sf_dir):
    return rp.max_series_length(fx.drive_day(spark, sf_dir))


@query("series_class_counts", """SELECT failed, COUNT(*) AS drives FROM (
  SELECT serial_number, MAX(failure) AS failed FROM drive_day GROUP BY 1) GROUP BY 1""")
def series_class_counts(spark, sf_dir):
    return rp.series_class_counts(fx.drive_day(spark, sf_dir))


@query("histogram", """, r AS (SELECT MIN(smart_188_raw) AS lo, (MAX(smart_188_raw) - MIN(smart_188_raw)) / 20 AS w,
    COUNT(*) - COUNT(smart_188_raw) AS missing FROM drive_day)
  SELECT CAST(GREATEST(0, LEAST(FLOOR((smart_188_raw - lo) / w), 19)) AS BIGINT) AS bin, ROUND(ANY_VALUE(lo + w * GREATEST(0, LEAST(FLOOR((smart_188_raw - lo) / w), 19))), 6) AS low,
    ROUND(ANY_VALUE(lo + w * (1 + GREATEST(0, LEAST(FLOOR((smart_188_raw - lo) / w), 19)))), 6) AS high,
    COUNT(*) AS records, ANY_VALUE(missing) AS null_records
  FROM drive_day, r WHERE smart_188_raw IS NOT NULL GROUP BY 1""")
def histogram(spark, sf_dir):
    return rounded(rp.histogram(fx.drive_day(spark, sf_dir), "smart_188_raw", 20))


_CORR = ["failure", *fx.RAW]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR({a}, {b}), 6) AS r FROM drive_day" for a, b in combinations(_CORR, 2)))
def correlation_matrix(spark, sf_dir):
    return rounded(rp.correlation_matrix(fx.drive_day(spark, sf_dir), _CORR))


@query("correlation_by_vendor", " UNION ALL ".join(
    f"SELECT {VENDOR_SQL} AS vendor, '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR({a}, {b}), 6) AS r FROM drive_day GROUP BY 1"
    for a, b in combinations(["failure", *fx.FULL_RAW], 2)))
def correlation_by_vendor(spark, sf_dir):
    return rounded(rp.correlation_by_vendor(fx.drive_day(spark, sf_dir), _CORR))


@query("correlation_of_sampled_drives", """, d AS (SELECT serial_number, MAX(failure) AS f FROM drive_day GROUP BY 1),
  s AS (SELECT serial_number FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY f ORDER BY md5('42|' || serial_number)) AS rn FROM d)
        WHERE (f = 1 AND rn <= 20) OR (f = 0 AND rn <= 60))
  """ + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR({a}, {b}), 6) AS r FROM drive_day SEMI JOIN s USING (serial_number)"
    for a, b in combinations(_CORR, 2)))
def correlation_of_sampled_drives(spark, sf_dir):
    from spindlescope.operators.selection import keep_serials
    days = fx.drive_day(spark, sf_dir)
    return rounded(rp.correlation_matrix(keep_serials(days, rp.sample_drives(days, 20, 60)), _CORR))


@query("top_models_by_failures", f"""SELECT *, {VENDOR_SQL} AS vendor FROM ({_MODEL_REPORT}) WHERE failures > 0
  ORDER BY failures DESC, model LIMIT 2""")
def top_models_by_failures(spark, sf_dir):
    return rounded(rp.top_models(rp.model_report(fx.drive_day(spark, sf_dir)), "failures", 2))


@query("top_models_by_rate", f"""SELECT *, {VENDOR_SQL} AS vendor FROM ({_MODEL_REPORT}) WHERE failures > 0
  ORDER BY fail_pct DESC, model LIMIT 10""")
def top_models_by_rate(spark, sf_dir):
    return rounded(rp.top_models(rp.model_report(fx.drive_day(spark, sf_dir)), "fail_pct", 10))


@query("order_models", f"""SELECT model, failures, ROW_NUMBER() OVER (ORDER BY failures DESC, model) AS place FROM ({_MODEL_REPORT})
  WHERE failures > 0""")
def order_models(spark, sf_dir):
    from pyspark.sql.window import Window
    ordered = rp.order_models(rp.model_report(fx.drive_day(spark, sf_dir))).select("model", "failures")
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.col("failures").desc(), "model")).cast("long"))


@query("drive_trajectories", """, f AS (SELECT DISTINCT serial_number FROM drive_day WHERE failure = 1 ORDER BY 1 LIMIT 10),
  d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS day_index FROM drive_day SEMI JOIN f USING (serial_number))
  """ + " UNION ALL ".join(f"SELECT serial_number, day_index, '{c}' AS feature, {c} AS value FROM d" for c in _CRITICAL))
def drive_trajectories(spark, sf_dir):
    return rp.drive_trajectories(fx.drive_day(spark, sf_dir), _CRITICAL, n=10, seed=None)
