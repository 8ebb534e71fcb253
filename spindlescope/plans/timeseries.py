"""Queries over the calendar spine, gap rule, interpolation, labels, windows, scaling and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindlescope.operators import history as hs
from spindlescope.operators import scaling as sc
from spindlescope.operators import windows as wn
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query, view
from spindlescope.plans.reports import rounded

KEYS = "serial_number, date"
FULL = "serial_number, date, model, capacity_bytes, failure, " + ", ".join(fx.FULL_SMART)
DILATED_WINDOW, DILATED_LAGS, DILATED_FACTORS = 8, (7, 3, 1, 0), (2, 2, 2)


def complete_days(spark, sf_dir):
    return fx.drive_day(spark, sf_dir).drop("smart_188_raw").na.drop()


@query("daily_spine", f"""SELECT s.serial_number, s.date, r.model, r.failure, r.smart_9_raw, r.smart_188_raw FROM raw_spine s
  LEFT JOIN drive_day r ON r.serial_number = s.serial_number AND r.date = s.date""", ("raw_spine", "drive_day"), dates=("date",))
def daily_spine(spark, sf_dir):
    return hs.daily_spine(fx.drive_day(spark, sf_dir)).select(
        "serial_number", "date", "model", "failure", "smart_9_raw", "smart_188_raw")


@query("missing_window_flags", """SELECT serial_number, date, is_gap, n_missing, ROUND(mean_missing, 6) AS mean_missing,
  n_missing > mean_missing * 2 AS breaks_rule FROM gap_flags""", ("gap_flags",), dates=("date",))
def missing_window_flags(spark, sf_dir):
    flags = hs.missing_window_flags(complete_days(spark, sf_dir), fx.GAP_WINDOW, 2)
    return rounded(flags.select("serial_number", "date", "is_gap", "n_missing", "mean_missing", "breaks_rule"))


@query("missing_window_flags_per_column", f"""SELECT serial_number, date, CAST(n AS BIGINT) AS n_missing, n > 3 AS breaks_rule FROM (
  SELECT s.serial_number, s.date, SUM(CASE WHEN r.smart_188_raw IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.serial_number
    ORDER BY s.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n
  FROM raw_spine s LEFT JOIN drive_day r ON r.serial_number = s.serial_number AND r.date = s.date)""", ("raw_spine",), dates=("date",))
def missing_window_flags_per_column(spark, sf_dir):
    flags = hs.missing_window_flags(fx.drive_day(spark, sf_dir), 7, 2, 3, ["smart_9_raw", "smart_188_raw"])
    return flags.select("serial_number", "date", "n_missing", "breaks_rule")


@query("filter_drives", f"SELECT {FULL} FROM kept_day", ("kept_day",), dates=("date",))
def filter_drives(spark, sf_dir):
    return fx.kept_days(spark, sf_dir)


@query("filter_drives_exact_rule", """, p AS (SELECT serial_number, date FROM drive_day_pooled),
  d AS (SELECT serial_number, COUNT(*) AS days, MIN(date) AS lo, MAX(date) AS hi FROM p GROUP BY 1),
  sp AS (SELECT serial_number, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM d),
  fl AS (SELECT sp.serial_number, sp.date, CASE WHEN p.date IS NULL THEN 1 ELSE 0 END AS gap FROM sp LEFT JOIN p USING (serial_number, date)),
  roll AS (SELECT serial_number, SUM(gap) OVER w AS s, AVG(gap) OVER w AS m FROM fl
    WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT serial_number, days FROM d WHERE days >= 20 AND serial_number NOT IN (SELECT serial_number FROM roll WHERE s > m * 2)""",
       ("drive_day_pooled",))
def filter_drives_exact_rule(spark, sf_dir):
    kept, _, _ = hs.filter_drives(fx.drive_day(spark, sf_dir, pooled=60).drop("smart_188_raw"), fx.MIN_DAYS, fx.GAP_WINDOW, 2)
    return kept.groupBy("serial_number").agg(F.count(F.lit(1)).alias("days"))


@query("bad_drives", """SELECT serial_number, 'short' AS reason FROM short_drives UNION ALL
  SELECT serial_number, 'gaps' FROM gappy_drives""", ("short_drives", "gappy_drives"))
def bad_drives(spark, sf_dir):
    _, gappy, short = hs.filter_drives(fx.drive_day(spark, sf_dir), fx.MIN_DAYS, fx.GAP_WINDOW, 2, fx.MAX_MISSING)
    return short.withColumn("reason", F.lit("short")).union(gappy.withColumn("reason", F.lit("gaps")))


def _line_sql(c: str) -> str:
    """Linear fill of one column on the spine view ``sp``, written with positions."""
    return f"""CASE WHEN {c} IS NOT NULL THEN {c}
      WHEN LAST_VALUE({c} IGNORE NULLS) OVER back IS NULL THEN FIRST_VALUE({c} IGNORE NULLS) OVER ahead
      WHEN FIRST_VALUE({c} IGNORE NULLS) OVER ahead IS NULL THEN LAST_VALUE({c} IGNORE NULLS) OVER back
      ELSE LAST_VALUE({c} IGNORE NULLS) OVER back
        + (FIRST_VALUE({c} IGNORE NULLS) OVER ahead - LAST_VALUE({c} IGNORE NULLS) OVER back)
        * (pos - LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER back)
        / (FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead
           - LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER back) END"""


_FRAMES = """WINDOW back AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  ahead AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def _label_line(c: str) -> str:
    return f"""CAST(ROUND_EVEN(CASE WHEN ABS({_line_sql(c)}) < 1e-10 THEN 0.0 ELSE {_line_sql(c)} END, 0) AS INTEGER) AS {c}"""


@query("interpolate", f""", sp AS (SELECT s.serial_number, s.date, s.date - DATE '1970-01-01' AS pos,
    r.* EXCLUDE (serial_number, date) FROM (SELECT serial_number,
      CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM labelled_day GROUP BY 1) s
    LEFT JOIN labelled_day r ON r.serial_number = s.serial_number AND r.date = s.date)
  SELECT serial_number, date, LAST_VALUE(model IGNORE NULLS) OVER back AS model, {_label_line('failure')}, {_label_line('predict_val')},
    {_label_line('validate_val')}, {", ".join(f"ROUND({_line_sql(c)}, 6) AS {c}" for c in fx.FULL_SMART)}
  FROM sp {_FRAMES}""", ("labelled_day",), dates=("date",))
def interpolate(spark, sf_dir):
    return rounded(hs.interpolate(fx.labelled_days(spark, sf_dir)).drop("capacity_bytes"))


@query("interpolate_time", f""", sp AS (SELECT s.serial_number, s.date, s.date - DATE '1970-01-01' AS pos, r.smart_188_raw
    FROM raw_spine s LEFT JOIN drive_day r ON r.serial_number = s.serial_number AND r.date = s.date)
  SELECT serial_number, date, ROUND({_line_sql('smart_188_raw')}, 6) AS smart_188_raw FROM sp {_FRAMES}""", ("raw_spine",), dates=("date",))
def interpolate_time(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_188_raw")
    return rounded(hs.interpolate(days, "time"))


_NUMBERS = ["capacity_bytes", "failure", *fx.SMART]


@query("interpolation_report", f""", d AS (SELECT serial_number, MAX(date) - MIN(date) + 1 AS span,
    {", ".join(f"COUNT({c}) AS n_{c}" for c in _NUMBERS)} FROM drive_day GROUP BY 1)
  SELECT CAST(SUM({" + ".join(f"CASE WHEN n_{c} > 0 THEN span - n_{c} ELSE 0 END" for c in _NUMBERS)}) AS BIGINT) AS filled_cells,
    CAST(SUM(span * 9) AS BIGINT) AS cells,
    ROUND(SUM({" + ".join(f"CASE WHEN n_{c} > 0 THEN span - n_{c} ELSE 0 END" for c in _NUMBERS)}) / SUM(span * 9) * 100.0, 6) AS filled_pct
  FROM d""")
def interpolation_report(spark, sf_dir):
    return rounded(hs.interpolation_report(fx.drive_day(spark, sf_dir)))


@query("fill_nulls_forward", f"""SELECT serial_number, date, LAST_VALUE(smart_188_raw IGNORE NULLS) OVER back AS smart_188_raw
  FROM drive_day {_FRAMES}""", dates=("date",))
def fill_nulls_forward(spark, sf_dir):
    return hs.fill_nulls(fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_188_raw"), "ffill")


@query("fill_nulls_backward", f"""SELECT serial_number, date, FIRST_VALUE(smart_188_raw IGNORE NULLS) OVER ahead AS smart_188_raw
  FROM drive_day {_FRAMES}""", dates=("date",))
def fill_nulls_backward(spark, sf_dir):
    return hs.fill_nulls(fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_188_raw"), "bfill")


@query("failure_horizon_labels", "SELECT serial_number, date, failure, predict_val, validate_val FROM labelled_day", ("labelled_day",),
       dates=("date",))
def failure_horizon_labels(spark, sf_dir):
    return fx.labelled_days(spark, sf_dir).select("serial_number", "date", "failure", "predict_val", "validate_val")


def exploded(windows, cols, extra=()):
    """One row per window, feature and step: steps count from the oldest day."""
    named = F.arrays_zip(F.array(*[F.lit(c) for c in cols]).alias("name"), F.col("features").alias("series"))
    rows = windows.select("serial_number", "date", *extra, F.inline(named))
    return rows.select("serial_number", "date", *extra, F.col("name").alias("feature"), F.posexplode("series").alias("step", "value"))


PAIR = ["smart_5_raw", "smart_9_raw"]


def _lagged_sql(source: str, lags, where: str, extra: str = "") -> str:
    """Long windows from LAG expressions; the first lag is the oldest day."""
    parts = []
    for c in PAIR:
        for step, lag in enumerate(lags):
            value = f"LAG({c}, {lag}) OVER w" if lag else c
            parts.append(f"SELECT {KEYS}, {extra} '{c}' AS feature, {step} AS step, {value} AS value, rn, n FROM r WINDOW w AS (PARTITION BY serial_number ORDER BY date)")
    return f""", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS rn,
      COUNT(*) OVER (PARTITION BY serial_number) AS n FROM {source})
      SELECT * EXCLUDE (rn, n) FROM ({" UNION ALL ".join(parts)}) WHERE {where}"""


@query("lag_windows", _lagged_sql("labelled_day", range(fx.WINDOW - 1, -1, -1), f"rn >= {fx.WINDOW - 1}"), ("labelled_day",), dates=("date",))
def lag_windows(spark, sf_dir):
    return exploded(wn.lag_windows(fx.labelled_days(spark, sf_dir), PAIR, fx.WINDOW), PAIR)


@query("lag_windows_off", f"SELECT {KEYS}, 'smart_5_raw' AS feature, 0 AS step, smart_5_raw AS value FROM labelled_day UNION ALL "
       f"SELECT {KEYS}, 'smart_9_raw', 0, smart_9_raw FROM labelled_day", ("labelled_day",), dates=("date",))
def lag_windows_off(spark, sf_dir):
    return exploded(wn.lag_windows(fx.labelled_days(spark, sf_dir), PAIR, fx.WINDOW, windowing=False), PAIR)


def _thin_chain(source: str, factors, skip_tail: int = 7) -> tuple[str, str]:
    """Successive thinning as nested queries, each with its own row numbers."""
    sql = source
    for f in factors:
        sql = f"""(SELECT * EXCLUDE (ti, tn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS ti,
          COUNT(*) OVER (PARTITION BY serial_number) AS tn FROM {sql})
          WHERE ti >= (tn - 1) % {f} AND (ti - (tn - 1) % {f}) % {f} = 0 AND ti < tn - {skip_tail})"""
    return sql


view("thinned_keys", f"SELECT serial_number, date FROM {_thin_chain('supplier_day', DILATED_FACTORS)}", ("supplier_day",))
_DILATED = _lagged_sql("supplier_day", DILATED_LAGS, "rn >= 7 AND (serial_number, date) IN (SELECT (serial_number, date) FROM thinned_keys)")


@query("lag_windows_dilated", _DILATED, ("supplier_day", "thinned_keys"), dates=("date",))
def lag_windows_dilated(spark, sf_dir):
    return exploded(wn.lag_windows(fx.supplier_day(spark, sf_dir), PAIR, DILATED_WINDOW, "dilated"), PAIR)


_LITERAL = _lagged_sql("supplier_day", (1, 1, 1, 0), "rn >= 1 AND (serial_number, date) IN (SELECT (serial_number, date) FROM thinned_keys)")


@query("lag_windows_dilated_literal", _LITERAL, ("supplier_day", "thinned_keys"), dates=("date",))
def lag_windows_dilated_literal(spark, sf_dir):
    return exploded(wn.lag_windows(fx.supplier_day(spark, sf_dir), PAIR, DILATED_WINDOW, "dilated", lags="literal"), PAIR)


view("supplier_labelled", fx.label_sql("supplier_day", 7, 8), ("supplier_day",))


@query("lag_windows_hybrid", """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS rn FROM supplier_labelled),
  k AS (SELECT serial_number, date FROM """ + _thin_chain("supplier_labelled", DILATED_FACTORS) + """),
  f AS (SELECT serial_number, date, 'full' AS window_kind, rn, validate_val, MAX(predict_val) OVER w AS window_label, SUM(smart_9_raw) OVER w AS smart_9_sum
    FROM r WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
  d AS (SELECT serial_number, date, rn, GREATEST(predict_val, LAG(predict_val, 1) OVER w, LAG(predict_val, 3) OVER w, LAG(predict_val, 7) OVER w) AS window_label,
      smart_9_raw + LAG(smart_9_raw, 1) OVER w + LAG(smart_9_raw, 3) OVER w + LAG(smart_9_raw, 7) OVER w AS smart_9_sum
    FROM r WINDOW w AS (PARTITION BY serial_number ORDER BY date))
  SELECT serial_number, date, window_kind, window_label, 8 AS width, ROUND(smart_9_sum, 2) AS smart_9_sum FROM f WHERE rn >= 7 AND validate_val = 1
  UNION ALL SELECT serial_number, date, 'dilated', window_label, 4, ROUND(smart_9_sum, 2) FROM d
    WHERE rn >= 7 AND (serial_number, date) IN (SELECT (serial_number, date) FROM k)""", ("supplier_labelled",), dates=("date",))
def lag_windows_hybrid(spark, sf_dir):
    days = hs.failure_horizon_labels(fx.supplier_day(spark, sf_dir), 7, 8)
    rows = wn.lag_windows(days, ["smart_9_raw"], DILATED_WINDOW, "hybrid")
    series = F.col("features")[0]
    return rows.select("serial_number", "date", "window_kind", "window_label", F.size(series).alias("width"),
                       F.round(F.aggregate(series, F.lit(0.0), lambda a, x: a + x), 2).alias("smart_9_sum"))


@query("thin_rows", f"SELECT serial_number, date, smart_9_raw FROM {_thin_chain('supplier_day', (3,))}", ("supplier_day",), dates=("date",))
def thin_rows(spark, sf_dir):
    return wn.thin_rows(fx.supplier_day(spark, sf_dir), 3).select("serial_number", "date", "smart_9_raw")


@query("thin_rows_from_start", """SELECT serial_number, date, smart_9_raw FROM supplier_day
  QUALIFY (ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1) % 3 = 0""", ("supplier_day",), dates=("date",))
def thin_rows_from_start(spark, sf_dir):
    return wn.thin_rows(fx.supplier_day(spark, sf_dir), 3, align="start").select("serial_number", "date", "smart_9_raw")


@query("window_label", """SELECT serial_number, date, MAX(predict_val) OVER (PARTITION BY serial_number ORDER BY date
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS window_label, MAX(predict_val) OVER (PARTITION BY serial_number ORDER BY date
  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS latest_label FROM labelled_day""", ("labelled_day",), dates=("date",))
def window_label(spark, sf_dir):
    whole = wn.window_label(fx.labelled_days(spark, sf_dir), fx.WINDOW)
    both = wn.window_label(whole.withColumnRenamed("window_label", "all_days"), fx.WINDOW, exclude_oldest=True)
    return both.select("serial_number", "date", F.col("all_days").alias("window_label"), F.col("window_label").alias("latest_label"))


@query("drop_warmup", f"""SELECT serial_number, date FROM drive_day
  QUALIFY ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) > {fx.WINDOW - 1}""", dates=("date",))
def drop_warmup(spark, sf_dir):
    return wn.drop_warmup(fx.drive_day(spark, sf_dir), wn.warmup_rows(fx.WINDOW)).select("serial_number", "date")


def _scaled_sql(fit: str) -> str:
    cells = [f"""ROUND(CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}""" for c in fx.FULL_SMART]
    ranges = ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in fx.FULL_SMART)
    return f"SELECT serial_number, date, {', '.join(cells)} FROM drive_day, (SELECT {ranges} FROM {fit})"


@query("min_max_scale", _scaled_sql("drive_day"), dates=("date",))
def min_max_scale(spark, sf_dir):
    return rounded(sc.min_max_scale(fx.drive_day(spark, sf_dir), fx.FULL_SMART)).select("serial_number", "date", *fx.FULL_SMART)


@query("min_max_scale_train", _scaled_sql("drive_day WHERE date < DATE '2024-01-21'"), dates=("date",))
def min_max_scale_train(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir)
    scaled = sc.min_max_scale(days, fx.FULL_SMART, "train", days.filter("date < DATE '2024-01-21'"))
    return rounded(scaled).select("serial_number", "date", *fx.FULL_SMART)


_SMOOTH = """, n AS (SELECT serial_number, date, smart_9_raw AS x, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) AS i FROM drive_day),
  s AS (SELECT serial_number, date, i, x, {start} AS f FROM n {join} WHERE i = 1
    UNION ALL SELECT n.serial_number, n.date, n.i, n.x, 0.3 * s.x + 0.7 * s.f FROM s JOIN n ON n.serial_number = s.serial_number AND n.i = s.i + 1)
  SELECT serial_number, date, ROUND(f, 6) AS smart_9_raw FROM s"""


@query("exp_smooth", _SMOOTH.format(start="CAST(x AS DOUBLE)", join=""), dates=("date",))
def exp_smooth(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_9_raw")
    return rounded(sc.exp_smooth(days, ["smart_9_raw"], 0.3))


_FIT = """, z0 AS (SELECT serial_number, date, smart_9_raw AS x, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) AS i FROM drive_day),
  z AS (SELECT serial_number, i, x, 0.0::DOUBLE AS f FROM z0 WHERE i = 1
    UNION ALL SELECT z0.serial_number, z0.i, z0.x, 0.3 * z.x + 0.7 * z.f FROM z JOIN z0 ON z0.serial_number = z.serial_number AND z0.i = z.i + 1),
  l0 AS (SELECT serial_number, SUM(POW(0.7, i - 1) * (x - f)) / SUM(POW(0.49, i - 1)) AS start FROM z GROUP BY 1)"""


@query("exp_smooth_least_squares", _FIT + _SMOOTH.format(start="start", join="JOIN l0 USING (serial_number)"), dates=("date",))
def exp_smooth_least_squares(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_9_raw")
    return rounded(sc.exp_smooth(days, ["smart_9_raw"], 0.3, "least_squares"))


@query("window_range_join", """, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) AS position FROM drive_day)
  SELECT a.serial_number, a.date, a.position, a.smart_9_raw, b.position AS near_position, b.smart_9_raw AS near_value
  FROM p a JOIN p b ON a.serial_number = b.serial_number AND b.position BETWEEN a.position - 3 AND a.position + 3""", dates=("date",))
def window_range_join(spark, sf_dir):
    return sc.range_pairs(fx.drive_day(spark, sf_dir), "smart_9_raw", 3)


@query("wavelet", """, p AS (SELECT serial_number, date, smart_9_raw AS x, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) AS i FROM drive_day),
  c AS (SELECT b.serial_number, b.date, a.scale,
    SUM(t.x * EXP(-POW((t.i - b.i) / a.scale, 2)) * COS(PI() * (t.i - b.i) / a.scale)) / SQRT(PI() * a.scale) AS re,
    -SUM(t.x * EXP(-POW((t.i - b.i) / a.scale, 2)) * SIN(PI() * (t.i - b.i) / a.scale)) / SQRT(PI() * a.scale) AS im
    FROM p b CROSS JOIN (SELECT CAST(UNNEST(range(1, 50)) AS INTEGER) AS scale) a
    JOIN p t ON t.serial_number = b.serial_number AND t.i BETWEEN b.i - 8 * a.scale AND b.i + 8 * a.scale GROUP BY 1, 2, 3)
  SELECT serial_number, date, 'smart_9_raw' AS feature, scale, ROUND(re, 5) + 0.0 AS re, ROUND(im, 5) + 0.0 AS im,
    ROUND(SQRT(re * re + im * im), 5) AS magnitude FROM c""", dates=("date",))
def wavelet(spark, sf_dir):
    out = sc.wavelet(fx.drive_day(spark, sf_dir), ["smart_9_raw"])
    return rounded(out, 5).withColumns({"re": F.col("re") + 0.0, "im": F.col("im") + 0.0})


@query("flatten_windows", _lagged_sql("labelled_day", range(fx.WINDOW - 1, -1, -1), f"rn >= {fx.WINDOW - 1}").replace("SELECT * EXCLUDE (rn, n)",
       "SELECT serial_number, date, CAST(step + CASE feature WHEN 'smart_9_raw' THEN 5 ELSE 0 END AS INTEGER) AS slot, value"),
       ("labelled_day",), dates=("date",))
def flatten_windows(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    windows = wn.lag_windows(fx.labelled_days(spark, sf_dir), PAIR, fx.WINDOW)
    flat = wn.flatten_windows(windows).withColumn("flat", vector_to_array("vector"))
    back = wn.to_window_array(flat, "flat", fx.WINDOW)
    return back.select("serial_number", "date", F.posexplode(F.flatten("features")).alias("slot", "value"))


@query("pad_series", """, m AS (SELECT MAX(n) AS longest FROM (SELECT COUNT(*) AS n FROM drive_day GROUP BY serial_number)),
  d AS (SELECT serial_number, COUNT(*) AS n, LIST(smart_9_raw ORDER BY date) AS l FROM drive_day GROUP BY 1)
  SELECT serial_number, CAST(n AS INTEGER) AS length, CAST(p - 1 AS INTEGER) AS slot, CASE WHEN p <= n THEN l[p] ELSE 2.0 END AS value
  FROM (SELECT *, UNNEST(range(1, longest + 1)) AS p FROM d, m)""")
def pad_series(spark, sf_dir):
    lists = wn.grouped_lists(fx.drive_day(spark, sf_dir).select("serial_number", "date", "failure", "smart_9_raw"))
    padded = wn.pad_series(lists, ["failure", "smart_9_raw"])
    return padded.select("serial_number", "length", F.posexplode("smart_9_raw").alias("slot", "value"))


@query("drive_series_samples", """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) AS rn,
    COUNT(*) OVER (PARTITION BY serial_number) AS n FROM drive_day),
  f AS (SELECT serial_number, MIN(rn) AS bad FROM n WHERE failure = 1 GROUP BY 1), m AS (SELECT MAX(n) AS longest FROM n)
  SELECT serial_number, date, smart_9_raw, smart_197_raw, CASE WHEN bad IS NOT NULL AND rn >= bad - 7 THEN 1 ELSE 0 END AS label
  FROM n LEFT JOIN f USING (serial_number), m
  WHERE CASE WHEN bad IS NOT NULL THEN rn < bad WHEN n < longest THEN rn <= n - 8 ELSE rn <= n - 7 END""", dates=("date",))
def drive_series_samples(spark, sf_dir):
    return wn.drive_series_samples(fx.drive_day(spark, sf_dir), ["smart_9_raw", "smart_197_raw"])


@query("extend_short_history", """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS rn,
    COUNT(*) OVER (PARTITION BY serial_number) AS n FROM drive_day)
  SELECT serial_number, date, smart_9_raw, rn AS position FROM n WHERE n >= 28 UNION ALL
  SELECT serial_number, date, smart_9_raw, rn + c * n FROM (SELECT *, UNNEST(range(0, 28)) AS c FROM n WHERE n < 28) WHERE rn + c * n < 28""",
       dates=("date",))
def extend_short_history(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_9_raw")
    return wn.extend_short_history(days, 28)


@query("extend_short_history_interpolate", """, n AS (SELECT serial_number, smart_9_raw AS x, ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) - 1 AS rn,
    COUNT(*) OVER (PARTITION BY serial_number) AS n FROM drive_day),
  g AS (SELECT serial_number, n, UNNEST(range(0, 28)) AS position FROM (SELECT DISTINCT serial_number, n FROM n WHERE n < 28))
  SELECT serial_number, rn AS position, ROUND(x, 6) AS smart_9_raw FROM n WHERE n >= 28 UNION ALL
  SELECT g.serial_number, g.position, ROUND(a.x + (b.x - a.x) * (g.position * g.n / 28.0::DOUBLE - a.rn), 6) FROM g
  JOIN n a ON a.serial_number = g.serial_number AND a.rn = g.position * g.n // 28
  JOIN n b ON b.serial_number = g.serial_number AND b.rn = LEAST(g.position * g.n // 28 + 1, g.n - 1)""")
def extend_short_history_interpolate(spark, sf_dir):
    days = fx.drive_day(spark, sf_dir).select("serial_number", "date", "smart_9_raw")
    return rounded(wn.extend_short_history(days, 28, "interpolate").select("serial_number", "position", "smart_9_raw"))
