"""The end-to-end query: clean, gap-check, label and window the drive days, then count windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.operators.windows import lag_windows
from spindlescope.plans import fixtures as fx
from spindlescope.plans.registry import query, view

view("full_windows", f"""SELECT *, MAX(predict_val) OVER w AS window_label FROM labelled_day
  WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN {fx.WINDOW - 1} PRECEDING AND CURRENT ROW)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date) >= {fx.WINDOW}""",
     ("labelled_day",))


@query("windows_per_label", """SELECT model, window_label, COUNT(*) AS windows FROM full_windows GROUP BY 1, 2""",
       ("full_windows",))
def windows_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = lag_windows(fx.labelled_days(spark, sf_dir), fx.FULL_SMART, fx.WINDOW)
    return windows.groupBy("model", "window_label").agg(F.count(F.lit(1)).alias("windows"))
