"""Drive-day tables derived from the driver's tables, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlescope.operators.history import failure_horizon_labels, filter_drives
from spindlescope.plans.registry import view
from spindlescope.session import ensure_checkpoint_dir

MIN_DAYS, GAP_WINDOW, MAX_MISSING = 20, 7, 2
HORIZON, WINDOW = 3, 5
SMART = ["smart_5_raw", "smart_9_raw", "smart_187_raw", "smart_188_raw", "smart_197_raw", "smart_5_normalized"]
FULL_SMART = [c for c in SMART if c != "smart_188_raw"]
RAW = [c for c in SMART if c.endswith("raw")]
FULL_RAW = [c for c in FULL_SMART if c.endswith("raw")]
MODELS = ("ST3000DM001", "ST4000DM000", "HGST HMS5C4040BLE640", "Hitachi HDS722020ALA330", "WDC WD30EFRX", "TOSHIBA MQ01ABF050")


def _model(serial):
    spot = F.pmod(serial, F.lit(6))
    out = F.when(spot == 0, MODELS[0])
    for i, name in enumerate(MODELS[1:-1], start=1):
        out = out.when(spot == i, name)
    return out.otherwise(MODELS[-1])


def _as_drive_days(base: DataFrame) -> DataFrame:
    """Add model, capacity and the failure flag; ``base`` is one row per serial and date.

    Days are aggregated before they meet by serial, so a serial that fills a third of the source
    rows is already down to one row per calendar day here.
    """
    # in the order that the windows above need, so that a drive is sorted once
    days = Window.partitionBy("serial_number").orderBy("date")
    last = F.max("date").over(days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    failed = (F.pmod("serial_number", F.lit(4)) == 0) & (F.col("date") == last)
    return base.select(
        "serial_number", "date", _model(F.col("serial_number")).alias("model"),
        F.lit(4000787030016).cast("long").alias("capacity_bytes"), F.when(failed, 1).otherwise(0).alias("failure"),
        *[F.col(c).cast("double").alias(c) for c in SMART])


def drive_day(spark: SparkSession, sf_dir: str, pooled: int | None = None) -> DataFrame:
    """Users as drives and days as snapshots; ``pooled`` folds the users onto that many drives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    serial = F.col("user_id") if pooled is None else F.pmod("user_id", F.lit(pooled))
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    base = events.groupBy(serial.alias("serial_number"), F.col("ts").cast("date").alias("date")).agg(
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("smart_5_raw"),
        F.round(F.sum("value"), 2).alias("smart_9_raw"),
        F.round(F.max("value"), 2).alias("smart_187_raw"),
        F.round(F.min("value"), 2).alias("smart_197_raw"),
        F.round(F.max(bought), 2).alias("smart_188_raw"),
        (F.lit(100) - F.least(F.lit(99), F.count(F.lit(1)) * 5)).alias("smart_5_normalized"))
    return _as_drive_days(base)


def supplier_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as drives and ship dates as days: histories of several hundred days."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = lines.groupBy(F.col("l_suppkey").alias("serial_number"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("smart_5_raw"),
        F.round(F.sum("l_quantity"), 2).alias("smart_9_raw"),
        F.round(F.max("l_quantity"), 2).alias("smart_187_raw"),
        F.round(F.min("l_discount"), 2).alias("smart_197_raw"),
        F.round(F.max(F.when(F.col("l_linestatus") == "F", F.col("l_tax"))), 2).alias("smart_188_raw"),
        (F.lit(100) - F.least(F.lit(99), F.count(F.lit(1)) * 5)).alias("smart_5_normalized"))
    return _as_drive_days(base)


def kept_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_drives(drive_day(spark, sf_dir), MIN_DAYS, GAP_WINDOW, 2, MAX_MISSING)[0]


def labelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_horizon_labels(kept_days(spark, sf_dir), HORIZON, WINDOW)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows with double vectors and a 0/1 class."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label",
                       (F.col("label") == 0).cast("int").alias("positive"))


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


_CASE_MODEL = "CASE serial_number % 6 " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS[:-1])) + f" ELSE '{MODELS[-1]}' END"
_SMART_LIST = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SMART)


def _drive_day_sql(base: str) -> str:
    return f"""SELECT serial_number, date, {_CASE_MODEL} AS model, CAST(4000787030016 AS BIGINT) AS capacity_bytes,
      CASE WHEN serial_number % 4 = 0 AND date = MAX(date) OVER (PARTITION BY serial_number) THEN 1 ELSE 0 END AS failure,
      {_SMART_LIST} FROM ({base})"""


_EVENT_BASE = """SELECT {serial} AS serial_number, CAST(ts AS DATE) AS date,
      SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS smart_5_raw, ROUND(SUM(value), 2) AS smart_9_raw,
      ROUND(MAX(value), 2) AS smart_187_raw, ROUND(MIN(value), 2) AS smart_197_raw,
      ROUND(MAX(CASE WHEN event_type = 'purchase' THEN value END), 2) AS smart_188_raw,
      100 - LEAST(99, COUNT(*) * 5) AS smart_5_normalized FROM events GROUP BY 1, 2"""

view("drive_day", _drive_day_sql(_EVENT_BASE.format(serial="user_id")))
view("drive_day_pooled", _drive_day_sql(_EVENT_BASE.format(serial="user_id % 60")))
view("supplier_day", _drive_day_sql("""SELECT l_suppkey AS serial_number, CAST(l_shipdate AS DATE) AS date,
      SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS smart_5_raw, ROUND(SUM(l_quantity), 2) AS smart_9_raw,
      ROUND(MAX(l_quantity), 2) AS smart_187_raw, ROUND(MIN(l_discount), 2) AS smart_197_raw,
      ROUND(MAX(CASE WHEN l_linestatus = 'F' THEN l_tax END), 2) AS smart_188_raw,
      100 - LEAST(99, COUNT(*) * 5) AS smart_5_normalized FROM lineitem GROUP BY 1, 2"""))

# Complete rows: the sparse column is gone, so every remaining column is filled.
view("complete_day", "SELECT serial_number, date, model, capacity_bytes, failure, " + ", ".join(FULL_SMART) +
     " FROM drive_day WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FULL_SMART), ("drive_day",))


def _spine_sql(source: str) -> str:
    return f"""SELECT s.serial_number, s.date, r.serial_number IS NULL AS is_gap FROM (
      SELECT serial_number, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (
        SELECT serial_number, MIN(date) AS lo, MAX(date) AS hi FROM {source} GROUP BY serial_number)) s
      LEFT JOIN {source} r ON r.serial_number = s.serial_number AND r.date = s.date"""


view("complete_spine", _spine_sql("complete_day"), ("complete_day",))
view("raw_spine", _spine_sql("drive_day"), ("drive_day",))
view("gap_flags", f"""SELECT serial_number, date, is_gap,
      CAST(SUM(CASE WHEN is_gap THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_missing,
      AVG(CASE WHEN is_gap THEN 1.0 ELSE 0.0 END) OVER w AS mean_missing FROM complete_spine
      WINDOW w AS (PARTITION BY serial_number ORDER BY date ROWS BETWEEN {GAP_WINDOW - 1} PRECEDING AND CURRENT ROW)""",
     ("complete_spine",))
view("short_drives", f"SELECT serial_number FROM complete_day GROUP BY 1 HAVING COUNT(*) < {MIN_DAYS}", ("complete_day",))
view("gappy_drives", f"""SELECT DISTINCT serial_number FROM gap_flags WHERE n_missing > {MAX_MISSING}
      AND serial_number NOT IN (SELECT serial_number FROM short_drives)""", ("gap_flags", "short_drives"))
view("kept_day", """SELECT * FROM complete_day WHERE serial_number NOT IN (SELECT serial_number FROM short_drives)
      AND serial_number NOT IN (SELECT serial_number FROM gappy_drives)""", ("complete_day", "short_drives", "gappy_drives"))


def label_sql(source: str, days: int, window: int) -> str:
    return f"""SELECT * EXCLUDE (n, back, ever), CASE WHEN ever = 1 AND back <= {days} THEN 1 ELSE 0 END AS predict_val,
      CASE WHEN ever = 1 AND back <= {days + window} THEN 1 ELSE 0 END AS validate_val FROM (
        SELECT *, COUNT(*) OVER (PARTITION BY serial_number) AS n, MAX(failure) OVER (PARTITION BY serial_number) AS ever,
          ROW_NUMBER() OVER (PARTITION BY serial_number ORDER BY date DESC) AS back FROM {source})
      WHERE n > {days + window}"""


view("labelled_day", label_sql("kept_day", HORIZON, WINDOW), ("kept_day",))
view("v", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings")
