"""Serial lists, stage cache, relational sink and time-ordered storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlescope.functions.names import split_list


def serial_list(df: DataFrame, models: str | list[str] | None = None, failed_only: bool = False) -> DataFrame:
    """Distinct serials of the chosen models, optionally only of drives with a failure row."""
    out = df
    if models:
        out = out.filter(F.col("model").isin(split_list(models) if isinstance(models, str) else list(models)))
    if failed_only:
        out = out.filter("failure = 1")
    return out.select("serial_number").distinct()


def write_serial_list(serials: DataFrame, path: str) -> None:
    serials.write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialize(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame],
                partition_by: list[str] | None = None) -> DataFrame:
    """Load a finished stage from ``root`` if present, else build, save and load it.

    A stage counts as finished only with its success marker, so a job that died half way is
    rebuilt. ``key`` is a digest of the settings the stage depends on.
    """
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not _exists(spark, path):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite",
               properties: dict[str, str] | None = None, connections: int = 16) -> None:
    """Replace a relational table with the rows of ``df`` over at most ``connections`` writers."""
    (df.write.option("numPartitions", connections).jdbc(url, table, mode=mode, properties=properties or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties or {})
