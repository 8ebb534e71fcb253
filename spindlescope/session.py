"""Session helpers: lineage cuts in shared storage and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 50_000
#: Parts that the rows of one key are dealt to by ``split_join``.
SPLIT_PARTS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spindlescope-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the written copy.

    For loops that derive a frame from itself: a checkpointed frame keeps the constraints of the plan it came from, and they
    double with every join of the frame with itself, until planning takes minutes. A written one has none.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Join with a side expected to be small.

    The side is fetched up to ``max_rows`` + 1 rows. Within the bound it becomes a broadcast
    local relation, so the large side is not shuffled; beyond it the join is left to the
    planner, with adaptive skew handling.
    """
    head = small.limit(max_rows + 1).collect()
    if len(head) > max_rows:
        return df.join(small, on, how)
    local = df.sparkSession.createDataFrame(head, small.schema)
    return df.join(F.broadcast(local), on, how)


def split_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", parts: int = SPLIT_PARTS) -> DataFrame:
    """Join ``small`` to ``df``, whose keys may be hot: one key may hold a third of all rows.

    Rows of a key are dealt to ``parts`` parts by a hash of the whole row. ``small`` is repeated only for the parts that a key
    really has, which are found from partial distinct counts, so rare keys travel once. ``df`` is read twice: give a
    stored or cheap one.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts)))
    copies = dealt.select(*on, "_part").distinct().join(small, on)
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def lookup_rows(small: DataFrame, max_rows: int = LOOKUP_ROWS) -> list:
    """Rows of a summary whose size has a known bound; fails rather than cut it short."""
    head = small.limit(max_rows + 1).collect()
    if len(head) > max_rows:
        raise ValueError(f"summary has more than {max_rows} rows")
    return head
