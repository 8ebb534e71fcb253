"""From ``documents`` to token samples: drop toxic texts, repeated lines, near-duplicates and benchmark leaks, then encode.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` writes each result as Parquet
to the shared folder and reads it again, so a lost executor costs one stage's tasks at most. Rows without a doc_id cannot be
named by the joins: the duplicate and leak stages leave them in. Rows that share an id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm import decontaminate, fuzzy_lines, minhash, sampled_pieces, toxicity
from spindlescope.llm.common import stage, table

#: Lattices that the last stage keeps per task: the heap is full by then, and workers of earlier stages still hold memory.
KEPT_SEGMENTS = 75_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the network, fitted to the labelled rows among ``docs``, scores below one half."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats, exactly or nearly; a text of which no line is left goes."""
    left = fuzzy_lines.drop_lines(docs, fuzzy_lines.duplicate_lines(docs))
    return left.where((F.col("__gone") == 0) | (F.col("__gone") < F.col("__lines"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return _without(docs, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each text, with the check that they decode to it."""
    coded = sampled_pieces.encode_samples(docs, decoded=True, kept=KEPT_SEGMENTS)
    return coded.select("doc_id", "sample", "ids", "log_prob", "log_inclusion", (F.xxhash64("decoded") == F.col("text_hash")).alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: A trained network, edit distances and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
