"""Mixing sources to target weights: nested hash thresholds found by histograms, refined in the boundary bucket only.

Every row has a fixed 60-bit hash. Of a source that gives less than its whole size, the rows below a threshold are taken; of
one that gives more, all rows are taken and those below the threshold once more. A larger budget therefore takes all that a smaller
one takes. The threshold is found from the top: token sums per source and hash bucket (4,096 buckets), then the same
within the one bucket where the budget ends, until that bucket is a single hash. Nothing is sorted by row, and all of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlescope.llm.common import stage, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2
SEED = 12
HASH_BITS = 60
LEVEL_BITS = 12
#: Summaries of up to so many sources are broadcast; beyond that, rows are salted into PARTS parts per source.
BROADCAST_SOURCES = 50_000
PARTS = 64
#: Equal rows at a threshold are written back in groups of so many.
GROUP = 10_000
SOURCE = ["none", "source"]


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_number_hash(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """60 bits from the row's id, from its text where it has none; the same in any engine with md5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, HASH_BITS // 4), 16, 10).cast("long")


def per_source(rows: DataFrame, small: DataFrame, sources: int) -> DataFrame:
    """Join ``small`` (one row per source) to ``rows``, whose sources may be hot."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), SOURCE)
    salted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(PARTS)).cast("int"))
    copies = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return salted.join(copies, [*SOURCE, "part"]).drop("part")


def weighted(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Give the sources, by code point and null last, the ``weights`` in turn. Ranks are counted per range of names and offset."""
    ranged = stage(sources.repartitionByRange(*[F.col(c) for c in SOURCE]).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*SOURCE)) - 1 + F.col("offset")
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return ranged.join(offset, "range").withColumn("weight", turn).drop("range", "offset")


def targets(sources: DataFrame, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target``: shares of ``budget`` times all sizes by weight, at most ``most`` times the source's size.

    What a full source leaves goes to the others by weight until none is above. Each round is one aggregate; full sources
    stay full, as the share per weight only grows.
    """
    cap = F.col("source_size") * most
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        seen = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap).otherwise(0)).alias("used"),
                           F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if seen["full"] == full or not seen["open"]:
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level or 0.0)))
        level, full = (budget * seen["all"] - seen["used"]) / seen["open"], seen["full"]


def thresholds(rows: DataFrame, histogram: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Per source with something left to take (``rest``): the hash where the rest ends, and the words below it.

    ``rows``: none, source, doc_id, size, h. ``histogram``: their first level (none, source, bucket, words, low, high).
    Returns none, source, cut, before.
    """
    by = Window.partitionBy(*SOURCE).orderBy("bucket")
    start = plan.select(*SOURCE, "rest", F.lit(0).cast("long").alias("start"))
    shift, level = HASH_BITS - LEVEL_BITS, histogram
    while True:
        sums = level.join(start, SOURCE).withColumn("before", F.col("start") + F.sum("words").over(by) - F.col("words"))
        edge = stage(sums.where("before <= rest AND rest < before + words").select(*SOURCE, "rest", "bucket", "before", "low", "high"))
        if not edge.where("low < high").limit(1).count():
            return edge.select(*SOURCE, F.col("low").alias("cut"), "before")
        inside = F.shiftright("h", shift) == F.col("bucket")
        rows = stage(per_source(rows, edge.select(*SOURCE, "bucket"), sources).where(inside).drop("bucket"))
        shift -= LEVEL_BITS
        level = _histogram(rows, shift)
        start = edge.select(*SOURCE, "rest", F.col("before").alias("start"))


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    return rows.groupBy(*SOURCE, F.shiftright("h", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))


def at_threshold(tied: DataFrame) -> DataFrame:
    """The rows whose hash is their source's threshold: as many of them as come nearest to the budget are taken once more.

    Equal rows are counted first and written back in groups, so any number of them fits.
    """
    same = tied.groupBy(*SOURCE, "doc_id", "size", "source_size", "target", "copies", "rest", "before").count()
    words = F.col("size") * F.col("count")
    by = Window.partitionBy(*SOURCE).orderBy(F.asc_nulls_first("doc_id"), "size")
    same = same.withColumn("before", F.col("before") + F.sum(words).over(by) - words)
    groups = same.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / GROUP))))
    groups = groups.repartition(*SOURCE, "doc_id", "group")
    last = F.least(F.col("count"), (F.col("group") + 1) * GROUP) - 1
    each = groups.withColumn("n", F.explode(F.sequence(F.col("group") * GROUP, last)))
    more = 2 * (F.col("before") + F.col("n") * F.col("size")) + F.col("size") <= 2 * F.col("rest")
    return each.withColumn("copies", F.col("copies") + more.cast("long"))


def mix(docs: DataFrame, budget: float = BUDGET, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often each row goes into a mix of ``budget`` times all words, with sources by ``weights``.

    ``docs``: doc_id, text, source. Returns one row per row, repeated and id-less ones included: doc_id, source, size, source_size,
    target, copies, taken. A source's taken words differ from its target by at most half of the row at the threshold. Null and empty
    texts have size 0; null is a source of its own and the last one. Rows without an id are told apart by their text; equal
    rows are interchangeable. Other columns are left behind.
    """
    rows = stage(docs.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "doc_id",
                             n_words(F.col("text")).alias("size"), row_number_hash(F.col("doc_id"), F.col("text"), seed).alias("h")))
    histogram = stage(_histogram(rows, HASH_BITS - LEVEL_BITS))
    sizes = weighted(histogram.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights)
    copies = F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(most)), F.lit(0)).cast("long")
    plan = stage(targets(stage(sizes), budget, most).select(*SOURCE, "source_size", "target", copies.alias("copies"))
                 .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    sources = plan.count()
    cuts = thresholds(rows, histogram, plan, sources)
    marked = per_source(rows, plan.join(cuts, SOURCE, "left"), sources)
    plain = marked.where("cut IS NULL OR h != cut").withColumn("copies", F.col("copies") + F.coalesce(F.col("h") < F.col("cut"), F.lit(False)).cast("long"))
    columns = [*SOURCE, "doc_id", "size", "source_size", "target", "copies"]
    every = plain.select(*columns).unionByName(at_threshold(marked.where("h = cut")).select(*columns))
    return every.select("doc_id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target", "copies",
                        (F.col("size") * F.col("copies")).alias("taken"))


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 3, 1, 2 in turn, for a mix of half as many words again."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('12|' || coalesce(CAST(doc_id AS VARCHAR), '?' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM s) AS lam, -1::BIGINT AS full_before, 0::BIGINT AS full_now
  UNION ALL
  SELECT step + 1, CASE WHEN n.open = 0 THEN lam ELSE (n.total - n.used) / n.open END, full_now, n.full_n
  FROM fill, LATERAL (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(CASE WHEN weight * lam > 2 * source_size THEN 2 * source_size ELSE 0 END)::DOUBLE AS used,
    sum(CASE WHEN weight * lam > 2 * source_size THEN 0 ELSE weight END) AS open, count(*) FILTER (weight * lam > 2 * source_size) AS full_n FROM s) n
  WHERE full_before <> full_now),
lam AS (SELECT arg_max(lam, step) AS lam FROM fill),
t AS (SELECT source, source_size, CASE WHEN weight * lam > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE weight * lam END AS target FROM s, lam),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(floor(target / source_size), 2) AS BIGINT) END AS copies FROM t),
o AS (SELECT d.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""
