"""Benchmark decontamination by spaced seeds: masks that skip token positions find overlaps despite substitutions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import WordHashes, bitmap, in_bitmap, mix, spread, stage, table

#: Fixed seeds: a 1 is a token that counts, a 0 one that may differ. Every alignment with LEAST_TOKENS equal tokens that are
#: PERCENT of it holds one of them somewhere, wherever its other tokens lie.
MASKS = ("111111", "11010111", "111011001")
#: The same for items that need fewer equal tokens, down to SHORTEST_ITEM.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: An overlap counts from this many equal tokens (PERCENT of a shorter item's tokens) ...
LEAST_TOKENS = 13
#: ... if this share of its aligned tokens is equal.
PERCENT = 80
#: Shorter items say nothing and are never sought.
SHORTEST_ITEM = 5
_FOLD = {i: " " for i in range(128) if not chr(i).isalnum()}


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, ASCII punctuation taken as blanks."""
    return (text or "").lower().translate(_FOLD).encode("utf-8", "surrogatepass").split()


def least_equal(size: int) -> int:
    """Equal tokens that an overlap with an item of ``size`` tokens needs."""
    return min(LEAST_TOKENS, -(-PERCENT * size // 100))


def masks_of(size: int) -> tuple[str, ...]:
    """The masks that find every overlap with an item of ``size`` tokens; none for one that is never sought."""
    return () if size < SHORTEST_ITEM else MASKS if least_equal(size) == LEAST_TOKENS else SHORT_MASKS


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counting positions of ``mask`` laid at every token."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, np.uint64(int("1" + mask, 2)), np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + size]
            out ^= out >> np.uint64(31)
    return mix(out)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """Seeds (h, item_id, at) of every item with an id and a length that is sought."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        known = WordHashes()
        for batch in batches:
            row, at, found = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                hashes = known.of(tokens(t))
                for m in masks_of(len(hashes)):
                    h = seed_hashes(hashes, m)
                    row.append(np.full(len(h), i))
                    at.append(np.arange(len(h), dtype=np.int32))
                    found.append(h)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column("item_id").take(pa.array(np.concatenate(row))),
                                                  pa.array(np.concatenate(at))], ["h", "item_id", "at"])
    return benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, f"h long, item_id {kind}, at int")


def used_masks(benchmark: DataFrame) -> list[str]:
    """The masks that some item of the benchmark needs."""
    def run(batches):
        for batch in batches:
            used = {m for t in batch.column("text").to_pylist() for m in masks_of(len(tokens(t)))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(used), pa.string())], ["m"])
    return sorted(r["m"] for r in benchmark.select("text").mapInArrow(run, "m string").distinct().collect())


def seed_hits(docs: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """Exact seed matches (doc_id, item_id, offset): the item starts ``offset`` tokens into the text (negative: before it).

    Two bitmaps of fixed size pass the positions that may be seeds, the join on the hash keeps the true ones; a seed that
    many texts hold is split there.
    """
    sc = docs.sparkSession.sparkContext
    second = F.shiftrightunsigned("h", 32).alias("h")
    bits = sc.broadcast((bitmap(seeds, "h"), bitmap(seeds.select(second), "h")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        low, high = (np.frombuffer(b, np.uint32) for b in bits.value)
        known = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                found = [tokens(t) for t in texts[a:a + 500]]
                sizes = np.array([len(f) for f in found], np.int64)
                hashes = known.of([w for f in found for w in f])
                doc_of = np.repeat(np.arange(len(found)), sizes)
                start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for m in masks:
                    h = seed_hashes(hashes, m)
                    at = np.flatnonzero(in_bitmap(low, h))
                    at = at[in_bitmap(high, h[at] >> np.uint64(32))]
                    at = at[doc_of[at] == doc_of[at + len(m) - 1]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(doc_of[at] + a)), pa.array((at - start[doc_of[at]]).astype(np.int32)), pa.array(h[at].view(np.int64))],
                            ["doc_id", "pos", "h"])
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pos int, h long")
    return spread(found, seeds, "h", "doc_id").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("offset")).distinct()


def best_overlap(doc: np.ndarray, item: np.ndarray, offset: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(start in the text, length, equal tokens) of the stretch of the alignment with the most equal tokens among those of which ``percent`` are equal."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    if hi <= lo:
        return 0, 0, 0
    equal = doc[lo + offset:hi + offset] == item[lo:hi]
    # a stretch from i to j has the share if sums[j] >= sums[i]; for each j the earliest such i has the most equal tokens
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    count = np.concatenate([[0], np.cumsum(equal)])
    floor = np.minimum.accumulate(sums)
    begins = np.searchsorted(-floor, -sums)
    matched = count - count[begins]
    end = int(np.argmax(matched))
    if not matched[end]:
        return 0, 0, 0
    # unequal tokens at its ends are no part of it
    inside = begins[end] + np.flatnonzero(equal[begins[end]:end])
    return int(lo + offset + inside[0]), int(inside[-1] - inside[0] + 1), len(inside)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps (doc_id, item_id, start, length, matched) between texts and benchmark items.

    An overlap is the stretch of an alignment with the most equal tokens that are PERCENT of it; it counts with LEAST_TOKENS
    equal tokens (PERCENT of a shorter item). The masks leave no such alignment without a seed. Null and empty texts overlap with nothing; rows without doc_id
    or item_id are left out; rows that share an id are each compared. No benchmark items: no overlaps.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    seeds = stage(item_seeds(benchmark).distinct())
    hits = stage(seed_hits(docs, seeds, used_masks(benchmark)))
    ids = stage(hits.select("doc_id").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h"))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def pick(batches):
        cells = np.frombuffer(bits.value, np.uint32)
        for batch in batches:
            at = np.flatnonzero(in_bitmap(cells, batch.column("h").to_numpy()))
            yield batch.select(["doc_id", "text"]).take(pa.array(at))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(pick, f"doc_id {kind}, text string")
    items = benchmark.where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("item"))
    wanted = spread(hits, items, "item_id", "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "offset", "item")).alias("wanted"))

    def verify(batches):
        known = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted"))):
                doc = known.of(tokens(text))
                for w in wanted:
                    item = known.of(tokens(w["item"]))
                    start, length, matched = best_overlap(doc, item, w["offset"])
                    if length and matched >= least_equal(len(item)):
                        rows.append((doc_id, w["item_id"], start, length, matched))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "start", "length", "matched"), r)) for r in rows],
                                             schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("item_id", batch.schema.field("wanted").type.value_type.field("item_id").type),
                                                               ("start", pa.int32()), ("length", pa.int32()), ("matched", pa.int32())]))
    out = texts.join(wanted, "doc_id").mapInArrow(verify, f"doc_id {kind}, item_id {item_kind}, start int, length int, matched int")
    return out.distinct()


def op6_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark: contaminated, the items it overlaps and the longest overlap in tokens."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    found = stage(overlaps(docs, table(spark, sf_dir, "benchmark")))
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("longest"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("longest", F.lit(0)).alias("longest_overlap"))
