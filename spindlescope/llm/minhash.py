"""Near-duplicates by circulant MinHash: two permutations make the whole signature, bands find candidates, full sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import WordHashes, attach, bitmap, in_bitmap, mix, pass_through, shingle_hashes, slices, stage, table, words
from spindlescope.llm.grouping import linked_groups
from spindlescope.llm.set_links import compare_chunks

BANDS, ROWS = 32, 4
PERCENT = 80
#: Shingles per numpy call.
CHUNK = 1 << 16
#: Words whose hashes a task keeps.
KNOWN_WORDS = 100_000
_SEED = np.uint64(0xD6E8FEB86659FD93)


def place(hashes: np.ndarray) -> np.ndarray:
    """First permutation: where a shingle lies on the circle of 2**32 places."""
    return (mix(hashes ^ _SEED) >> np.uint64(32)).astype(np.uint32)


def rank(places: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Second permutation of the circle, a bijection on 32 bits."""
    np.right_shift(places, 16, out=out)
    out ^= places
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out


def signatures(places: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Row per set: coordinate k is the least rank of the set after shifting the circle by k places."""
    out = np.empty((len(starts), coordinates), np.uint32)
    shifted, ranked = np.empty_like(places), np.empty_like(places)
    for k in range(coordinates):
        np.add(places, np.uint32(k), out=shifted)
        out[:, k] = np.minimum.reduceat(rank(shifted, ranked), starts)
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band; the same rows in different bands differ."""
    parts = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit number."""
    nibbles = (signature & np.uint32(15)).astype(np.uint64).reshape(len(signature), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def least_agreement(coordinates: int, percent: int) -> int:
    """Equal four-bit coordinates that a pair at the threshold has, less five standard deviations: it has fewer 3 times in ten million."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(coordinates * p - 5 * (coordinates * p * (1 - p)) ** 0.5)


def shingle_sets(texts: list[str | None], n: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    return [np.unique(shingle_hashes(known.of(words(t, lower=True)), n)) for t in texts]


def _describe(n: int, bands: int, rows: int):
    known = WordHashes(KNOWN_WORDS)

    def of(texts):
        sets = shingle_sets(texts, n, known)
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = [s.sum(dtype=np.uint64).tobytes() + mix(s).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(4, "little") for s in sets]
        keys, brief = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), bands * rows // 16), np.uint64)
        full = np.flatnonzero(sizes)
        at = 0
        while at < len(full):
            end, total = at, 0
            while end < len(full) and (end == at or total + sizes[full[end]] <= CHUNK):
                total += sizes[full[end]]
                end += 1
            rows_here = full[at:end]
            starts = np.concatenate([[0], np.cumsum(sizes[rows_here])[:-1]])
            signature = signatures(place(np.concatenate([sets[i] for i in rows_here])), starts, bands * rows)
            keys[rows_here], brief[rows_here] = bands_of(signature, bands, rows), sketches(signature)
            at = end
        def lists(matrix):
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * matrix.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.view(np.int64).ravel()))
        return {"n_shingles": sizes, "print": pa.array(prints, pa.binary()), "bands": lists(keys), "sketch": lists(brief)}
    return of


def describe(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set) and band keys of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        yield from pass_through(_describe(shingle, bands, rows), ("doc_id",))(slices(batches))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, print binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets (id, set) of the rows whose id is in ``ids``: a bitmap of fixed size picks rows as they are read, a join removes its false hits."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches):
        cells, known = np.frombuffer(bits.value, np.uint32), WordHashes(KNOWN_WORDS)
        for batch in slices(batches):
            at = np.flatnonzero(in_bitmap(cells, batch.column("h").to_numpy()))
            picked = batch.take(pa.array(at))
            sets = shingle_sets(picked.column("text").to_pylist(), shingle, known)
            lengths = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([picked.column("id"), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], ["id", "set"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h"), "text")
    return rows.mapInArrow(run, f"id {kind}, set array<long>").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents (doc_id, text) whose word-shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    One row per row with an id: doc_id, n_shingles, component_id (smallest doc_id of its group), kept (it is that one).
    Equal sets are one class from the start; classes that share a band are linked if their full sets are similar
    enough (64-bit shingle hashes). What pivots leave open is compared chunk against chunk in tasks. A pair at the threshold shares a band with probability 1 - (1 - 0.8**4)**32, all but
    5 in 100 million; before full sets travel, signatures must agree as far as such a pair does (all but 3 in 10 million). Texts without words (null, empty) have an empty set and stand alone. Rows that share an id are one
    document: each set it has links it. Rows without an id are left out, other columns left behind.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    told = stage(describe(docs, shingle, bands, rows))
    classes = stage(told.where("n_shingles > 0").groupBy("print").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = classes.select(F.explode("bands").alias("bucket"), "id")
    longs = bands * rows // 16
    notes = classes.select("id", F.struct("n", F.col("n").alias("c"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(longs)]).alias("note"))
    least = least_agreement(bands * rows, percent)

    def near(x, y):
        other = F.lit(0)
        for i in range(longs):
            d = x[f"s{i}"].bitwiseXOR(y[f"s{i}"])
            d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
            d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
            other = other + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
        # the common part of a linked pair is at least percent / (100 + percent) of both sizes together
        common = F.least(x["c"], y["c"]) * (100 + percent) >= (x["n"] + y["n"]) * percent
        return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & common & (other <= bands * rows - least)

    stored = []

    def tests(ids: DataFrame):
        sets = stage(full_sets(docs, ids, shingle))
        stored.append(sets)

        def sharpen(open_ids: DataFrame) -> DataFrame:
            """Notes with c, how many shingles of a set some other open set has too: no common part is larger."""
            flat = sets.join(open_ids, "id", "left_semi").select("id", F.explode("set").alias("g"))
            own = flat.groupBy("g").agg(F.min("id").alias("id"), F.max("id").alias("z")).where("id = z").groupBy("id").agg(F.count("*").alias("own"))
            new = notes.join(open_ids, "id", "left_semi").join(own, "id", "left").withColumn("c", F.col("note.n") - F.coalesce("own", F.lit(0)))
            return new.where(F.col("c") * 100 >= F.col("note.n") * percent).select("id", F.col("note").withField("c", F.col("c")).alias("note"))

        def verify(pairs: DataFrame) -> DataFrame:
            wide = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
            wide = wide.withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(64)))
            left = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(64)).alias("__salt")).distinct().join(
                sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
            both = wide.join(left, ["a", "__salt"]).withColumn("i", F.size(F.array_intersect("x", "y")))
            return both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b").distinct()

        return verify, sharpen

    roots = linked_groups(members, notes, near, tests, lambda rows: compare_chunks(rows, stored[0], percent))
    of_print = classes.select("print", "id").join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("root"))
    named = attach(told.select("doc_id", "n_shingles", "print"), of_print, "print")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS s FROM w),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
flat AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sized UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id WHERE reach.r < e.b),
root AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN root USING (doc_id)"""
