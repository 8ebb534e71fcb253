"""Periodic runs of words: block convolution at dyadic scales by an exact integer transform, then exact extensions.

A stretch with period q is found at the scale of q. There, every block of the text is compared with the window that follows it: the sum of
squared differences of word codes is formed for all distances at once, with a number-theoretic transform, so it is exact modulo a
prime. It is zero wherever the block comes again. Such a distance is a candidate period; the words themselves are compared
while it is extended in both directions, so a chance zero is dropped and the run's ends are exact.

Why nothing is missed: a run of period q and at least max(24, 3 q) words contains a whole aligned block and its copy q words on, if the
block has 8 words for q < 16, and the largest power of two up to q words else. Blocks above LARGEST words are cut to that size and
their windows are searched in pieces.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import table, words

LEAST = 24
FOLD = 3
#: 7 * 2**20 + 1, with primitive root 3: sums of 128 products stay below 2**53, so matrix products in doubles are exact.
PRIME, ROOT = 7340033, 3
DENSE = 128
BASE = 8
LARGEST = 4096
#: Doubles per array of a step, and bytes of text that are handled together (a longer text goes alone).
STEP = 1 << 19
GROUP_BYTES = 2 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def reduce(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, in place: whole numbers from 0 to 2**53."""
    q = np.floor(x * (1.0 / PRIME))
    q *= PRIME
    x -= q
    np.add(x, PRIME, out=x, where=x < 0)
    np.subtract(x, PRIME, out=x, where=x >= PRIME)
    return x


def _powers(root: int, exponents: np.ndarray, n: int) -> np.ndarray:
    """root ** exponents for a root of order ``n``."""
    table_of = np.empty(n)
    value = 1
    for i in range(n):
        table_of[i] = value
        value = value * root % PRIME
    return table_of[exponents % n]


@functools.lru_cache(maxsize=None)
def _plan(n: int, inverse: bool):
    """Matrices of a transform of size ``n``: one, or two with the factors between them."""
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    if n <= DENSE:
        return _powers(root, np.outer(np.arange(n), np.arange(n)), n), None, None
    a = DENSE
    b = n // a
    first = _powers(pow(root, b, PRIME), np.outer(np.arange(a), np.arange(a)), a)
    second = _powers(pow(root, a, PRIME), np.outer(np.arange(b), np.arange(b)), b)
    return first, _powers(root, np.outer(np.arange(a), np.arange(b)), n), second


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row; a power of two up to DENSE squared. The inverse is not divided by the size."""
    rows, n = x.shape
    first, between, second = _plan(n, inverse)
    if between is None:
        return reduce(x @ first)
    cells = reduce(np.matmul(first, x.reshape(rows, DENSE, n // DENSE)))
    cells *= between
    cells = reduce(np.matmul(reduce(cells), second))
    return np.ascontiguousarray(cells.transpose(0, 2, 1)).reshape(rows, n)


def scales(longest: int):
    """(least period, block size, distance between blocks, pieces of the window) per dyadic scale for texts of up to ``longest`` words."""
    yield 1, BASE, BASE, range(0, 2)
    size = 2 * BASE
    while FOLD * size <= longest:
        block = min(size, LARGEST)
        yield size, block, size, range(size // block, 2 * size // block)
        size *= 2


def occurrences(codes: np.ndarray, start: np.ndarray, size: np.ndarray, least: int, m: int, apart: int, pieces: range):
    """Where blocks of ``m`` words come again: (text, block's place, distance) of every zero sum of squared differences.

    ``codes``: word codes of texts that lie one after the other; ``start``, ``size``: per text. Blocks begin every ``apart``
    words; piece c of a window has the distances from c * m up to (c + 1) * m - 1.
    """
    found = []
    open_texts = np.flatnonzero(size >= max(LEAST, FOLD * least))
    if not len(open_texts):
        return [np.empty(0, np.int64)] * 3
    square = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(reduce(codes * codes).astype(np.int64), out=square[1:])
    blocks = -(-size[open_texts] // m)
    text = np.repeat(open_texts, blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = start[text] + number * m
    end = (start + size)[text]
    # one more block of zeros stands for what is behind a text's last one
    turned = np.zeros((len(text) + 2, 2 * m))
    rows = max(1, STEP // (2 * m))
    for a in range(0, len(text), rows):
        place = at[a:a + rows, None] + np.arange(m)
        padded = np.zeros((len(place), 2 * m))
        padded[:, :m] = np.where(place < end[a:a + rows, None], codes[np.minimum(place, len(codes) - 1)], 0)
        turned[a:a + len(padded)] = transform(padded)
    sign = np.where(np.arange(2 * m) % 2, -1.0, 1.0)
    scale = pow(2 * m, -1, PRIME)
    back = np.r_[0, np.arange(2 * m - 1, 0, -1)]
    heads = np.flatnonzero(number * m % apart == 0)
    j = np.arange(m)
    last = len(text)
    for c in pieces:
        ready = heads[at[heads] + m + max(c * m, 1) <= end[heads]]
        for a in range(0, len(ready), rows):
            k = ready[a:a + rows]
            near, far = k + c, np.where(k + c + 1 < last, k + c + 1, last)
            far = np.where(text[np.minimum(far, last - 1)] == text[k], far, last)
            window = turned[near] + sign * turned[far]
            window += PRIME
            product = transform(reduce(reduce(window) * turned[k][:, back]), inverse=True)[:, :m]
            product = reduce(product * scale).astype(np.int64)
            left = at[k, None] + c * m + j
            fits = (left + m <= end[k, None]) & (c * m + j >= 1)
            whole = (square[at[k] + m] - square[at[k]])[:, None] + square[np.minimum(left + m, len(codes))] - square[np.minimum(left, len(codes))]
            row, shift = np.nonzero(fits & ((whole - 2 * product) % PRIME == 0))
            found.append((text[k[row]], at[k[row]] - start[text[k[row]]], c * m + shift))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def _reach(same_from, most: int) -> int:
    """How far a comparison holds: ``same_from(a, b)`` compares places a to b; steps double."""
    done, step = 0, 64
    while done < most:
        b = min(most, done + step)
        bad = np.flatnonzero(~same_from(done, b))
        if len(bad):
            return done + int(bad[0])
        done, step = b, step * 2
    return most


def extend(w: np.ndarray, b: int, q: int, m: int):
    """The longest stretch with period ``q`` around the block at ``b``: (start, end); None if the block does not come again."""
    right = _reach(lambda x, y: w[b + x:b + y] == w[b + q + x:b + q + y], len(w) - q - b)
    if right < m:
        return None
    left = _reach(lambda x, y: w[b - y:b - x][::-1] == w[b + q - y:b + q - x][::-1], b)
    return b - left, b + q + right


def settle(w: np.ndarray, runs: list[tuple[int, int, int]], b: np.ndarray, q: np.ndarray, m: int) -> None:
    """Add the runs that a scale's candidates lead to; ``runs`` holds (start, length, period) of the smaller periods.

    A candidate inside a known run whose period divides its distance has the same longest stretch, so it is left out. Smaller
    distances go first, hence every period that is added is the smallest of its stretch.
    """
    order = np.lexsort((b, q))
    b, q = b[order], q[order]

    def outside(run):
        s, length, period = run
        return (b < s) | (b + m + q > s + length) | (q % period != 0)
    for run in runs:
        if run[1] >= m + q[0]:
            keep = outside(run)
            b, q = b[keep], q[keep]
            if not len(b):
                return
    while len(b):
        found = extend(w, int(b[0]), int(q[0]), m)
        if found is None:
            b, q = b[1:], q[1:]
            continue
        s, e = found
        period = int(q[0])
        if e - s >= max(LEAST, FOLD * period):
            runs.append((s, e - s, period))
            keep = outside(runs[-1])
        else:
            keep = (q != period) | (b < s) | (b + m + q > e)
        b, q = b[keep], q[keep]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) per sequence of word numbers, by start, then period."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(size) or size.max() < LEAST:
        return runs
    flat = np.concatenate(texts).astype(np.uint64)
    codes = (((flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(PRIME)).astype(np.float64)
    for least, m, apart, pieces in scales(int(size.max())):
        text, b, q = occurrences(codes, start, size, least, m, apart, pieces)
        order = np.argsort(text, kind="stable")
        text, b, q = text[order], b[order], q[order]
        at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else []
        for lo, hi in zip(at, [*at[1:], len(text)]):
            t = int(text[lo])
            settle(texts[t], runs[t], b[lo:hi], q[lo:hi], m)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


class Numbers(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def collapse(texts: list[str | None]):
    """Per text: number of words, its runs, and its words without all but the first period of each run."""
    numbers = Numbers()
    found = [words(t) for t in texts]
    coded = [np.fromiter(map(numbers.__getitem__, f), np.int64, len(f)) for f in found]
    out = []
    for f, runs in zip(found, runs_of(coded)):
        if runs:
            keep = np.ones(len(f), bool)
            for s, length, period in runs:
                keep[s + period:s + length] = False
            f_kept = [f[i] for i in np.flatnonzero(keep)]
        else:
            f_kept = f
        out.append((len(f), runs, b" ".join(f_kept)))
    return out


def groups(sizes: np.ndarray, most: int):
    """(start, end) of stretches whose sizes add up to about ``most``; at least one item each."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def _collapse_batches(batches):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        column = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for a, b in groups(sizes, GROUP_BYTES):
            done = collapse(column.slice(a, b - a).to_pylist())
            flat = np.array([r for _, runs, _ in done for r in runs], np.int64).reshape(-1, 3)
            ends = np.cumsum([0] + [len(runs) for _, runs, _ in done]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([n for n, _, _ in done], pa.int64()), lists,
                                              pa.array([t for _, _, t in done], pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of repeated words per text, and the text with every run cut down to its first period.

    ``docs``: doc_id, text. Returns one row per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the
    kept words joined by one space, as UTF-8 bytes). Words are runs of anything but ASCII white space. A run has at least
    max(24, 3 period) words, its period is the smallest, and no neighbouring word continues it. Null and empty texts have no
    words, no runs and an empty result; rows without an id and repeated rows are handled like others. Nothing is shuffled and
    a task holds one group of texts, or one long text, at a time. Other columns are left behind.
    """
    kept = docs.select("doc_id", "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed binary"
    return kept.mapInArrow(_collapse_batches, schema)


def tiled(doc_id: Column, text: Column) -> Column:
    """The text in which a tenth of the rows, by crc32 of the id, repeat a stretch of their words up to the end; null ids never do."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    times = (3 + F.pmod(g, F.lit(8))).cast("int")
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size(found)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / times)).cast("int")
    again = F.concat(F.slice(found, 1, a), F.flatten(F.array_repeat(F.slice(found, a + 1, p), times)))
    again = F.array_join(F.slice(again, 1, n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), again).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them tiled first, with digests of the runs and of what is kept."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", tiled(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = found.withColumn("best", best)
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def brute_force(w: list) -> list[tuple[int, int, int]]:
    """All runs of a short sequence by trying every period at every place."""
    runs: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // FOLD + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(LEAST, FOLD * q):
                runs.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def crc_of(doc_id: int) -> int:
    """The number that decides about tiling, outside Spark."""
    return zlib.crc32(str(doc_id).encode())
