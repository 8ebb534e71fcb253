"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.session import ensure_checkpoint_dir

SALTS = 64
#: Texts that a task works on at once.
BATCH_ROWS = 1024
#: A filter of 2**BITMAP_LOG2 bits is 4 MB at most, whatever it is built from.
BITMAP_LOG2 = 25


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the written copy."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``small`` (one row per ``key``) to ``big``, whose keys may be hot.

    Each key of ``big`` is split by a hash of the row into ``salts`` parts, and ``small`` is repeated only
    for the parts that occur. ``big`` is read twice: give a table or a staged frame.
    """
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    parts = salted.select(key, "__salt").distinct().join(small, key)
    return salted.join(parts, [key, "__salt"], how).drop("__salt")


def utf8(text: str | None) -> bytes:
    """The bytes of a text; none for null."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space; ``lower`` maps A-Z only."""
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen so far; forgets them all beyond ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order, repeats included; the whole sequence if it is shorter."""
    if len(word_hashes) == 0:
        return np.empty(0, np.uint64)
    n = min(n, len(word_hashes))
    size = len(word_hashes) - n + 1
    out = np.full(size, np.uint64(n), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:i + size]
        out ^= out >> np.uint64(29)
    return mix(out)


def bitmap(hashes: DataFrame, column: str, log2: int = BITMAP_LOG2) -> bytes:
    """A bit for the low ``log2`` bits of every hash. Its size is fixed: 2**log2 / 8 bytes on the driver."""
    bit = F.col(column).bitwiseAND(F.lit((1 << log2) - 1))
    cells = (hashes.where(F.col(column).isNotNull()).select(bit.alias("b"))
             .groupBy(F.shiftright("b", 5).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v")))
    out = np.zeros((1 << log2) // 32, np.uint32)
    table = cells.toArrow()
    out[table["cell"].to_numpy()] = table["v"].to_numpy().astype(np.uint32)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap (``bits``: its uint32 cells)."""
    h = hashes.view(np.uint64) & np.uint64(len(bits) * 32 - 1)
    return (bits[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", parts: int = 8) -> DataFrame:
    """Join ``small`` (one row per ``key``) to ``big``, splitting every key by a hash of ``by`` into ``parts`` parts."""
    salted = big.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [key, "__part"], how).drop("__part")


def slices(batches: Iterable[pa.RecordBatch], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, at most ``most`` at a time: what is made of a batch is many times its size."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)


def pass_through(fn, columns: tuple[str, ...]):
    """A mapInArrow function: ``columns`` go through as they are, ``fn(texts)`` gives the further columns as a dict of arrays."""
    def run(batches_in):
        for batch in batches_in:
            extra = fn(batch.column("text").to_pylist())
            arrays = [batch.column(c) for c in columns] + [v if isinstance(v, pa.Array) else pa.array(v) for v in extra.values()]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *extra])
    return run


def may_be_in(listed: DataFrame, *columns: str) -> Column:
    """Whether a row's ``columns`` may be among those of ``listed``: always for listed rows, seldom for others.

    A bitmap of fixed size goes to the tasks, so rows that are surely not listed need no shuffle to a join.
    """
    bits = listed.sparkSession.sparkContext.broadcast(bitmap(listed.select(F.xxhash64(*columns).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def look(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(np.frombuffer(bits.value, np.uint32), h.to_numpy(np.int64)))
    return look(F.xxhash64(*columns))
