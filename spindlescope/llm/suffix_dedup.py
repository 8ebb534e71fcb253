"""Suffix-array de-duplication of bytes by a common-prefix-aware distributed merge sort.

Bytes go that lie in a LENGTH-byte string which also starts earlier. Every such string holds one *anchor*: the place among
its first LENGTH - PREFIX + 1 with the least hash of the PREFIX bytes that follow. Equal strings have their anchor at the
same place, so it is enough to sort the suffixes that start at anchors (about one in 35), and consecutive strings with the
same anchor travel as one record.

Tasks sort their suffixes and send them as front-coded runs: for each suffix only the length of the prefix shared with the one before
and the bytes that follow. A task per hash range merges its runs with a loser tree whose entries carry the length of the prefix they
share with the last suffix put out: the longer one wins unread, and only equal ones are compared, from that length on.

The first sort orders the PREFIX bytes at all anchors and finds those that repeat (each run sends a suffix once, however often
it occurs). The second sorts the whole records at repeated anchors and names the earliest place of each string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import bitmap, in_bitmap, mix, stage, table, utf8

LENGTH, PREFIX = 100, 32
#: Suffixes that a task sorts at a time, bytes per NumPy call, bits of the filter between the two sorts (16 MB).
RUN_SUFFIXES, CHUNK_BYTES, FILTER_LOG2 = 150_000, 500_000, 27
_BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the PREFIX bytes from each place on (PREFIX is a power of two: doubling)."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    while width < PREFIX:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base & (1 << 64) - 1
        width *= 2
    return mix(h)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key among ``width`` from each place on."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(raws: list[bytes], length: int = LENGTH):
    """(data, hashes, row, anchor, first, last): for each anchor, places in ``data`` of the first and last string that has it."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return data, np.empty(0, np.uint64), empty, empty, empty, empty
    hashes = prefix_hashes(data)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(keys, length - PREFIX + 1)
    row_of = np.repeat(np.arange(len(raws)), sizes)[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= ends[row_of])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return data, hashes, empty, empty, empty, empty
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return data, hashes, row_of[starts[first]], at[first], starts[first], starts[last]


def sorted_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of zero-padded byte rows as byte strings."""
    order = np.argsort(lengths, kind="stable")
    text = np.ascontiguousarray(rows[order]).view(f"S{rows.shape[1]}").ravel()
    return order[np.argsort(text, kind="stable")]


def shared_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        equal = rows[1:] == rows[:-1]
        stop = np.where(equal.all(axis=1), rows.shape[1], np.argmin(equal, axis=1))
        out[1:] = np.minimum(stop, np.minimum(lengths[1:], lengths[:-1]))
    return out


def front_code(rows: np.ndarray, lengths: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """A sorted run as bytes: shared lengths, lengths, the bytes that follow, and the columns that go with each suffix."""
    shared = shared_prefixes(rows, lengths)
    place = np.arange(rows.shape[1])
    rest = rows[(place >= shared[:, None]) & (place < lengths[:, None])]
    head = np.array([len(rows), len(rest), *[c.dtype.itemsize for c in columns]], np.int64)
    parts = [head.tobytes(), shared.astype(np.uint8).tobytes(), lengths.astype(np.uint8).tobytes(), rest.tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Run:
    """A front-coded run: suffixes one after the other, and its columns."""

    def __init__(self, blob: bytes, kinds: tuple):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        head = np.frombuffer(raw, np.int64, 2 + len(kinds))
        self.count, rest, at = int(head[0]), int(head[1]), 8 * (2 + len(kinds))
        self.shared, self.lengths = raw[at:at + self.count], raw[at + self.count:at + 2 * self.count]
        at += 2 * self.count
        self.rest, at = raw[at:at + rest], at + rest
        self.columns = []
        for kind in kinds:
            self.columns.append(np.frombuffer(raw, kind, self.count, at))
            at += self.count * np.dtype(kind).itemsize

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        text, at, rest = b"", 0, self.rest
        for shared, length in zip(self.shared, self.lengths):
            end = at + length - shared
            text = text[:shared] + rest[at:end]
            at = end
            yield shared, text


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int]]:
    """All suffixes in order: (length shared with the one before, suffix, run, place in the run).

    A tournament of losers. ``known[r]`` is what run r's head shares with the last suffix put out. Of two heads the one that
    shares more is smaller, unread, and the other's value stays true; only heads that share equally much are read, from there on.
    """
    size = len(runs)
    sources = [iter(r) for r in runs]
    heads, known, place = [b""] * size, [-1] * size, [-1] * size

    def advance(r: int) -> None:
        step = next(sources[r], None)
        if step is None:
            known[r] = -1  # loses against all
        else:
            known[r], heads[r] = step
            place[r] += 1

    def beats(a: int, b: int) -> bool:
        """Whether head a comes out before head b; the loser then knows what it shares with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka > kb
        if ka < 0:
            return a < b
        x, y, at = heads[a], heads[b], ka
        if x[at:] == y[at:]:
            loser = max(a, b)
            known[loser] = len(x)
            return a < b
        end = min(len(x), len(y))
        while at < end and x[at] == y[at]:
            at += 1
        first = at == len(x) or at < end and x[at] < y[at]
        known[b if first else a] = at
        return first

    for r in range(size):
        advance(r)
        if known[r] >= 0:
            known[r] = 0
    losers = [-1] * max(size, 1)
    # build: play all matches from the leaves up
    winner_at = [-1] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winner_at[2 * node], winner_at[2 * node + 1]
        w = a if beats(a, b) else b
        winner_at[node], losers[node] = w, b if w == a else a
    w = winner_at[1] if size > 1 else 0
    while size and known[w] >= 0:
        yield known[w], heads[w], w, place[w]
        advance(w)
        node = (w + size) >> 1
        while node:
            o = losers[node]
            ko, kw = known[o], known[w]
            if ko > kw or ko == kw and not beats(w, o):
                losers[node], w = w, o
            node >>= 1


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5DEECE66D)) % np.uint64(parts)).astype(np.int64)


def _raw_chunks(batches, columns: tuple[str, ...]):
    for batch in batches:
        raws = [utf8(t) for t in batch.column("text").to_pylist()]
        others = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        start = size = 0
        for i, r in enumerate(raws):
            size += len(r)
            if size >= CHUNK_BYTES or i + 1 == len(raws):
                yield raws[start:i + 1], [o[start:i + 1] for o in others]
                start, size = i + 1, 0


def _prefix_runs(parts: int, length: int):
    """Map side of the first sort: distinct prefixes of each run, and whether the run has them twice."""
    def ship(rows, hashes):
        part = _parts_of(hashes, parts)
        order = sorted_rows(rows, np.full(len(rows), PREFIX))
        rows, part = rows[order], part[order]
        again = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1)])
        first = np.flatnonzero(~again)
        twice = np.add.reduceat(again.astype(np.int64), first) > 0
        rows, part = rows[first], part[first]
        by = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by], np.arange(parts + 1))
        here = [p for p in range(parts) if bounds[p + 1] > bounds[p]]
        blobs = [front_code(rows[by[bounds[p]:bounds[p + 1]]], np.full(bounds[p + 1] - bounds[p], PREFIX), [twice[by[bounds[p]:bounds[p + 1]]].astype(np.uint8)]) for p in here]
        return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches):
        rows, hashes, count = [], [], 0
        for raws, _ in _raw_chunks(batches, ()):
            data, h, _, at, _, _ = anchors(raws, length)
            if len(at):
                rows.append(data[at[:, None] + np.arange(PREFIX)])
                hashes.append(h[at])
                count += len(at)
            if count >= RUN_SUFFIXES:
                yield ship(np.concatenate(rows), np.concatenate(hashes))
                rows, hashes, count = [], [], 0
        if count:
            yield ship(np.concatenate(rows), np.concatenate(hashes))
    return run


def _repeated_prefixes(frame: pd.DataFrame) -> pd.DataFrame:
    """Reduce side of the first sort: hashes of the prefixes that occur twice."""
    runs = [Run(b, (np.uint8,)) for b in frame["blob"]]
    found, last, said = [], b"", False
    for shared, text, r, i in merge(runs):
        same = shared == PREFIX
        said = said and same
        if not said and (same or runs[r].columns[0][i]):
            found.append(text)
            said = True
    if not found:
        return pd.DataFrame({"h": np.empty(0, np.int64)})
    h = np.concatenate([prefix_hashes(np.frombuffer(b"".join(found[a:a + 10_000]), np.uint8))[::PREFIX] for a in range(0, len(found), 10_000)])
    return pd.DataFrame({"h": h.view(np.int64)})


_RECORD = (np.int64, np.int64, np.int32, np.uint8)  # doc_id, tag, anchor, bytes from the anchor on
_SPAN = (np.int64, np.int64, np.int32, np.int32)


def _spans_blob(doc, tag, start, end) -> bytes:
    n = len(doc)
    parts = [np.array([n], np.int64).tobytes(), *[np.ascontiguousarray(x.astype(k)).tobytes() for x, k in zip((doc, tag, start, end), _SPAN)]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _read_spans(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in _SPAN:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _record_runs(shared_bits, parts: int, length: int):
    """Map side of the second sort. Of equal records in a run only the earliest is sent; the others are repeats already and go along as spans."""
    most = 2 * length - PREFIX

    def ship(rows, lengths, hashes, doc, tag, anchor, right):
        # equal records side by side, the earliest first
        order = sorted_rows(rows, lengths)
        new = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1) | (lengths[order][1:] != lengths[order][:-1]) | (right[order][1:] != right[order][:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        order = np.lexsort((anchor, tag, doc, right, rank))
        key = np.stack([rank[order], right[order]])
        first = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        kept = order[first]
        leader = kept[np.cumsum(first) - 1]
        itself = (doc[order] == doc[leader]) & (tag[order] == tag[leader]) & (anchor[order] == anchor[leader])
        gone = order[~itself]  # equal rows of the table are one text: its own place is no repeat
        part = _parts_of(hashes[kept], parts)
        by = kept[np.argsort(part, kind="stable")]
        bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        out = []
        for p in range(parts):
            rows_here = by[bounds[p]:bounds[p + 1]]
            if len(rows_here):
                out.append((p, 0, front_code(rows[rows_here], lengths[rows_here], [doc[rows_here], tag[rows_here], anchor[rows_here].astype(np.int32), right[rows_here].astype(np.uint8)])))
        if len(gone):
            start = anchor[gone] - (lengths[gone] - right[gone])
            out.append((int(mix(hashes[gone[:1]])[0] % np.uint64(parts)), 1, _spans_blob(doc[gone], tag[gone], start, anchor[gone] + right[gone])))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["part", "kind", "blob"])

    def run(batches):
        bits = np.frombuffer(shared_bits.value, np.uint32)
        held, count = [], 0
        for raws, (doc, tag) in _raw_chunks(batches, ("doc_id", "tag")):
            data, h, row, at, first, last = anchors(raws, length)
            hit = np.flatnonzero(in_bitmap(bits, h[at])) if len(at) else at
            if len(hit):
                row, at, first, last = row[hit], at[hit], first[hit], last[hit]
                right, left = last + length - at, at - first
                place = np.arange(most)
                source = np.where(place < right[:, None], at[:, None] + place, first[:, None] + place - right[:, None])
                inside = place < (right + left)[:, None]
                rows = np.where(inside, data[np.minimum(source, len(data) - 1)], 0).astype(np.uint8)
                starts = np.cumsum([0, *map(len, raws)])[:-1]
                held.append((rows, right + left, h[at], doc[row], tag[row], at - starts[row], right))
                count += len(at)
            if count >= RUN_SUFFIXES // 2:
                yield ship(*(np.concatenate(x) for x in zip(*held)))
                held, count = [], 0
        if count:
            yield ship(*(np.concatenate(x) for x in zip(*held)))
    return run


def _settle(group: list, length: int, out: list) -> None:
    """Spans of one group of records with equal PREFIX bytes: (doc, tag, anchor, bytes to the right, record), in any order."""
    if len(group) < 2:
        return
    group = sorted(set(group))  # equal rows of the table are one text
    texts: set = set()
    strings: set = set()
    for doc, tag, anchor, right, record in group:
        left = len(record) - right
        begin = anchor - left
        if (right, record) in texts:
            out.append((doc, tag, begin, anchor + right))
            continue
        texts.add((right, record))
        text = record[right:] + record[:right]
        start = None
        for i in range(len(text) - length + 1):
            s = (left - i, text[i:i + length])
            if s in strings:
                if start is None:
                    start = i
            else:
                strings.add(s)
                if start is not None:
                    out.append((doc, tag, begin + start, begin + i - 1 + length))
                    start = None
        if start is not None:
            out.append((doc, tag, begin + start, begin + len(text)))


def _repeat_spans(length: int):
    """Reduce side of the second sort: spans of strings that start earlier elsewhere."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        ready = [_read_spans(b) for b in frame.loc[frame["kind"] == 1, "blob"]]
        runs = [Run(b, _RECORD) for b in frame.loc[frame["kind"] == 0, "blob"]]
        group: list = []
        for shared, text, r, i in merge(runs):
            if shared < PREFIX:
                _settle(group, length, out)
                group = []
            c = runs[r].columns
            group.append((int(c[0][i]), int(c[1][i]), int(c[2][i]), int(c[3][i]), text))
        _settle(group, length, out)
        found = np.array(out, np.int64).reshape(-1, 4)
        cols = [np.concatenate([found[:, j], *[x[j] for x in ready]]) for j in range(4)]
        return pd.DataFrame({"doc_id": cols[0], "tag": cols[1], "start": cols[2].astype(np.int32), "end": cols[3].astype(np.int32)})
    return run


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and tag: 0, but a hash of the text where an id occurs more than once."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = stage(docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("twice")))
    if not twice.limit(1).count():
        return docs.withColumn("tag", F.lit(0).cast("long"))
    return docs.join(twice, "doc_id", "left").select("doc_id", "text", F.when(F.col("twice"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("tag"))


def repeated_spans(tagged: DataFrame, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """Spans (doc_id, tag, start, end) of bytes to remove; they may overlap. ``parts``: merging tasks, by default two per scan task."""
    spark = tagged.sparkSession
    parts = parts or max(2, 2 * tagged.rdd.getNumPartitions())
    sent = tagged.select("text").mapInArrow(_prefix_runs(parts, length), "part int, blob binary").repartition(parts, "part")
    repeats = stage(sent.groupBy("part").applyInPandas(_repeated_prefixes, "h long"))
    bits = spark.sparkContext.broadcast(bitmap(repeats, "h", FILTER_LOG2))
    sent = tagged.mapInArrow(_record_runs(bits, parts, length), "part int, kind int, blob binary").repartition(parts, "part")
    return sent.groupBy("part").applyInPandas(_repeat_spans(length), "doc_id long, tag long, start int, end int")


def _cut(raw: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what stays); ``spans`` may overlap or touch."""
    kept, at, removed, runs = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            kept.append(raw[at:start])
            runs, at = runs + 1, start
        if end > at:
            removed, at = removed + end - at, end
    return removed, runs, b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """Per row with an id: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Texts count as UTF-8 bytes, null as empty; strings never cross texts and are judged on the input. Earlier: smaller
    doc_id, or the same text and an earlier start; of different texts with one id the one with the smaller hash, equal
    rows are one text. Rows without an id are left out, other columns left behind.
    """
    tagged = _tagged(docs)
    spans = stage(repeated_spans(tagged, length, parts))
    per_text = stage(spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(per_text.select(F.xxhash64("doc_id", "tag").alias("h")), "h"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def pick(batches):
        cells = np.frombuffer(bits.value, np.uint32)
        for batch in batches:
            yield batch.select(["doc_id", "tag", "text"]).filter(pa.array(in_bitmap(cells, batch.column("h").to_numpy())))

    def rows(ids, raws, spans):
        found = [_cut(r, [(s["start"], s["end"]) for s in x or ()]) for r, x in zip(raws, spans)]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raws], pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                                           pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def untouched(batches):
        cells = np.frombuffer(bits.value, np.uint32)
        for batch in batches:
            b = batch.filter(pa.array(~in_bitmap(cells, batch.column("h").to_numpy())))
            raws = [utf8(t) for t in b.column("text").to_pylist()]
            yield rows(b.column("doc_id"), raws, [None] * len(raws))

    def cut(batches):
        for batch in batches:
            yield rows(batch.column("doc_id"), [utf8(t) for t in batch.column("text").to_pylist()], batch.column("spans").to_pylist())

    keyed = tagged.withColumn("h", F.xxhash64("doc_id", "tag"))
    # texts that surely have nothing to remove pass as they are read; only the others are shuffled to their spans
    touched = keyed.mapInArrow(pick, "doc_id long, tag long, text string").join(per_text, ["doc_id", "tag"], "left")
    return keyed.mapInArrow(untouched, schema).unionByName(touched.select("doc_id", "text", "spans").mapInArrow(cut, schema))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated 100-byte strings, as counts and a digest of what stays."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), by a set of all strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        raw, gone = utf8(text), []
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone.append((i, i + length))
            seen.add(s)
        removed, runs, kept = _cut(raw, gone)
        out[doc] = (len(raw), removed, runs, hashlib.sha256(kept).hexdigest())
    return out
