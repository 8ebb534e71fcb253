"""Fuzzy line de-duplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

Block keys travel once, with the SimHash and the length of their line; tasks read them in key order, compare the lines that share a key and send on
only pairs within MOST_BITS bits and 100 - PERCENT per cent of length: first a tree of them per key, which grows with the lines and not with their square
among near copies, then, once the trees' pairs are verified, all pairs between the components that a failed pair left apart. Keys that more
than DIRECT lines share, or that have more than CLOSE_EACH such open pairs a line, are compared by pivots.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import attach, bitmap, in_bitmap, may_be_in, mix, slices, stage, table, utf8
from spindlescope.llm.grouping import components, linked_groups

#: Lines are linked if their 64-bit SimHashes differ in at most this many bits and their edit similarity reaches PERCENT.
MOST_BITS = 3
PERCENT = 90
#: Five blocks: three differing bits leave two blocks equal, so the ten pairs of blocks (25 or 26 bits each) find every pair.
BLOCKS = 5
CHUNK = 1 << 16
#: Lines that share a key at most for all their pairs to be compared as they are read, and close pairs per line of a key at most.
DIRECT, CLOSE_EACH = 4096, 128
#: Rounds that compare along trees before all pairs that are still open are compared.
TREE_ROUNDS = 1
#: Texts and characters that a task splits at once: executors hold little beside their heap.
TEXTS, PIECE = 500, 1 << 21
_BLANK = b"\t\n\v\f\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = bytes(32 if b in _BLANK else 48 if 48 <= b < 58 else b for b in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]
#: Eight counters of a byte each, for every eighth bit of a hash.
_LANES, _LANE_MOST = np.uint64(0x0101010101010101), 255


def normalise(line: bytes) -> list[bytes]:
    """Words of a line: A-Z lower-cased, digits as 0, ASCII punctuation as blanks."""
    return line.lower().translate(_FOLD).split()


def lines_with_words(text: str | None) -> int:
    """How many lines of a text have a word."""
    return sum(map(bool, utf8(text).translate(None, _BLANK.replace(b"\n", b"")).split(b"\n")))


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit SimHash per run of word hashes: each bit is what most words have (0 on a tie).

    Bits are added up as bytes, eight to a number, over at most 255 words at a time.
    """
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        first, sizes = starts[at:end] - starts[at], ends[at:end] - starts[at:end]
        pieces = -(-sizes // _LANE_MOST)
        piece_at = np.cumsum(pieces) - pieces
        nth = np.arange(pieces.sum()) - np.repeat(piece_at, pieces)
        cuts = np.repeat(first, pieces) + nth * _LANE_MOST
        words = hashes[starts[at]:ends[end - 1]]
        for i in range(8):
            lanes = np.add.reduceat((words >> np.uint64(i)) & _LANES, cuts)
            counts = lanes.view(np.uint8).reshape(-1, 8)
            if len(cuts) > len(sizes):
                counts = np.add.reduceat(counts.astype(np.int64), piece_at, axis=0)
            most = np.ascontiguousarray(2 * counts.astype(np.int64) > sizes[:, None])
            out[at:end] |= most.view(np.uint64).ravel() << np.uint64(i)
        at = end
    return out


def block_keys(sims: np.ndarray, most_bits: int = MOST_BITS, blocks: int = BLOCKS) -> np.ndarray:
    """Keys of all choices of ``blocks`` - ``most_bits`` blocks; lines within ``most_bits`` bits agree in one of them at least."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), blocks - most_bits)):
        mask = sum(((1 << int(edges[b + 1])) - (1 << int(edges[b]))) for b in chosen)
        keys.append(mix((sims & np.uint64(mask)) ^ mix(np.array([c + 1], np.uint64))))
    return np.stack(keys, axis=1)


def _common(most: int, equal) -> int:
    """The greatest length up to ``most`` for which ``equal`` holds; it holds for all shorter ones."""
    low = 0
    while low < most:
        mid = (low + most + 1) // 2
        if equal(mid):
            low = mid
        else:
            most = mid - 1
    return low


def _two_letters(a: str) -> np.ndarray:
    """Counts of neighbouring letters, folded to 1,024 numbers."""
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((codes[:-1] * np.uint32(37) + codes[1:]) & np.uint32(1023), minlength=1024)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; one column is one long integer of bits."""
    if len(a) < len(b):
        a, b = b, a
    start = _common(len(b), lambda n: a[:n] == b[:n])
    a, b = a[start:], b[start:]
    end = _common(len(b), lambda n: a[len(a) - n:] == b[len(b) - n:])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score += 1 if right & top else -1 if left & top else 0
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(match | down | right)) & full, right & (match | down)
    return score


def close_sizes(a, b, longer, percent: int = PERCENT):
    """Whether lengths allow an edit similarity of ``percent`` / 100; ``longer``: the greater one. Numbers, arrays or columns."""
    return 100 * (longer - a) + 100 * (longer - b) <= (100 - percent) * longer


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    """Edit similarity, 1 - distance / longer length, of ``percent`` / 100 or more."""
    longer = max(len(a), len(b))
    if not close_sizes(len(a), len(b), longer, percent):
        return False
    # an edit takes away and adds two pairs of neighbouring letters at most
    if longer > 64 and 100 * int(np.abs(_two_letters(a) - _two_letters(b)).sum()) > 4 * (100 - percent) * longer:
        return False
    return 100 * edit_distance(a, b) <= (100 - percent) * longer


def _lines(texts: list[str | None]):
    """Flat arrays of every line with a word: (row, line number, normalised line, words); and all words, each with a blank behind, as Arrow binaries."""
    raws = [utf8(t) for t in texts]
    folded = np.frombuffer(b"\n".join([*raws, b""]).lower().translate(_FOLD_LINES), np.uint8)
    ends = np.flatnonzero(folded == 10)
    letters = (folded != 32) & (folded != 10)
    before = np.r_[False, letters[:-1]]
    starts = np.flatnonzero(letters & ~before)
    kept = letters | before  # one blank or line end behind each word
    plain = np.where(letters, folded, np.uint8(32))[kept]
    word_at = np.r_[0, np.flatnonzero(plain == 32) + 1]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_at.astype(np.int64)), pa.py_buffer(plain)])
    line = np.searchsorted(ends, starts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(line)])
    whole = plain.tobytes()
    joined = [whole[x:y] for x, y in zip(word_at[first].tolist(), (word_at[first + sizes] - 1).tolist())]
    # the lines of a text end where its bytes do
    text_ends = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raws]) - 1, "right")
    row = np.searchsorted(text_ends, line[first], "right")
    return row, (line[first] - np.r_[0, text_ends][row]).astype(np.int32), joined, sizes, words


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word, each distinct one hashed once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.buffers()[2].to_pybytes().split() if len(words) else []
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


def _pieces(batches):
    """The rows of ``batches`` in order, about PIECE bytes of text at a time; a longer text stands alone."""
    for batch in slices(batches, TEXTS):
        sizes = np.cumsum([len(t) if t is not None else 0 for t in batch.column("text").to_pylist()])
        cuts = np.r_[0, np.flatnonzero(np.diff(sizes // PIECE)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _hash_columns(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [xxhash.xxh3_128_intdigest(j) for j in joined]
    return (np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], np.uint64).view(np.int64),
            np.array([x >> 64 for x in both], np.uint64).view(np.int64))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, line (from 0), h and g (128 bits of the normalised line), sim, size (its characters)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in _pieces(batches):
            row, number, joined, sizes, found = _lines(batch.column("text").to_pylist())
            if not joined:
                continue
            h, g = _hash_columns(joined)
            sims = simhashes(_word_hashes(found), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            letters = np.fromiter((len(j) if j.isascii() else len(j.decode("utf-8", "replace")) for j in joined), np.int32, len(joined))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(number), pa.array(h), pa.array(g),
                                              pa.array(sims.view(np.int64)), pa.array(letters)], ["doc_id", "line", "h", "g", "sim", "size"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, h long, g long, sim long, size int")


def _near(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the row pairs (x, y) may be linked, as positions."""
    sims = rows["sim"].view(np.uint64)
    near = np.flatnonzero(np.bitwise_count(sims[x] ^ sims[y]) <= MOST_BITS)
    if not len(near):
        return near
    m, n = rows["size"][x[near]].astype(np.int64), rows["size"][y[near]].astype(np.int64)
    return near[close_sizes(m, n, np.maximum(m, n))]


def _steps(first: np.ndarray, sizes: np.ndarray):
    """(i, j, key) of all row pairs of each key, those one row apart first; a mask of keys, when sent, says which go on."""
    key = np.repeat(np.arange(len(first)), sizes)
    i = np.arange(len(key)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    end = np.repeat(first + sizes, sizes)
    step, on = 0, None
    while True:
        step += 1
        going = i + step < end
        if on is not None:
            going &= on[key]
        i, end, key = i[going], end[going], key[going]
        if not len(i):
            return
        on = yield i, i + step, key


def _close(rows: dict[str, np.ndarray], first: np.ndarray, sizes: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids (smaller first) of different roots among rows of one key that may be linked, and which keys have too many of them (their pairs are left out).

    Keys start at ``first`` and have ``sizes`` rows.
    """
    pairs, found, on = np.zeros(len(first), np.int64), [np.empty((3, 0), np.int64)], None
    steps = _steps(first, sizes)
    while True:
        try:
            x, y, key = steps.send(on)
        except StopIteration:
            break
        on, near = None, _near(rows, x, y)
        near = near[rows["root"][x[near]] != rows["root"][y[near]]]
        if len(near):
            found.append(np.stack([rows["id"][x[near]], rows["id"][y[near]], key[near]]))
            pairs += np.bincount(key[near], minlength=len(pairs))
            if (full := pairs > each * sizes).any():
                on = ~full
    many = pairs > each * sizes
    a, b, k = np.concatenate(found, axis=1)
    a, b = a[~many[k]], b[~many[k]]
    return np.minimum(a, b), np.maximum(a, b), many


def _trees(rows: dict[str, np.ndarray], first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_close``, but of the pairs of a key only as many as connect what all of them connect: less than its rows."""
    at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    key = np.repeat(np.arange(len(first)), sizes)
    order = np.lexsort((rows["root"][at], key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (rows["root"][at[order]][1:] != rows["root"][at[order]][:-1])] if len(at) else np.empty(0, bool)
    label = np.zeros(len(rows["id"]), np.int64)
    label[at[order]] = at[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    groups = np.bincount(key[order][new], minlength=len(first))
    a, b, on, steps = [], [], None, _steps(first, sizes)
    while True:
        try:
            x, y, key = steps.send(on)
        except StopIteration:
            break
        on, apart = None, np.flatnonzero(label[x] != label[y])
        if not len(apart):
            continue
        near = apart[_near(rows, x[apart], y[apart])]
        up: dict[int, int] = {}
        for i, j, k, s, t in zip(x[near].tolist(), y[near].tolist(), key[near].tolist(), label[x[near]].tolist(), label[y[near]].tolist()):
            while s in up:
                s = up[s]
            while t in up:
                t = up[t]
            if s != t:
                up[max(s, t)] = min(s, t)
                groups[k] -= 1
                a.append(i)
                b.append(j)
        if up:
            parent = np.arange(len(label))
            parent[list(up)] = list(up.values())
            while (above := parent[parent]).tobytes() != parent.tobytes():
                parent = above
            label = parent[label]
            on = groups > 1
    a, b = rows["id"][np.array(a, np.int64)], rows["id"][np.array(b, np.int64)]
    return np.minimum(a, b), np.maximum(a, b), np.zeros(len(first), bool)


def close_pairs(members: DataFrame, direct: int = DIRECT, each: int = CLOSE_EACH, *, trees: bool = False) -> DataFrame:
    """Pairs (a, b) of rows that share a bucket and may be linked, some more than once; (bucket, null) for buckets with more than ``direct`` rows or ``each`` pairs a row.

    ``members``: bucket, id, sim, size and, if it is there, root: rows of one root make no pair. ``trees``: of each bucket only pairs that
    connect what all its pairs connect, fewer than its rows; ``each`` does not matter then. A task reads its rows in the order of buckets
    and holds one batch and at most ``direct`` rows of the bucket that goes on.
    """
    names = ["bucket", "id", "sim", "size", *(["root"] if "root" in members.columns else [])]

    def run(batches):
        held, skipped = None, None

        def pairs(rows):
            rows = {"root": rows["id"]} | rows
            starts = np.flatnonzero(np.r_[True, rows["bucket"][1:] != rows["bucket"][:-1]])
            sizes = np.diff(np.r_[starts, len(rows["bucket"])])
            some = np.flatnonzero((sizes > 1) & (sizes <= direct))
            a, b, many = _trees(rows, starts[some], sizes[some]) if trees else _close(rows, starts[some], sizes[some], each)
            large = rows["bucket"][starts[np.r_[some[many], np.flatnonzero(sizes > direct)]]]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, large], pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(large), pa.int64())])], ["a", "b"])

        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if skipped is not None:
                rows = {n: v[rows["bucket"] != skipped] for n, v in rows.items()}
            if held is not None:
                rows = {n: np.concatenate([held[n], rows[n]]) for n in names}
            if not len(rows["bucket"]):
                continue
            last = int(np.searchsorted(rows["bucket"], rows["bucket"][-1]))
            if len(rows["bucket"]) - last > direct:  # the bucket that goes on is known to be large
                skipped, held = rows["bucket"][-1], None
                yield pairs(rows)
            else:
                held = {n: v[last:] for n, v in rows.items()}
                if last:
                    yield pairs({n: v[:last] for n, v in rows.items()})
        if held is not None:
            yield pairs(held)
    return members.select(*names).repartition("bucket").sortWithinPartitions("bucket", "sim").mapInArrow(run, "a long, b long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Normalised texts (h, g, norm) of the lines in ``wanted`` (h, g): a bitmap of fixed size picks lines as they are read."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "h"))

    def run(batches):
        cells = np.frombuffer(bits.value, np.uint32)
        for batch in _pieces(batches):
            _, _, joined, _, _ = _lines(batch.column("text").to_pylist())
            if not joined:
                continue
            h, g = _hash_columns(joined)
            at = np.flatnonzero(in_bitmap(cells, h))
            _, first = np.unique(np.stack([h[at], g[at]]), axis=1, return_index=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[at]), pa.array([joined[i].decode("utf-8", "replace") for i in at], pa.string())], ["h", "g", "norm"])
    found = docs.select("text").mapInArrow(run, "h long, g long, norm string")
    return found.join(wanted, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])


def duplicate_lines(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Lines (doc_id, line) that repeat an earlier line, exactly or nearly; earlier: smaller doc_id, then smaller line number.

    Lines with equal normalised text are one class. Classes are linked if their SimHashes differ in at most MOST_BITS bits and
    their edit similarity is at least PERCENT / 100; of each connected group the first occurrence stays. Lines without
    a word are never duplicates. Rows without an id are left out; rows that share an id are read as they come, their
    line numbers count per row. ``blocks``: more of them make longer keys and more keys, not other results.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    lines = stage(line_table(docs))
    classes = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), F.first("sim").alias("sim"),
                                           F.first("size").alias("size"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()))

    @F.pandas_udf("array<long>")
    def keys(sims: pd.Series) -> pd.Series:
        return pd.Series(list(block_keys(sims.to_numpy(np.int64).view(np.uint64), MOST_BITS, blocks).view(np.int64)))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.explode(keys("sim"))).select("bucket", "id", "sim", "size", *[c for c in rows.columns if c == "root"])

    def near(x, y):
        sizes = x["size"].cast("long"), y["size"].cast("long")
        return (F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= MOST_BITS) & close_sizes(*sizes, F.greatest(*sizes))

    def texts_of(ids: DataFrame) -> DataFrame:
        named = stage(classes.where(may_be_in(ids, "id")).select("id", "h", "g").join(ids, "id", "left_semi"))
        return stage(named.join(line_texts(docs, named.select("h", "g")), ["h", "g"]).select("id", "norm"))

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        half = pairs.join(texts.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b").withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(64)))
        other = half.select("a", "__salt").distinct().join(texts.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a")
        both = half.join(other, ["a", "__salt"])

        def run(batches):
            for batch in batches:
                ok = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def pivoted(rows: DataFrame, close: DataFrame) -> DataFrame | None:
        large = close.where("b IS NULL").select(F.col("a").alias("bucket"))
        if not large.limit(1).count():
            return None
        notes = classes.select("id", F.struct("sim", "size").alias("note"))

        def tests(ids: DataFrame):
            known = texts_of(ids)
            return (lambda pairs: verify(pairs, known)), None
        return linked_groups(keyed(rows).where(may_be_in(large, "bucket")).select("bucket", "id"), notes, near, tests).select(
            F.col("id").alias("a"), F.col("root").alias("b"))

    # near copies make pairs with the square of their number: trees of close pairs come first, then only pairs between what these left apart
    done = links = texts = None
    rows, turn = classes.select("id", "sim", "size"), 0
    while True:
        close = stage(close_pairs(keyed(rows), trees=turn < TREE_ROUNDS))
        pairs = close.where("b IS NOT NULL").distinct()
        pairs = stage(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        texts = texts_of(ends(pairs)) if texts is None else texts  # lines of later pairs are in pairs of the first round
        found = stage(verify(pairs, texts))
        links = found if links is None else links.unionByName(found)
        if (more := pivoted(rows, close)) is not None:
            links, texts = links.unionByName(stage(more)), None  # or come from pivots
        roots = components(links)
        turn += 1
        if turn > TREE_ROUNDS:
            break
        # a line that is apart from a close one is in a component at the end of a tree's pair that failed
        ways = close.where("b IS NOT NULL").distinct()
        for end in ("a", "b"):
            ways = ways.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        apart = stage(ways.where("ra != rb").select(F.explode(F.array("ra", "rb")).alias("root")).distinct())
        if not apart.limit(1).count():
            break
        ids = stage(roots.join(apart, "root", "left_semi").select("id", "root").union(apart.select("root", "root")).distinct())
        rows = stage(rows.where(may_be_in(ids, "id")).select("id", "sim", "size").join(ids, "id"))
    # a class of one line that is linked to nothing stays, so it does not travel
    some = classes.where((F.col("n") > 1) | may_be_in(roots, "id"))
    grouped = some.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # a group of classes may be large: its first occurrence comes from partial minima and goes back in parts
    first = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).where("all > 1")
    dup = stage(attach(stage(grouped.select("h", "g", "root")), first.select("root", "keep"), "root", "inner"))
    listed = lines.where(may_be_in(dup, "h", "g")).select("doc_id", "line", F.struct("h", "g").alias("key"))
    found = attach(listed, dup.select(F.struct("h", "g").alias("key"), "keep"), "key", "inner")
    return found.where(F.struct("doc_id", "line") != F.col("keep")).select("doc_id", "line").distinct()


def _without(text: str | None, gone) -> str | None:
    if text is None or gone is None or not len(gone):
        return text
    gone = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def drop_lines(docs: DataFrame, gone: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with those lines cut out of ``column``; other columns stay, whatever their names.

    Adds __lines (lines with a word before) and __gone (lines cut).
    """
    per_doc = stage(gone.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set("line")).alias("__cut")))
    # texts that surely lose no line pass as they are read; only the others are shuffled to their cuts
    touched = F.coalesce(may_be_in(per_doc.select(F.col("__id").alias("doc_id")), "doc_id"), F.lit(False))
    # cuts grow with the texts: they are never broadcast
    joined = docs.where(touched).join(per_doc.hint("merge"), F.col("doc_id") == F.col("__id"), "left").drop("__id").unionByName(
        docs.where(~touched).withColumn("__cut", F.lit(None).cast("array<int>")))

    @F.pandas_udf("text string, lines long, gone long")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = [_without(t, c) for t, c in zip(texts, cuts)]
        lines = [lines_with_words(t) for t in texts]
        return pd.DataFrame({"text": out, "lines": lines, "gone": [0 if c is None else len(c) for c in cuts]})

    return (joined.withColumn("__new", cut(F.col(column), F.col("__cut")))
            .withColumns({column: F.col("__new.text"), "__lines": F.col("__new.lines"), "__gone": F.col("__new.gone")}).drop("__new", "__cut"))


def op7_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document after line de-duplication: lines with a word, lines removed, length and SHA-256 of what stays (null text: as empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = drop_lines(docs, duplicate_lines(docs))
    kept = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"),
                       F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
