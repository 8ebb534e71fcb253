"""Main text of web pages: blocks of markup, then repeated token runs of each host found with suffix arrays.

1. A page is cut into blocks of text. A block is *marked* if it lies in an element that never holds the article (menu, header,
   footer, aside, form, script, style, advert, notice, comments), *held* if it lies in the page's article or main element,
   and *open* otherwise.
2. The blocks of all pages that are not marked, held ones too, are token streams. A task takes shards of the pages it reads, concatenates
   the streams of a shard, sorts their suffixes and counts the distinct pages of every run of RUN tokens, and of every whole block
   below RUN tokens, host by host. The counts of all shards are added up, so a run counts alike however many shards there are, and is
   then sought in all pages of the host.
3. Open blocks of which repeated runs cover more than half are boilerplate. Articles quote one another, so a held block needs more
   evidence: HELD_COVER of it must be runs that stand on HELD_SHARE of the host's pages, in HELD_TEXTS different texts.
4. What stays is the text. On a page with an article that is the held blocks, unless more words stay outside the article than in it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import WordHashes, bitmap, in_bitmap, may_be_in, shingle_hashes, slices, spread, stage, table, utf8
from spindlescope.llm.url_filter import host_of

#: Tokens of a run that counts as repeated, distinct pages it must be on, and pages and bytes of text that one shard takes.
RUN, LEAST_PAGES, SHARD_PAGES, SHARD_BYTES = 8, 3, 2048, 1 << 20
#: A block inside an article goes if this share of its tokens is runs on that share of the host's pages, in so many different texts.
HELD_COVER, HELD_SHARE, HELD_TEXTS = 0.8, 0.5, 10
#: Word hashes that a task keeps.
KEPT_WORDS = 100_000
#: Pages for which one more part of the runs is merged in a task of its own, and parts at least.
PART_PAGES, PARTS = 4096, 16
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_BLANK = re.compile(r"[ \t\n\r\f\v ]{2,}|[\t\n\r\f\v ]")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose inside is no text at all, or never part of an article.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
MARKED = frozenset("nav header footer aside form menu dialog select button head figcaption".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
BLOCKS = frozenset("""p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th thead tbody tfoot caption blockquote pre section article main
 figure address body html hr fieldset details summary center""".split()) | MARKED
#: Words in class, id or role that mark an element as something other than the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
 header footer sidebar aside cookie cookies consent notice popup modal newsletter subscribe comment comments share sharing social related
 widget search login contentinfo complementary""".split())


def _marked(name: str, attributes: str) -> bool:
    if name in MARKED:
        return True
    if "=" not in attributes:
        return False
    return any(w in MARKS for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(state, text) of every block with text, in page order; state: marked, held or open."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements and the state before each
    marked = held = False

    def close_block() -> None:
        if parts:
            text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip(" ")
            parts.clear()
            if text:
                out.append(("marked" if marked else "held" if held else "open", text))

    page, at = page or "", 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m[2].lower()
        if name in VOID:
            if name in BLOCKS:
                close_block()
            elif name == "br":
                parts.append(" ")
            continue
        if name in RAW and not m[1]:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        block = name in BLOCKS
        if block:
            close_block()
        if not m[1]:
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
                _, marked, held = stack.pop()
            is_marked = name not in ("body", "html") and _marked(name, m[3])
            if block or is_marked:
                stack.append((name, marked, held))
                marked, held = marked or is_marked, held or name in ("article", "main")
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, marked, held = stack[i]
                    del stack[i:]
                    break
    close_block()
    return out


def run_classes(flat: np.ndarray, owner: np.ndarray, left: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes with ``run`` tokens or more, sorted; where each class of equal beginnings starts; where a class meets another owner.

    ``left``: tokens from each place to the end of its stream. Suffixes are sorted by doubling ranks until ``run`` tokens decide; equal
    ranks then are runs with a common beginning of that length. Streams never run into each other.
    """
    total, none = len(flat), np.empty(0, np.int64)
    if not total:
        return none, none, none
    _, rank = np.unique(flat, return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        follow = np.full(total, -1, np.int64)
        inside = np.flatnonzero(left > step)
        follow[inside] = rank[inside + step]
        # the beginning of ``length`` tokens, then of the ``length`` tokens from ``step`` on: together length + step
        _, rank = np.unique(rank * (total + 2) + follow + 1, return_inverse=True)
        length += step
    order = np.lexsort((owner, rank))
    order = order[left[order] >= run]
    if not len(order):
        return none, none, none
    r, o = rank[order], owner[order]
    new_class = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_class | np.concatenate([[True], o[1:] != o[:-1]])
    return order, np.flatnonzero(new_class), new_page.astype(np.int64)


def _laid_out(streams: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All streams behind one another, the stream of each token, and the tokens from it to the stream's end."""
    sizes = np.array([len(s) for s in streams], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate(streams) if len(streams) else np.empty(0, np.int64)
    return flat, np.repeat(np.arange(len(streams)), sizes), np.repeat(ends, sizes) - np.arange(len(flat))


def counted_runs(streams: list[list[int]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``run`` tokens (one a row) and the distinct streams that hold each, by a suffix array over the concatenation."""
    flat, owner, left = _laid_out([np.asarray(s, np.int64) for s in streams])
    order, starts, new_page = run_classes(flat, owner, left, run)
    if not len(order):
        return np.empty((0, run), np.int64), np.empty(0, np.int64)
    return flat[order[starts][:, None] + np.arange(run)], np.add.reduceat(new_page, starts)


def repeated_runs(streams: list[list[int]], run: int, least_pages: int) -> set[tuple[int, ...]]:
    """Windows of ``run`` tokens that occur in ``least_pages`` distinct streams."""
    windows, pages = counted_runs(streams, run)
    return {tuple(w) for w in windows[pages >= least_pages].tolist()}


def _host_hash(host: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(utf8(host), seed=1))


def _tokens(text: str) -> list[bytes]:
    return utf8(text).split()


def _blocks_of(batch: pa.RecordBatch) -> tuple[list[list[str]], list[list[bool]]]:
    """Per page the blocks that are not marked, and which of them an article holds; from ``html``, unless they are there."""
    if "html" not in batch.schema.names:
        return batch.column("opens").to_pylist(), batch.column("inside").to_pylist()
    found = [[(s, t) for s, t in blocks(page) if s != "marked"] for page in batch.column("html").to_pylist()]
    return [[t for _, t in f] for f in found], [[s == "held" for s, _ in f] for f in found]


def block_table(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, opens (array of the blocks that are not marked, in page order), inside (which of them an article holds)."""
    return _with_blocks(pages, "page_id", "url")


def _with_blocks(pages: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of pages, opens and inside."""
    kinds = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in columns)

    def run(batches):
        for batch in batches:
            opens, inside = _blocks_of(batch)
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(opens, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.bool_()))],
                                             [*columns, "opens", "inside"])
    return pages.select(*columns, "html").mapInArrow(run, f"{kinds}opens array<string>, inside array<boolean>")


def placed_runs(flat: np.ndarray, sizes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of blocks that lie behind one another in ``flat``: block, place in it and key; a block below ``run`` tokens is one run."""
    starts = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - starts[block]
    whole = np.flatnonzero(sizes[block] - at >= run)
    parts = [(block[whole], at[whole], shingle_hashes(flat, run)[whole] if len(whole) else np.empty(0, np.uint64))]
    for n in range(run):
        short = np.flatnonzero(sizes == n)
        if len(short):
            tokens = flat[starts[short][:, None] + np.arange(n)].ravel()
            parts.append((short, np.zeros(len(short), np.int64), shingle_hashes(tokens, n)[::n] if n else np.zeros(len(short), np.uint64)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _salted(blocks_of: list[list[str]], hosts: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, mixed with the page's host, of all blocks of all pages; tokens of each block; page of each block."""
    found = [_tokens(t) for texts in blocks_of for t in texts]
    sizes, page = np.array([len(f) for f in found], np.int64), np.repeat(np.arange(len(blocks_of)), [len(b) for b in blocks_of])
    salts = {h: _host_hash(h) for h in set(hosts)}
    salt = np.array([salts[h] for h in hosts], np.uint64)[page] if len(hosts) else np.empty(0, np.uint64)
    return known.of([w for f in found for w in f]) ^ np.repeat(salt, sizes), sizes, page


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, list[str], list[bool]]]]:
    """(host, blocks, inside) of at most ``most`` pages and about SHARD_BYTES of text at a time."""
    out, size = [], 0
    for batch in slices(batches):
        for row in zip(batch.column("host").to_pylist(), *_blocks_of(batch)):
            if not row[1]:
                continue
            out.append(row)
            size += sum(map(len, row[1]))
            if len(out) >= most or size >= SHARD_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def _shard_runs(pages: list[tuple[str, list[str], list[bool]]], run: int, known: WordHashes) -> tuple[list[str], dict[str, np.ndarray]]:
    """Hosts of a shard, and its runs: host (its place), key, pages, cells, open.

    ``cells``: a bit per cell, out of 64, that the texts of these pages fall into; its bits never outnumber the different texts.
    """
    names = {h: i for i, h in enumerate(dict.fromkeys(p[0] for p in pages))}
    host = np.array([names[p[0]] for p in pages], np.int64)
    bits = np.uint64(1) << np.array([xxhash.xxh64_intdigest("\0".join(p[1]).encode("utf-8", "surrogatepass")) & 63 for p in pages], np.uint64)
    held = np.array([h for p in pages for h in p[2]], bool)
    flat, sizes, page = _salted([p[1] for p in pages], [p[0] for p in pages], known)
    ends = np.cumsum(sizes)
    block = np.repeat(np.arange(len(sizes)), sizes)
    order, starts, new_page = run_classes(flat, page[block], ends[block] - np.arange(len(flat)), run)
    # blocks below ``run`` tokens are classes by their keys
    short, _, key = placed_runs(flat[(sizes < run)[block]], np.where(sizes < run, sizes, 0), run)
    use = sizes[short] < run
    short, key = short[use], key[use]
    by = np.lexsort((page[short], key, host[page[short]]))
    short, key = short[by], key[by]
    of = page[short]
    new_key = np.diff(key, prepend=key[:1] + np.uint64(1)).astype(bool) | (np.diff(host[of], prepend=-1) != 0)
    firsts, new = np.flatnonzero(new_key), (new_key | (np.diff(of, prepend=-1) != 0)).astype(np.int64)
    out = []
    for at, first, fresh, keys, owner, inner in ((order, starts, new_page, shingle_hashes(flat, run), page[block], held[block]), (np.arange(len(short)), firsts, new, key, of, held[short])):
        if len(first):
            top = at[first]
            out.append({"host": host[owner[top]], "key": keys[top], "pages": np.add.reduceat(fresh, first), "cells": np.bitwise_or.reduceat(bits[owner[at]], first),
                        "open": np.logical_or.reduceat(~inner[at], first)})
    return list(names), {k: np.concatenate([o[k] for o in out]) if out else np.empty(0) for k in ("host", "key", "pages", "cells", "open")}


_PACKED = "part int, hosts array<string>, sizes array<int>, data binary"


def _packed(hosts: list[str], runs: dict[str, np.ndarray], parts: int) -> pa.RecordBatch:
    """One row per part of the keys: runs sorted by host and key, differences of keys byte by byte, and one byte for a run on a single page."""
    part = (runs["key"] % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((runs["key"], runs["host"], part))
    runs, part = {k: v[order] for k, v in runs.items()}, part[order]
    borders = np.flatnonzero(np.diff(part, prepend=-1))
    rows, zip_ = [], zstandard.ZstdCompressor(level=1)
    for a, b in zip(borders, [*borders[1:], len(part)]):
        key, many = runs["key"][a:b], runs["pages"][a:b] > 1
        cell = np.log2(runs["cells"][a:b].astype(float)).astype(np.uint8)
        mark = np.where(many, 64, cell).astype(np.uint8) | (runs["open"][a:b].astype(np.uint8) << 7)
        names, sizes = np.unique(runs["host"][a:b], return_counts=True)
        planes = np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        data = planes.tobytes() + mark.tobytes() + runs["pages"][a:b][many].tobytes() + runs["cells"][a:b][many].tobytes()
        rows.append((int(part[a]), [hosts[i] for i in names], sizes.tolist(), zip_.compress(data)))
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()))],
                                      ["part", "hosts", "sizes", "data"])


def _unpacked(size: int, data: bytes) -> dict[str, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    key = np.cumsum(np.ascontiguousarray(raw[:8 * size].reshape(8, size).T).view(np.uint64).ravel(), dtype=np.uint64)
    mark, rest = raw[8 * size:9 * size], raw[9 * size:].tobytes()
    many = mark & 64 > 0
    pages, cells = np.ones(size, np.int64), np.uint64(1) << (mark & 63).astype(np.uint64)
    n = int(many.sum())
    pages[many], cells[many] = np.frombuffer(rest, np.int64, n), np.frombuffer(rest, np.uint64, n, 8 * n)
    return {"key": key, "pages": pages, "cells": cells, "open": mark & 128 > 0}


def boilerplate_runs(opened: DataFrame, run: int = RUN, least_pages: int = LEAST_PAGES, shard_pages: int = SHARD_PAGES, parts: int = PARTS) -> DataFrame:
    """Runs (host, run_hash, pages, texts) of open blocks on ``least_pages`` pages of their host or more, and those in HELD_TEXTS different texts.

    ``opened``: host, and html or opens and, if articles hold some of the blocks, inside. A task counts its pages shard by shard, so none holds a whole
    large host; the runs of all shards then meet by parts of their keys, packed, since nearly every run of an article stands on one page.
    A page is in one shard only: the sum of the shards' counts is the number of pages. A block below ``run`` tokens is one run.
    ``texts`` is a lower bound up to 64.
    """
    inside = F.col("inside") if "inside" in opened.columns else F.transform("opens", lambda _: F.lit(False)) if "opens" in opened.columns else None
    columns = ["html"] if inside is None else ["opens", inside.alias("inside")]

    def count(batches):
        known = WordHashes(KEPT_WORDS)
        for pages in _shards(batches, shard_pages):
            hosts, runs = _shard_runs(pages, run, known)
            if len(runs["key"]):
                yield _packed(hosts, runs, parts)

    def merge(found: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        host, rest = [], []
        for hosts, sizes, data in zip(*(found.column(c).to_pylist() for c in ("hosts", "sizes", "data"))):
            host.append(np.repeat([names.setdefault(h, len(names)) for h in hosts], sizes))
            rest.append(_unpacked(sum(sizes), data))
        host = np.concatenate(host)
        runs = {k: np.concatenate([r[k] for r in rest]) for k in rest[0]}
        order = np.lexsort((host, runs["key"]))
        host, runs = host[order], {k: v[order] for k, v in runs.items()}
        starts = np.flatnonzero(np.diff(runs["key"], prepend=runs["key"][:1] + np.uint64(1)) | (np.diff(host, prepend=-1) != 0).astype(np.uint64))
        pages, cells = np.add.reduceat(runs["pages"], starts), np.bitwise_or.reduceat(runs["cells"], starts)
        texts = np.unpackbits(cells.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        kept = np.flatnonzero(np.logical_or.reduceat(runs["open"], starts) & (pages >= least_pages) | (texts >= HELD_TEXTS))
        listed = np.array(list(names), object)
        return pa.table({"host": pa.array(listed[host[starts[kept]]], pa.string()), "run_hash": pa.array(runs["key"][starts[kept]].view(np.int64)),
                         "pages": pa.array(pages[kept], pa.int64()), "texts": pa.array(texts[kept].astype(np.int64))})
    packed = opened.select(F.coalesce("host", F.lit("")).alias("host"), *columns).mapInArrow(count, _PACKED)
    return packed.groupBy("part").applyInArrow(merge, "host string, run_hash long, pages long, texts long")


def run_places(found: DataFrame, runs: DataFrame, run: int = RUN) -> DataFrame:
    """(key, hits): per page text the places of repeated runs, as an array of (block, ats).

    ``found``: host, key, html; ``runs``: host, run_hash, least (enough for an open block), everywhere (for a held one); stored.
    Bitmaps of both kinds let only possible places through to the join.
    """
    context = found.sparkSession.sparkContext
    maps = context.broadcast([bitmap(runs.where(c), "run_hash") for c in ("least", "everywhere")])

    def places(batches):
        known, bits = WordHashes(KEPT_WORDS), [np.frombuffer(m, np.uint32) for m in maps.value]
        live = [bool(b.any()) for b in bits]  # without a run that decides such blocks, they need no look
        for batch in slices(batches):
            (opens, inside), (host, key) = _blocks_of(batch), (batch.column(c).to_pylist() for c in ("host", "key"))
            number = [[b for b, h in enumerate(i) if live[h]] for i in inside]
            opens, inside = ([[v[b] for b in n] for v, n in zip(c, number)] for c in (opens, inside))
            held = np.array([h for i in inside for h in i], bool)
            flat, sizes, page = _salted(opens, host, known)
            block, at, hashes = placed_runs(flat, sizes, run)
            maybe = np.where(held[block], in_bitmap(bits[1], hashes), in_bitmap(bits[0], hashes))
            block, at, hashes = block[maybe], at[maybe], hashes[maybe]
            if len(block):
                places_of = np.array([b for n in number for b in n], np.int32)
                arrays = (pa.array([host[i] for i in page[block]], pa.string()), pa.array([key[i] for i in page[block]], pa.int64()), pa.array(places_of[block]),
                          pa.array(held[block]), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(list(arrays), ["host", "key", "block", "held", "at", "run_hash"])
    spread_runs = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    placed = found.select("host", "key", "html").mapInArrow(places, "host string, key long, block int, held boolean, at int, run_hash long")
    return (placed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(spread_runs, ["host", "run_hash", "part"])
            .where(F.when(F.col("held"), F.col("everywhere")).otherwise(F.col("least")))
            .groupBy("key", "block").agg(F.collect_set("at").alias("ats")).groupBy("key").agg(F.collect_list(F.struct("block", "ats")).alias("hits")))


def kept_text(opens: list[str], inside: list[bool], at: dict[int, list[int]], run: int = RUN) -> str:
    """The text of a page; ``at``: places of repeated runs by block."""
    kept, n = [], {True: 0, False: 0}
    for b, (text, held) in enumerate(zip(opens, inside)):
        size = len(_tokens(text))
        if b in at:
            covered = np.zeros(size + run, bool)
            for i in at[b]:
                covered[i:i + run] = True
            share = covered[:size].sum() / size if size else 1.0
            if share >= HELD_COVER if held else share > 0.5:
                continue
        kept.append((held, text))
        n[held] += size
    only = any(inside) and n[True] >= n[False]
    return "\n".join(t for held, t in kept if held or not only)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html); see the module.

    A null or empty html, or one without text, has the text "". Repeated rows and ids, and null ids and urls (host ""), are rows
    like any other. A page cut off in the middle is read to its end. Other columns are left behind. Pages are parsed in every pass, as
    their texts would take as much room as the input; rows of one host with the same html share a ``key``, and so their hits.
    """
    @F.pandas_udf("string")
    def kept(opens: pd.Series, inside: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([kept_text(list(o), list(i), {} if h is None else {x["block"]: x["ats"] for x in h}) for o, i, h in zip(opens, inside, hits)], dtype=object)

    parts = max(PARTS, 1 << (pages.count() // PART_PAGES).bit_length())
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64(host, "html").alias("key"))
    counted = boilerplate_runs(named.select("host", "html"), parts=parts)
    sizes = named.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    runs = stage(counted.join(sizes, "host").select("host", "run_hash", (F.col("pages") >= LEAST_PAGES).alias("least"),
                 ((F.col("texts") >= HELD_TEXTS) & (F.col("pages") >= HELD_SHARE * F.col("n"))).alias("everywhere")))
    hits = stage(run_places(named, runs))
    hit = may_be_in(hits, "key")
    without = _with_blocks(named.where(~hit), "page_id", "url").withColumn("hits", F.lit(None).cast(hits.schema["hits"].dataType))
    touched = spread(_with_blocks(named.where(hit), "page_id", "url", "key"), hits, "key", "page_id", "left").select(*without.columns)
    return without.unionByName(touched).select("page_id", "url", kept("opens", "inside", "hits").alias("text"))


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
