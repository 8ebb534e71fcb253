"""SentencePiece encoding and decoding by Gumbel top-k sampling without replacement.

A text is a lattice of pieces; its segmentations have the probabilities of a unigram model raised to THETA and
normalised. The search is a perturbed A*: the agenda holds sets of segmentations, each with the maximum of the Gumbel-perturbed
log-probabilities of its members. Since forward sums give the exact mass of every set, that maximum can be drawn before
its members are known, the best set is always the next one to open, and the first k segmentations that come out are
an exact sample of k distinct ones.

No piece runs over the start of a run of blanks or over a line end, so the lattice is a chain of small independent ones
(a word with the blanks before it). Their forward sums are kept by spelling, and one NumPy call walks many of them.
"""

from __future__ import annotations

import heapq
import importlib.util
import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import mix, table

#: Where the vocabulary lies if no path is given: the package of public tokenizers.
MODEL = "piece_bpe_32k.model"
SAMPLES, THETA, SEED = 2, 0.5, 11
#: Lattices kept between chunks of texts, and segments laid out at a time: they decide a worker's memory, not its results.
KEPT_SEGMENTS, CHUNK_SEGMENTS = 300_000, 24_000
#: Texts that are Python objects at a time.
TEXTS = 500
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
_ALL = (1 << 64) - 1
_STEP, _ROUND = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def model_path(path: str | None = None) -> str:
    """``path``, or the file of that name in the installed package of public tokenizers."""
    if path:
        return path
    found = importlib.util.find_spec("public_tokenizers")
    return f"{found.submodule_search_locations[0]}/{MODEL}" if found else f"/opt/tokenizers/{MODEL}"


class Vocabulary:
    """Pieces with blanks for the block sign, their log-probabilities and the bytes they stand for.

    The model ranks pieces by merge order; a piece of rank r gets a probability in proportion to 1 / (r + 2.7), runs of
    blanks and byte pieces the last rank.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids, self.bytes_of, rank = {}, [b""] * n, {}
        last = max((-sp.get_score(i) for i in range(n) if -sp.get_score(i) < 1e8), default=0)
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.ids[text], self.bytes_of[i], rank[text] = i, text.encode(), min(-sp.get_score(i), last)
        total = math.log(sum(1 / (r + 2.7) for r in rank.values()))
        self.log_p = {t: -math.log(r + 2.7) - total for t, r in rank.items()}
        self.byte_log_p = -math.log(last + 2.7) - total
        self.longest = max(map(len, self.ids), default=1)

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the blank that stands before every text is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def segments(text: str) -> list[str]:
    """The parts between which no piece reaches, the leading blank included; none for an empty text."""
    return _SEGMENT.findall(" " + text) if text else []


_P = np.uint64(0x100000001B3)
#: Small types: a task keeps about a hundred thousand lattices.
_ARRAYS = {"first": np.int32, "size": np.int32, "lo": np.int32, "hi": np.int32, "prev": np.int32, "id_at": np.int32, "id_n": np.int32, "cum": np.float32, "log_c": np.float64}


class Lattices(dict):
    """Segment -> number of its lattice; nodes and edges of all lattices in flat arrays.

    Node n of a lattice is a place in the segment; its edges come from earlier places, with the probability that a
    random segmentation, read from the end, takes them.
    """

    def __init__(self, vocabulary: Vocabulary, theta: float):
        super().__init__()
        self.v, self.theta = vocabulary, theta
        # per length: sorted hashes of all beginnings of pieces, the piece's id or -1, its log-probability
        self.tables = []
        for n in range(1, vocabulary.longest + 1):
            begins = sorted({p[:n] for p in vocabulary.ids if len(p) >= n})
            codes = np.array([[ord(c) for c in x] for x in begins], np.uint64).reshape(len(begins), n)
            h = np.zeros(len(begins), np.uint64)
            for i in range(n):
                h = h * _P + codes[:, i] + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([vocabulary.ids.get(x, -1) for x in begins], np.int64)[order],
                                np.array([vocabulary.log_p.get(x, 0.0) for x in begins])[order]))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.buffers = {name: np.empty(0, kind) for name, kind in _ARRAYS.items()}
        for name, buffer in self.buffers.items():
            setattr(self, name, buffer)
        self.hits = np.empty(0, np.int32)
        self.pool = np.arange(len(self.v.bytes_of), dtype=np.int32)  # a piece's ids are itself; those of unknown letters follow
        self.spelled: dict[int, int] = {}

    def _append(self, name: str, new: np.ndarray) -> None:
        """Add to an array inside its buffer, which doubles when it is full."""
        held, buffer = len(getattr(self, name)), self.buffers[name]
        if held + len(new) > len(buffer):
            grown = np.empty(max(2 * len(buffer), held + len(new)), buffer.dtype)
            grown[:held] = buffer[:held]
            buffer = self.buffers[name] = grown
        buffer[held:held + len(new)] = new
        setattr(self, name, buffer[:held + len(new)])

    def forget(self, most: int) -> None:
        """Drop the lattices met least often, so that at most ``most`` stay."""
        least = 2
        while int((self.hits >= least).sum()) > most:
            least *= 2
        keep = np.flatnonzero(self.hits >= least)
        nodes = self.size[keep].astype(np.int64) + 1
        node_from = self.first[keep].astype(np.int64)
        edge_from = self.lo[node_from].astype(np.int64)
        edges = self.hi[node_from + nodes - 1] - edge_from
        node_to, edge_to = np.cumsum(nodes) - nodes, np.cumsum(edges) - edges
        node_at = np.arange(nodes.sum()) + np.repeat(node_from - node_to, nodes)
        edge_at = np.arange(edges.sum()) + np.repeat(edge_from - edge_to, edges)
        shift = np.repeat(edge_to - edge_from, nodes)
        new = {"first": node_to, "size": self.size[keep], "lo": self.lo[node_at] + shift, "hi": self.hi[node_at] + shift}
        new |= {name: getattr(self, name)[edge_at] for name in _ARRAYS if name not in new}
        for name, kept in new.items():
            setattr(self, name, self.buffers[name][:0])
            self._append(name, kept)
        names = list(self)
        self.clear()
        self.update((names[n], i) for i, n in enumerate(keep.tolist()))
        self.hits = np.ones(len(keep), np.int32)

    def met(self, numbers: np.ndarray) -> None:
        """Count how often each lattice is used."""
        counts = np.bincount(numbers, minlength=len(self)).astype(np.int32)
        counts[:len(self.hits)] += self.hits
        self.hits = counts

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        self.fresh.append(segment)
        return number

    def _edges(self, codes: np.ndarray, room: np.ndarray):
        """(start, length, log-probability, place of the ids, number of ids) of all pieces that fit; ``room``: letters to the segment's end."""
        found, at, h = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n, (keys, ids, log_p) in enumerate(self.tables, 1):
            h = h * _P + codes[at + n - 1] + np.uint64(1)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            there = keys[k] == h
            whole = there & (ids[k] >= 0)
            if n == 1:
                lone = at[~whole]
            found.append((at[whole], np.full(whole.sum(), n), log_p[k[whole]], ids[k[whole]], np.ones(whole.sum(), np.int64)))
            going = there & (room[at] > n)
            at, h = at[going], h[going]
            if not len(at):
                break
        letters, where = np.unique(codes[lone], return_inverse=True)
        place, number = np.empty(len(letters), np.int64), np.empty(len(letters), np.int64)
        for i, c in enumerate(letters.tolist()):
            raw = chr(c).encode("utf-8", "surrogatepass")
            if c not in self.spelled:
                self.spelled[c] = len(self.pool)
                self.pool = np.append(self.pool, np.array([self.v.byte_ids[b] for b in raw], np.int32))
            place[i], number[i] = self.spelled[c], len(raw)
        found.append((lone, np.ones(len(lone), np.int64), self.v.byte_log_p * number[where], place[where], number[where]))
        return [np.concatenate(x) for x in zip(*found)]

    def add_fresh(self) -> None:
        """Lay out the lattices of the segments met since the last call."""
        if not self.fresh:
            return
        size = np.array([len(x) for x in self.fresh], np.int64)
        codes = np.frombuffer("".join(self.fresh).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.fresh = []
        letter0, node0 = np.cumsum(size) - size, np.cumsum(size + 1) - size - 1
        owner = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(codes)) - letter0[owner]
        start, length, log_p, id_at, id_n = self._edges(codes, size[owner] - local)
        seg, prev, end = owner[start], local[start], local[start] + length
        node = node0[seg] + end
        order = np.argsort(node, kind="stable")
        seg, prev, end, node, log_p, id_at, id_n = (x[order] for x in (seg, prev, end, node, log_p, id_at, id_n))
        total, longest = int((size + 1).sum()), int(size.max())
        mass, value = np.zeros(total), np.empty(len(node))
        # places of all lattices from left to right; narrow numbers sort by their digits
        turn = np.argsort(end.astype(np.int16) if longest < 1 << 15 else end, kind="stable")
        bounds = np.searchsorted(end[turn], np.arange(1, longest + 2))
        before, weight, after = node0[seg[turn]] + prev[turn], self.theta * log_p[turn], node[turn]
        for a, b in zip(bounds[:-1], bounds[1:]):
            here = mass[before[a:b]] + weight[a:b]
            first = np.flatnonzero(np.concatenate([[True], after[a + 1:b] != after[a:b - 1]]))
            counts = np.diff(np.append(first, b - a))
            top = np.maximum.reduceat(here, first)
            mass[after[a + first]] = top + np.log(np.add.reduceat(np.exp(here - np.repeat(top, counts)), first))
            value[turn[a:b]] = here
        log_c = value - mass[node]
        hi = np.cumsum(np.bincount(node, minlength=total))
        lo = np.concatenate([[0], hi[:-1]])
        upto = np.cumsum(np.exp(log_c))
        cum = upto - np.concatenate([[0.0], upto])[lo[node]]
        cum[hi[hi > lo] - 1] = 2.0
        nodes, edges = len(self.lo), len(self.prev)
        for name, new in (("first", node0 + nodes), ("size", size), ("lo", lo + edges), ("hi", hi + edges), ("prev", prev), ("id_at", id_at), ("id_n", id_n), ("cum", cum), ("log_c", log_c)):
            self._append(name, new)

    def other_path(self, number: int, excluded: list[tuple[int, ...]], draw) -> tuple[int, ...] | None:
        """A random segmentation (edges from the end) that is none of ``excluded``; None if there is no other."""
        base, place, path, live = int(self.first[number]), int(self.size[number]), [], list(excluded)
        while place:
            t, edges = len(path), range(int(self.lo[base + place]), int(self.hi[base + place]))
            weight = []
            for e in edges:
                w = math.exp(self.log_c[e])
                gone = sum(math.exp(sum(self.log_c[x] for x in p[t:])) for p in live if p[t] == e)
                weight.append(w - gone if w - gone > 1e-12 * w else 0.0)
            total = sum(weight)
            if total <= 0:
                return None
            u, pick = draw() * total, None
            for e, w in zip(edges, weight):
                if w > 0:
                    pick = e
                    u -= w
                    if u < 0:
                        break
            path.append(pick)
            live = [p for p in live if p[t] == pick]
            place = int(self.prev[pick])
        return tuple(path)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from 64-bit keys."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def uniform_of(key: int) -> float:
    """``uniform`` of one key."""
    h = key & _ALL
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _ALL
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _ALL
    return ((h ^ h >> 33) >> 11) * 2.0 ** -53 + 2.0 ** -54


def walk(lat: Lattices, numbers: np.ndarray, keys: np.ndarray):
    """A random segmentation of every segment: flat edges in text order, where each segment's start, log-probabilities."""
    lo, prev, cum, log_c = lat.lo, lat.prev, lat.cum, lat.log_c
    base, place = lat.first[numbers].astype(np.int64), lat.size[numbers]
    logs, steps, counts = np.zeros(len(numbers)), [], np.zeros(len(numbers), np.int64)
    active, at = np.arange(len(numbers)), place
    while len(active):
        u = uniform(keys[active] + np.uint64(len(steps) * int(_STEP) & _ALL))
        e = lo[base[active] + at].astype(np.int64)
        behind = np.flatnonzero(cum[e] < u)
        while len(behind):
            e[behind] += 1
            behind = behind[cum[e[behind]] < u[behind]]
        logs[active] += log_c[e]
        counts[active] += 1
        steps.append((active, e))
        at = prev[e]
        going = at > 0
        active, at = active[going], at[going]
    starts = np.concatenate([[0], np.cumsum(counts)])
    edges = np.empty(starts[-1], np.int64)
    for t, (active, e) in enumerate(steps):
        edges[starts[active] + counts[active] - 1 - t] = e
    return edges, starts, logs


class Search:
    """The k best perturbed segmentations of many texts at once."""

    def __init__(self, lat: Lattices, k: int):
        self.lat, self.k = lat, k

    def run(self, texts: list[str], seeds: np.ndarray):
        """Per text a list of (edges, log-probability, perturbed value), best first, and the value of the next one (None: there is none)."""
        lat, k = self.lat, self.k
        found = [segments(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        numbers = np.fromiter(map(lat.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        lat.add_fresh()
        lat.met(numbers)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        text_of = np.repeat(np.arange(len(texts)), sizes)
        nth = (np.arange(len(numbers)) - begin[text_of]).astype(np.uint64)
        step = int(_STEP)
        out: list[list] = [[] for _ in texts]
        # agendas: (-value, turn, place, excluded paths): all that agrees with that turn's path before the place and differs there
        agenda: list[list] = [[] for _ in texts]
        roots = -np.log(-np.log(uniform(mix(seeds ^ np.uint64(1)))))
        # a job: text, value, the part of the path that is given (edges, log-probability, segments)
        jobs = [(i, float(roots[i]), [], 0.0, 0) for i in range(len(texts))]
        paths: list[list] = [[] for _ in texts]
        for turn in range(k):
            if not jobs:
                break
            keep = np.zeros(len(numbers), bool)
            which = np.array([j[0] for j in jobs])
            given = np.zeros(len(texts), np.int64)
            given[which] = [j[4] for j in jobs]
            wanted = np.zeros(len(texts), bool)
            wanted[which] = True
            keep = wanted[text_of] & (nth >= given[text_of].astype(np.uint64))
            rows = np.flatnonzero(keep)
            keys = mix(seeds[text_of[rows]] + np.uint64(_ROUND * (turn + 1) & _ALL)) ^ (nth[rows] * np.uint64(0xA24BAED4963EE407))
            edges, starts, logs = walk(lat, numbers[rows], keys)
            ends = np.searchsorted(text_of[rows], which, "left"), np.searchsorted(text_of[rows], which, "right")
            noise = -np.log(uniform(keys ^ np.uint64(0x5851F42D4C957F2D)))
            for (i, value, head, head_log, place), a, b in zip(jobs, *ends):
                tail = edges[starts[a]:starts[b]]
                out[i].append((np.concatenate([np.asarray(head, np.int64), tail]), head_log + float(logs[a:b].sum()), value))
                paths[i].append((head_log, place, a, b, edges, starts, logs, len(head), out[i][-1][0]))
                if b > a:  # what differs first in one of the new segments
                    with np.errstate(divide="ignore"):
                        mass = head_log + np.cumsum(logs[a:b]) - logs[a:b] + np.log(-np.expm1(np.minimum(logs[a:b], 0)))
                    mass[logs[a:b] > -1e-12] = -np.inf
                    with np.errstate(over="ignore", invalid="ignore"):
                        perturbed = np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(mass - value) + noise[a:b]))
                    best = np.argpartition(-perturbed, k)[:k + 1] if len(perturbed) > k + 1 else np.arange(len(perturbed))
                    for s in best:
                        if perturbed[s] > -np.inf:
                            own = tuple(int(x) for x in edges[starts[a + s]:starts[a + s + 1]][::-1])
                            heapq.heappush(agenda[i], (-float(perturbed[s]), turn, place + int(s), [own], float(mass[s])))
            jobs = []
            if turn + 1 == k:
                break
            for i, todo in enumerate(agenda):
                if len(out[i]) != turn + 1 or not todo:
                    continue
                value, from_turn, place, excluded, _ = heapq.heappop(todo)
                counter = iter(range(1 << 30))
                key = int(seeds[i]) ^ ((turn + 1) << 40 | place << 8 | 0x77)

                def draw(key=key, counter=counter):
                    return uniform_of(key + next(counter) * step)
                number = int(numbers[begin[i] + place])
                path = lat.other_path(number, excluded, draw)
                if path is None:
                    jobs.append(None)
                    continue
                head_log, start, a, b, edges, starts, logs, head_n, whole = paths[i][from_turn]
                cut = head_n + int(starts[a + place - start] - starts[a])
                before = head_log + float(logs[a:a + place - start].sum())
                log_path = sum(lat.log_c[e] for e in path)
                rest = 1 - sum(math.exp(sum(lat.log_c[e] for e in p)) for p in [*excluded, path])
                if rest > 1e-12:
                    mass = before + math.log(rest)
                    again = mass - math.log(math.exp(min(mass + value, 700)) - math.log(draw()))
                    heapq.heappush(todo, (-again, from_turn, place, [*excluded, path], mass))
                jobs.append((i, -value, [*whole[:cut].tolist(), *path[::-1]], before + log_path, place + 1))
            jobs = [j for j in jobs if j]
        return [(o, -a[0][0] if a else None) for o, a in zip(out, agenda)]


def log_inclusion(log_p: float, threshold: float | None) -> float:
    """log of the probability that a segmentation is in the sample, given the perturbed value of the first one outside it."""
    if threshold is None:
        return 0.0
    x = log_p - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700))))


class Encoder:
    """Samples of whole texts; keeps the lattices of words it has met, up to a bound."""

    def __init__(self, path: str, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, kept: int = KEPT_SEGMENTS):
        self.lat, self.k, self.seed, self.kept = Lattices(Vocabulary(path), theta), k, seed, kept

    def encode(self, keys: list[str], texts: list[str | None]):
        """Per text its samples: (ids, log-probability, log inclusion score), in order of their perturbed values."""
        lat, k, out, start, size = self.lat, self.k, [], 0, 0
        seeds = np.array([xxhash.xxh64_intdigest(x, seed=self.seed) for x in keys], np.uint64)
        for i, t in enumerate(texts):
            size += (t or "").count(" ") + 1
            if size < CHUNK_SEGMENTS and i + 1 < len(texts):
                continue
            if len(lat) > self.kept:
                lat.forget(self.kept // 2)
            for best, threshold in Search(lat, k).run([x or "" for x in texts[start:i + 1]], seeds[start:i + 1]):
                at, n, pool = lat.id_at, lat.id_n, lat.pool
                rows = []
                for edges, log_p, _ in best:
                    counts = n[edges]
                    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    rows.append((pool[np.repeat(at[edges], counts) + within], log_p, log_inclusion(log_p, threshold)))
                out.append(rows)
            start, size = i + 1, 0
        return out


def encode_samples(docs: DataFrame, path: str | None = None, k: int = SAMPLES, theta: float = THETA, seed: int = SEED,
                   decoded: bool = False, kept: int = KEPT_SEGMENTS) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text: doc_id, sample (from 1), ids, log_prob, log_inclusion, text_hash.

    ``decoded`` adds the text of the ids as ``decode`` does, in the same pass: the ids need not go to a second worker. ``kept``: segments
    whose lattices a task keeps; fewer take more time and give the same rows.

    Random choices come from the row's doc_id and ``seed`` alone, so a task that runs again draws the same; rows that share an
    id and a text draw the same too. A null or empty text has one segmentation, without ids. A text with fewer than ``k``
    segmentations gives all of them, with log_inclusion 0. A null id is a key like any other. Other columns are left behind.
    """
    path = model_path(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(path, k, theta, seed, kept)
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                found = encoder.encode([str(x) for x in part.column("doc_id").to_pylist()], part.column("text").to_pylist())
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                ids = [ids for f in found for ids, _, _ in f]
                back = [pa.array([encoder.lat.v.decode(x.tolist()) for x in ids], pa.string())] if decoded else []
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), pa.array([s + 1 for f in found for s in range(len(f))], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]))),
                     pa.array([x for f in found for _, x, _ in f], pa.float64()), pa.array([x for f in found for _, _, x in f], pa.float64()),
                     part.column("h").take(pa.array(rows)), *back],
                    ["doc_id", "sample", "ids", "log_prob", "log_inclusion", "text_hash", *["decoded"][:len(back)]])
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.mapInArrow(run, f"doc_id {kind}, sample int, ids array<int>, log_prob double, log_inclusion double, text_hash long{', decoded string' if decoded else ''}")


def decode(samples: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``samples`` with ``decoded``, the text of the ids in ``column``; null ids decode to null."""
    path = model_path(path)

    @F.pandas_udf("string")
    def text_of(parts):
        import pandas as pd
        global _DECODER
        if _DECODER is None or _DECODER[0] != path:
            _DECODER = (path, Vocabulary(path))
        return pd.Series([None if p is None else _DECODER[1].decode(p) for p in parts], dtype=object)
    return samples.withColumn("decoded", text_of(F.col(column)))


_DECODER: tuple | None = None


def op8_sampled_segmentations(spark, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, and whether each decodes to the whole text again."""
    coded = encode_samples(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "sample", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion",
                        (F.xxhash64("decoded") == F.col("text_hash")).alias("decodes"))
