"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its own (hashed) embedding beside the mean embedding of its character 3- to 5-grams. Windows of
WINDOW words, half overlapping, each get a logit; a text's logit is their soft maximum, so one bad passage in a long text counts; what
many windows add to it is bounded.
Training (backpropagation and Adam, all in numpy) runs on a bounded sample of labelled rows; scoring runs in Spark
tasks over every window of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import mix, pass_through, slices, table
from spindlescope.llm.decontaminate import tokens

WINDOW, STRIDE = 16, 8
WORD_DIM, CHAR_DIM, HIDDEN = 8, 16, 12
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5)
#: Rows that the classifier is fitted on at most, by a hash of their id; among them texts of up to TRAIN_BYTES bytes.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_BYTES = 1000, 2000, 3000
#: Updates, whatever the sample's size: a small one is gone through more often.
STEPS, BATCH, RATE, SEED = 400, 32, 0.01, 7
SHARP, CROWD = 2.0, 64
#: Texts that a task takes out of a batch at once: a whole batch of them stands beside the heap.
TEXTS = 500
#: Words whose inputs a task keeps, and words per numpy call.
KEPT_WORDS, CHUNK_WORDS = 150_000, 60_000
BLOCK = 4096


def word_inputs(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its bucket; the buckets of its character n-grams, and how many each word has (with < and > around it)."""
    sizes = np.array([len(w) + 2 for w in found], np.int64)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in found), np.uint8).astype(np.uint64)
    word_of = np.repeat(np.arange(len(found)), sizes)
    grams, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + flat[i:i + len(h)] + np.uint64(1)
        inside = word_of[:len(h)] == word_of[n - 1:]
        grams.append((mix(h[inside]) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64))
        owners.append(word_of[:len(h)][inside])
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(found))
    # the word bucket: a hash over all letters, built from per-letter hashes and places
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = mix(flat + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    buckets = (mix(np.add.reduceat(letters, np.cumsum(sizes) - sizes)) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    return buckets, grams[order], counts


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window starts in the flat words, how many words it has, and the text it belongs to; one empty window for an empty text."""
    per_text = np.maximum(1, -(-np.maximum(sizes - WINDOW, 0) // STRIDE) + 1)
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = np.cumsum(sizes) - sizes
    return first[text_of] + nth * STRIDE, np.clip(sizes[text_of] - nth * STRIDE, 0, WINDOW), text_of


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    x, h = WORD_DIM + CHAR_DIM, HIDDEN
    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"words": rng.standard_normal((WORD_BUCKETS, WORD_DIM)).astype(np.float32) * np.float32(0.1),
         "chars": rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)).astype(np.float32) * np.float32(0.3)}
    for d in "fb":
        p |= {f"w{d}": draw(x, 3 * h), f"u{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
    return p | {"att": draw(2 * h, h), "attv": draw(h), "out": draw(2 * h), "bias": np.full(1, -2.0, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(x * np.float32(0.5)) + np.float32(1))


def run_direction(inputs: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """States of one direction for inputs (time, window, 3 * hidden); the state stands still where ``mask`` is 0."""
    steps, count, _ = inputs.shape
    h = np.zeros((count, HIDDEN), np.float32)
    states, kept = np.empty((steps, count, HIDDEN), np.float32), []
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(inputs[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(inputs[t, :, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if keep:
            kept.append((h, r, z, n, hu[:, 2 * HIDDEN:], m))
        h = h + m * (new - h)
        states[t] = h
    return states, kept


def back_direction(kept, d_states: np.ndarray, u: np.ndarray):
    """Gradients of the inputs and of ``u``."""
    d_inputs = np.empty((len(kept), d_states.shape[1], 3 * HIDDEN), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, n, hn, m = kept[t]
        d_h = d_h + d_states[t]
        d_new = d_h * m
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_inputs[t, :, :HIDDEN], d_inputs[t, :, HIDDEN:2 * HIDDEN], d_inputs[t, :, 2 * HIDDEN:] = d_r, d_z, d_n
        d_hu = np.concatenate([d_r, d_z, d_n * r], axis=1)
        d_u += h.T @ d_hu
        d_h = d_h * (1 - m) + d_new * z + d_hu @ u.T
    return d_inputs, d_u


def pool(p, states: np.ndarray, mask: np.ndarray):
    """Attention-pooled states per window, the attention and its inner layer; an empty window pools to zero."""
    inner = np.tanh(states @ p["att"])
    weight = np.exp(np.clip(inner @ p["attv"], -15, 15)) * mask
    weight = weight / np.maximum(weight.sum(axis=0), np.float32(1e-9))
    return np.einsum("tb,tbh->bh", weight, states), weight, inner


def window_logits(p, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window from its projected inputs (time, window, 3 * hidden) in both directions."""
    sf, kf = run_direction(forward, mask, p["uf"], keep)
    sb, kb = run_direction(backward[::-1], mask[::-1], p["ub"], keep)
    states = np.concatenate([sf, sb[::-1]], axis=2)
    pooled, weight, inner = pool(p, states, mask)
    return pooled @ p["out"] + p["bias"][0], (states, pooled, weight, inner, kf, kb)


def soft_maximum(logits: np.ndarray, starts: np.ndarray, text_of: np.ndarray):
    """Per text log(sum(exp(SHARP * logit))) / SHARP, but at most log(CROWD) / SHARP above the highest, and its derivative by each logit.

    Up to CROWD equal windows add to a text's logit, as in the texts learned from; beyond that length changes nothing.
    """
    top = np.maximum.reduceat(logits, starts)
    e = np.exp(SHARP * (logits - top[text_of]))
    total = np.add.reduceat(e, starts)
    highest = (e == 1).astype(float)
    full = (total > CROWD)[text_of]
    slope = np.where(full, highest / np.add.reduceat(highest, starts)[text_of], e / total[text_of])
    return top + np.log(np.minimum(total, CROWD)) / SHARP, slope


def gradients(p, ids: np.ndarray, mask: np.ndarray, text_of: np.ndarray, labels: np.ndarray, buckets, grams, counts):
    """Loss and gradients of a batch. ``ids``: (time, window) rows of the words whose inputs follow."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    x = np.concatenate([p["words"][buckets], np.add.reduceat(p["chars"][grams], starts, axis=0) / counts[:, None].astype(np.float32)], axis=1)
    xt = x[ids]
    forward, backward = xt @ p["wf"] + p["cf"], xt @ p["wb"] + p["cb"]
    logits, (states, pooled, weight, inner, kf, kb) = window_logits(p, forward, backward, mask, keep=True)
    first = np.searchsorted(text_of, np.arange(len(labels)))
    texts, slope = soft_maximum(logits.astype(np.float64), first, text_of)
    score = 1 / (1 + np.exp(-texts))
    loss = -np.mean(labels * np.log(score + 1e-9) + (1 - labels) * np.log(1 - score + 1e-9))
    d_logit = (slope * ((score - labels) / len(labels))[text_of]).astype(np.float32)
    g = {"bias": np.array([d_logit.sum()], np.float32), "out": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_states = weight[:, :, None] * d_pooled
    d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["attv"] = np.einsum("tb,tbk->k", d_raw, inner)
    d_inner = d_raw[:, :, None] * p["attv"] * (1 - inner * inner)
    g["att"] = np.einsum("tbh,tbk->hk", states, d_inner)
    d_states += d_inner @ p["att"].T
    d_f, g["uf"] = back_direction(kf, d_states[:, :, :HIDDEN], p["uf"])
    d_b, g["ub"] = back_direction(kb, d_states[::-1, :, HIDDEN:], p["ub"])
    d_b = d_b[::-1]
    width = x.shape[1]
    flat = xt.reshape(-1, width)
    g["wf"], g["wb"] = flat.T @ d_f.reshape(-1, 3 * HIDDEN), flat.T @ d_b.reshape(-1, 3 * HIDDEN)
    g["cf"], g["cb"] = d_f.sum(axis=(0, 1)), d_b.sum(axis=(0, 1))
    d_xt = (d_f @ p["wf"].T + d_b @ p["wb"].T).reshape(-1, width)
    order = np.argsort(ids.ravel(), kind="stable")
    used, at = np.unique(ids.ravel()[order], return_index=True)
    d_x = np.zeros_like(x)
    d_x[used] = np.add.reduceat(d_xt[order], at, axis=0)
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], buckets, d_x[:, :WORD_DIM])
    d_c = np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0)
    order = np.argsort(grams, kind="stable")
    used, at = np.unique(grams[order], return_index=True)
    g["chars"][used] = np.add.reduceat(d_c[order], at, axis=0)
    return loss, g


def laid_out(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (time, window) in the flat words (0 where there is none), their mask, and the text of each window."""
    start, length, text_of = windows_of(sizes)
    step = np.arange(WINDOW)[:, None]
    mask = step < length[None, :]
    return np.where(mask, start[None, :] + step, 0), mask.astype(np.float32), text_of


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fit the network to whole texts and their labels. Without toxic examples it answers "not toxic"."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    if not any(labels):
        p["out"][:], p["bias"][:] = 0, -5
        return p
    found, y = [tokens(t) for t in texts], np.array(labels, np.float64)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    queue = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(len(found))])
        rows, queue = queue[:BATCH], queue[BATCH:]
        flat = [w for i in rows for w in found[i]] or [b"\x00"]
        names = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        at, mask, text_of = laid_out(np.array([len(found[i]) for i in rows]))
        ids = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))[at]
        _, g = gradients(p, ids, mask, text_of, y[rows], *word_inputs(list(names)))
        norm = np.sqrt(sum(float((v.astype(np.float64) ** 2).sum()) for v in g.values()))
        clip, rate = np.float32(min(1.0, 1.0 / (norm + 1e-9))), RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v = v * clip
            m1[k] = np.float32(0.9) * m1[k] + np.float32(0.1) * v
            m2[k] = np.float32(0.99) * m2[k] + np.float32(0.01) * v * v
            p[k] = p[k] - np.float32(rate) * (m1[k] / np.float32(1 - 0.9 ** step)) / (np.sqrt(m2[k] / np.float32(1 - 0.99 ** step)) + np.float32(1e-6))
    return p


class Scorer(dict):
    """Word -> row of its projected inputs; scores whole texts."""

    def __init__(self, p: dict[str, np.ndarray]):
        super().__init__()
        self.p = p
        self.project, self.shift = np.concatenate([p["wf"], p["wb"]], axis=1), np.concatenate([p["cf"], p["cb"]])
        self.rows = np.empty((KEPT_WORDS + CHUNK_WORDS, 6 * HIDDEN), np.float32)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row

    def _ids(self, flat: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        self.fresh = []
        first = len(self)
        ids = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.fresh:
            buckets, grams, counts = word_inputs(self.fresh)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            chars = np.add.reduceat(self.p["chars"][grams], starts, axis=0) / counts[:, None].astype(np.float32)
            rows = np.concatenate([self.p["words"][buckets], chars], axis=1) @ self.project + self.shift
            if first + len(rows) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty((len(rows), 6 * HIDDEN), np.float32)])
            self.rows[first:first + len(rows)] = rows
        return ids

    def _score(self, found: list[list[bytes]]) -> np.ndarray:
        flat = [w for f in found for w in f] or [b"\x00"]
        ids = self._ids(flat)
        at, mask, text_of = laid_out(np.array([len(f) for f in found]))
        logits = np.empty(len(text_of))
        for a in range(0, len(text_of), BLOCK):
            x = self.rows[ids[at[:, a:a + BLOCK]]]
            logits[a:a + BLOCK], _ = window_logits(self.p, x[:, :, :3 * HIDDEN], x[:, :, 3 * HIDDEN:], mask[:, a:a + BLOCK])
        texts, _ = soft_maximum(logits, np.searchsorted(text_of, np.arange(len(found))), text_of)
        return 1 / (1 + np.exp(-texts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each whole text to be toxic."""
        out, start, size, held = np.empty(len(texts)), 0, 0, []
        for i, t in enumerate(texts):
            held.append(tokens(t))
            size += len(held[-1])
            if size >= CHUNK_WORDS or i + 1 == len(texts):
                out[start:i + 1] = self._score(held)
                start, size, held = i + 1, 0, []
        return out


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 when divided by 5; such rows are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """At most ``toxic_rows`` + ``clean_rows`` labelled rows (doc_id, text, y) that are not held out, by a hash of the id."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("y = 1").orderBy(*order).limit(toxic_rows).union(marked.where("y = 0").orderBy(*order).limit(clean_rows))
    return docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    rows = sorted(training_rows(docs, labels).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [int(r["y"]) for r in rows])


def score_texts(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    Null and empty texts have no words and get the score of an empty window. Ids may be null or repeat: each row gets
    a row. Only the text enters the score; other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(shared.value)
        yield from pass_through(lambda texts: {"score": pa.array(scorer.scores(texts), pa.float64())}, ("doc_id",))(slices(batches, TEXTS))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``; all columns stay, whatever their names, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches, TEXTS):
            scores = scorer.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(scores < threshold))
    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score by a network fitted to the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
