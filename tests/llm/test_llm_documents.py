"""Operators on ``documents``: brute force, edge cases and the pipeline's stages."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from spindlescope.llm import decontaminate, fuzzy_lines, grouping, minhash, quality, sampled_pieces, set_links, suffix_dedup, toxicity
from spindlescope.llm.common import WordHashes, table, words
from spindlescope.llm.grouping import components

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, h long, tag long, id long, set string, "
          "part int, root long, line int, spans string, bucket long, note long, wanted string")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, *[None] * 13) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "one two three four five six\nsame line here again\n" * 3),
         (7, "one two three four five six\nsame line here again\n" * 3), (7, "one two three four five six\nsame line here again\n" * 3),
         (8, "é😀 ▁ \x00 x\r\ny"), (None, "no id on this row at all"), (9, "x"), (10, "x")]


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# near-duplicates

def jaccard_groups(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = words(t, lower=True)
        sets.setdefault(d, []).append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a0, b0 = sorted((find(a), find(b)))
                root[b0] = a0
    return {d: find(d) for d in ids}


def mutated(seed, copies=30, size=60):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(size)]
    rows = []
    for i in range(copies):
        text = list(base)
        for _ in range(r.randrange(0, 9)):
            text[r.randrange(size)] = f"m{r.randrange(10 ** 6)}"
        rows.append((i + 100, " ".join(text)))
    return rows + [(i + 500, " ".join(f"u{r.randrange(9000)}" for _ in range(size))) for i in range(10)]


def test_near_duplicates_equal_brute_force(spark):
    rows = mutated(1) + [(d + 1000, t) for d, t in mutated(2)] + [(d, t) for d, t in EDGES if d is not None]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows), shingle=4).collect()}
    assert got == jaccard_groups(rows, 4, 80)


def test_hot_buckets_are_dealt_out_without_loss(spark, monkeypatch):
    monkeypatch.setattr(grouping, "HOT", 3)
    monkeypatch.setattr(grouping, "OPEN_PAIRS", 0)
    rows = mutated(4, copies=40)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows), shingle=4).collect()}
    assert got == jaccard_groups(rows, 4, 80)


@pytest.mark.parametrize("seed", [5, 6])
def test_chunks_of_a_bucket_are_compared_without_loss(spark, monkeypatch, seed):
    monkeypatch.setattr(grouping, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(grouping, "OPEN_PAIRS", 0)
    monkeypatch.setattr(set_links, "CHUNK_ELEMENTS", 300)
    rows = mutated(seed, copies=40)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows), shingle=4).collect()}
    assert got == jaccard_groups(rows, 4, 80)


@pytest.mark.parametrize("chunk", [10, 100, 10 ** 6])
def test_chunk_pairs_connect_what_links_connect(spark, monkeypatch, chunk):
    monkeypatch.setattr(set_links, "CHUNK_ELEMENTS", chunk)
    r = random.Random(chunk)
    base = r.sample(range(1000), 30)
    sets = {i: sorted({*r.sample(base, 30 - i % 9), *r.sample(range(2000, 9000), i % 4)}) for i in range(60)}
    root = {i: i - i % 2 if i < 10 else i for i in sets}
    rows = spark.createDataFrame([(b, i, (len(sets[i]),), root[i]) for b in (1, 2) for i in sets if i % 3 != b], "bucket long, id long, note struct<n: long>, root long")
    kept = spark.createDataFrame(list(sets.items()), "id long, set array<long>")
    found = {(x["a"], x["b"]) for x in set_links.compare_chunks(rows, kept, 80).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
             and any(a % 3 != k and b % 3 != k for k in (1, 2))}
    assert found <= links and len(found) < len(links)

    def groups(pairs):
        name = dict(root)
        for a, b in pairs:
            x, y = name[a], name[b]
            name = {k: x if v == y else v for k, v in name.items()}
        return {frozenset(k for k in name if name[k] == v) for v in name.values()}
    assert groups(found) == groups(links)


def test_common_counts_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(set_links, "COLUMNS", 7)
    r = random.Random(3)
    a, b = ([np.array(sorted(r.sample(range(-60, 60), r.randrange(1, 40)))) for _ in range(12)] for _ in range(2))
    assert set_links.common_counts(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_near_duplicates_on_edges(spark):
    got = minhash.near_duplicates(docs_of(spark, EDGES)).collect()
    assert len(got) == 11 and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9}
    assert {r["doc_id"]: r["n_shingles"] for r in got}[9] == 1
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_signature_bands_and_shared_bound(spark):
    keys = [np.arange(500, dtype=np.uint64) * np.uint64(7919), np.arange(40, 540, dtype=np.uint64) * np.uint64(7919)]
    s = minhash.signatures(minhash.place(np.concatenate(keys)), np.array([0, 500]), 128)
    share = (s[0] == s[1]).mean()
    assert abs(share - 460 / 540) < 0.12
    assert minhash.least_agreement(128, 80) < 128 * 0.8125


# lines

def line_groups(rows):
    found = [(d, k, b" ".join(w).decode(), w) for d, t in sorted(rows) for k, x in enumerate((t or "").encode().split(b"\n")) if (w := fuzzy_lines.normalise(x))]
    names = list(dict.fromkeys(f[2] for f in found))
    known = WordHashes()
    sims = {n: int(fuzzy_lines.simhashes(known.of(w), np.array([0]))[0]) for _, _, n, w in found}
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(names):
        for b in names[:i]:
            if (sims[a] ^ sims[b]).bit_count() <= fuzzy_lines.MOST_BITS and fuzzy_lines.similar(a, b):
                root[find(a)] = find(b)
    seen, gone = {}, set()
    for d, k, n, _ in found:
        r = find(n)
        if (d, k) != seen.setdefault(r, (d, k)):
            gone.add((d, k))
    return gone


def test_duplicate_lines_equal_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(40)) for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(5):
            line = r.choice(base).split()
            if r.random() < 0.6:
                line[r.randrange(len(line))] = f"q{r.randrange(50)}"
            lines.append(" ".join(line) + r.choice(["", "!", "  "]))
        rows.append((d, "\n".join(lines)))
    rows += [(d + 1000, t) for d, t in EDGES if d is not None]
    got = {(x["doc_id"], x["line"]) for x in fuzzy_lines.duplicate_lines(docs_of(spark, rows)).collect()}
    assert got == line_groups(rows)


def test_edit_distance_and_blocks():
    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(14))) for _ in "ab")
        assert slow(a, b) == fuzzy_lines.edit_distance(a, b)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), 3):
            y ^= 1 << bit
        keys = fuzzy_lines.block_keys(np.array([x, y], np.uint64))
        assert (keys[0] == keys[1]).any()


def test_close_pairs_are_those_of_all_buckets(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(9)]
    rows = []
    for i in range(700):
        sim = base[i % 9] ^ sum(1 << b for b in r.sample(range(64), r.randrange(3)))
        rows.append((i % 9 if i % 50 else 100 + i, i, sim - (1 << 64) if sim >> 63 else sim, r.randrange(20, 60)))
    rows += [(7_000_000_000, 5000 + i, 1, 5) for i in range(120)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] < 7_000_000_000 and a[1] < b[1]
            and ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count() <= fuzzy_lines.MOST_BITS and 100 * abs(a[3] - b[3]) <= 10 * max(a[3], b[3])}
    members = spark.createDataFrame(rows, "bucket long, id long, sim long, size int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(x) for x in fuzzy_lines.close_pairs(members, direct=100, each=1000).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (7_000_000_000, None) in got and sorted(g for g in got if g[1] is not None) == sorted(want) and want


def test_buckets_of_any_size_give_the_same_lines(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(900)}" for _ in range(60)]
    rows = [(d, "\n".join(" ".join([*base[:20 + 20 * (d % 2)], f"q{r.randrange(30)}", *base[40:]]) for _ in range(3))) for d in range(20)]
    want = line_groups(rows)
    found = fuzzy_lines.close_pairs(spark.createDataFrame([(1, i, 5, 9) for i in range(60)] + [(2, 70 + i, 5, 9) for i in range(3)], "bucket long, id long, sim long, size int"), each=8)
    assert sorted(map(tuple, found.fillna(-1).collect())) == [(1, -1), (70, 71), (70, 72), (71, 72)]
    for i in range(200):
        a = "".join(r.choice("abcdé ") for _ in range(r.randrange(60, 200)))
        b = "".join(r.choice("abcdé ") if r.random() < i / 800 else x for x in a)
        assert fuzzy_lines.similar(a, b) == (100 * fuzzy_lines.edit_distance(a, b) <= 10 * max(len(a), len(b)))
    monkeypatch.setattr(fuzzy_lines.close_pairs, "__defaults__", (3, 8))
    assert {(x["doc_id"], x["line"]) for x in fuzzy_lines.duplicate_lines(docs_of(spark, rows)).collect()} == want and want


def test_trees_make_few_pairs_and_lose_no_link(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(900)}" for _ in range(80)]
    orders = [base, base[40:] + base[:40], base[::-1]]  # the same SimHash, but no edit similarity
    rows = []
    for d in range(45):
        line = list(orders[d % 3])
        if d >= 3:
            line[r.randrange(80)] = f"q{r.randrange(8)}x"
        rows.append((d, " ".join(line)))
    want = line_groups(rows)
    assert {(x["doc_id"], x["line"]) for x in fuzzy_lines.duplicate_lines(docs_of(spark, rows)).collect()} == want and len(want) > 20
    members = spark.createDataFrame([(1, i, 5, 60) for i in range(400)] + [(2, i, 3 << i % 50, 60) for i in range(400)], "bucket long, id long, sim long, size int")
    trees = [tuple(x) for x in fuzzy_lines.close_pairs(members, trees=True).collect()]
    pairs = [tuple(x) for x in fuzzy_lines.close_pairs(members, each=1000).collect()]

    def roots(found):
        root = list(range(400))
        for a, b in found:
            x, y = root[a], root[b]
            root = [min(x, y) if v in (x, y) else v for v in root]
        return root
    assert len(trees) < 800 < len(pairs) and set(trees) <= set(pairs) and roots(trees) == roots(pairs[:1] + trees) == [0] * 400


def test_simhash_adds_bits_of_long_lines():
    r = np.random.default_rng(2)
    sizes = np.array([1, 2, 254, 255, 256, 511, 70_000, 3])
    hashes = r.integers(0, 1 << 64, sizes.sum(), dtype=np.uint64)
    hashes[::3] = hashes[0]
    starts = np.cumsum(sizes) - sizes
    want = [sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > len(part)) for part in np.split(hashes, starts[1:])]
    assert fuzzy_lines.simhashes(hashes, starts).tolist() == want
    for text in ("", None, "a\n\n b\n!!\n", "é\n\x00\n...\r\n x"):
        assert fuzzy_lines.lines_with_words(text) == sum(bool(fuzzy_lines.normalise(x)) for x in (text or "").encode().split(b"\n"))


def test_drop_lines_keeps_other_columns(spark):
    docs = docs_of(spark, EDGES)
    left = fuzzy_lines.drop_lines(docs, fuzzy_lines.duplicate_lines(docs))
    by = {(r["doc_id"], i): r for i, r in enumerate(left.orderBy("doc_id").collect())}
    assert set(docs.columns) <= set(left.columns) and left.count() == len(EDGES)
    six = next(r for (d, _), r in by.items() if d == 6)
    assert six["text"].split("\n")[:2] == ["one two three four five six", "same line here again"] and six["__gone"] == 4
    assert next(r for (d, _), r in by.items() if d is None)["text"] == "no id on this row at all"


# leaks

def test_overlaps_tolerate_substitutions(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"b{r.randrange(10 ** 6)}" for _ in range(n))) for i, n in enumerate((40, 20, 15, 8, 3))] + [(None, "x " * 30), (7, None), (0, "twice " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def filler(n):
        return " ".join(f"f{r.randrange(10 ** 6)}" for _ in range(n))
    changed = items[0][1].split()
    for i in range(4, 40, 8):
        changed[i] = "zzz"
    rows = [(1, f"{filler(30)} {items[0][1]} {filler(9)}"), (2, f"{filler(5)} {' '.join(changed).upper()}, {filler(5)}"), (3, filler(200)),
            (4, f"{filler(9)} {' '.join(items[1][1].split()[:6])} {filler(30)}"), (5, items[3][1]), (6, items[4][1]), (7, f"{items[2][1]}\n{items[1][1]}"), *EDGES[:3], (None, items[0][1])]
    rows = [(d if i < 7 else None if d is None else d + 50, t) for i, (d, t) in enumerate(rows)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 0), (5, 3), (7, 2), (7, 1)}
    assert decontaminate.overlaps(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(docs_of(spark, []), bench).count() == 0


def unhit(masks, least):
    """An alignment (1: equal) with ``least`` equal tokens that are 80 % of it and no mask, or None: the heaviest walk without a hit."""
    span = max(map(len, masks))
    weight, path, turn = {("", 0): 0}, {("", 0): ""}, [("", 0)]
    while turn:
        following = set()
        for s, m in turn:
            for bit in "10":
                body = s + bit
                if any(len(body) >= len(k) and all(x <= y for x, y in zip(k, body[-len(k):])) for k in masks):
                    continue
                t, w = (body[1 - span:], min(least, m + int(bit))), weight[s, m] + (1 if bit == "1" else -4)
                if w >= -60 and weight.get(t, -99) < w:
                    weight[t], path[t] = w, path[s, m] + bit
                    following.add(t)
                    if w >= 0 and t[1] == least:
                        return path[t]
        turn = list(following)
    return None


def test_masks_hit_every_alignment_that_counts():
    assert unhit(("1101100111", "1110010111", "1011101101"), 13)
    assert unhit(decontaminate.MASKS, 13) is None and unhit(decontaminate.SHORT_MASKS, 4) is None


def test_overlaps_with_every_allowed_substitution(spark):
    r = random.Random(19)
    sizes = [100, 100, 100, 100, 100, 16, 20, *range(5, 16)]
    items = [[f"c{r.randrange(10 ** 6)}" for _ in range(n)] for n in sizes]
    rows, want, d = [], set(), 0

    def plant(i, changed, counts=True):
        nonlocal d
        text = [f"z{d}x{k}" if k in changed else w for k, w in enumerate(items[i])]
        rows.append((d, " ".join([f"f{r.randrange(10 ** 6)}" for _ in range(7)] + text + [f"f{r.randrange(10 ** 6)}" for _ in range(7)])))
        if counts:
            want.add((d, i))
        d += 1
    for phase in range(5):
        plant(phase, set(range(phase, 100, 5)))
    for i, n in enumerate(sizes):
        if n > 20:
            continue
        for _ in range(60):
            plant(i, set(r.sample(range(n), n // 5)))
        plant(i, set(r.sample(range(n), n - decontaminate.least_equal(n) + 1)), counts=False)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(docs_of(spark, rows), bench).collect()} == want


# suffixes

def test_repeats_equal_brute_force(spark):
    r = random.Random(4)
    passage = ["".join(r.choice("ab cé\x00") for _ in range(r.randrange(60, 400))) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = ["".join(r.choice("xyz é") for _ in range(r.randrange(0, 200)))]
        for _ in range(r.randrange(4)):
            p = r.choice(passage)
            a = r.randrange(len(p) // 2)
            parts += [p[a:], "".join(r.choice("uvw") for _ in range(r.randrange(0, 9)))]
        rows.append((d, "".join(parts)))
    rows += [(d + 100, t) for d, t in EDGES if d is not None and d != 7] + [(300, "a" * 5000), (301, "ab" * 400), (302, "ba" * 400)]
    want = suffix_dedup.brute_force(rows)
    for parts in (None, 3):
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest())
               for x in suffix_dedup.remove_repeats(docs_of(spark, rows).repartition(5), parts=parts).collect()}
        assert got == want


def test_repeats_of_rows_that_share_an_id(spark):
    got = suffix_dedup.remove_repeats(docs_of(spark, [(1, "q" * 50 + LONG[:500]), (1, "q" * 50 + LONG[:500]), (1, LONG[:500]), (2, "z"), (None, LONG[:500])])).collect()
    assert sorted((x["doc_id"], x["n_bytes"]) for x in got) == [(1, 500), (1, 550), (1, 550), (2, 1)]
    removed = sorted((x["n_bytes"], x["n_removed"]) for x in got if x["doc_id"] == 1)
    assert removed in ([(500, 500), (550, 0), (550, 0)], [(500, 0), (550, 500), (550, 500)])
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_loser_tree_shares_and_order():
    r = random.Random(3)
    for _ in range(100):
        runs, every = [], []
        for _ in range(r.randrange(1, 6)):
            xs = sorted(bytes(r.choice(b"ab\x00") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 12)))
            sizes, rows = np.array([len(x) for x in xs]), np.zeros((len(xs), 9), np.uint8)
            for i, x in enumerate(xs):
                rows[i, :len(x)] = list(x)
            assert [xs[i] for i in suffix_dedup.sorted_rows(rows, sizes)] == xs
            runs.append(suffix_dedup.Run(suffix_dedup.front_code(rows, sizes, []), ()))
            every += xs
        got, before = list(suffix_dedup.merge(runs)), b""
        assert [g[1] for g in got] == sorted(every)
        for shared, text, _, _ in got:
            assert text[:shared] == before[:shared] and (shared == min(len(text), len(before)) or text[shared] != before[shared])
            before = text


# quality

def slow_model(texts):
    """Modified Kneser-Ney by dictionaries."""
    n, s = quality.ORDER, quality.SYMBOLS
    counts = Counter()
    for t in texts:
        symbols = [0] * (n - 1) + [int(quality.CLASSES[b]) for b in (t or "").encode()]
        for i in range(n - 1, len(symbols)):
            counts[tuple(symbols[i - n + 1:i + 1])] += 1
    levels = {n: counts}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: quality.discounts([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / s
        same = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        freed = sum(cuts[k][min(c, 3) - 1] for c in same.values())
        c = levels[k].get(g, 0)
        return ((c - cuts[k][min(c, 3) - 1]) / total if c else 0) + freed / total * p(g[1:])
    return p


def test_kneser_ney_equals_dictionaries(spark):
    texts = ["the cat sat on the mat", "the hat, the cat!", "über 42 cats\n\nsat", None, "", "banana bandana"]
    model = quality.fit_model(docs_of(spark, list(enumerate(texts))))
    p = slow_model(texts)
    r = random.Random(2)
    seen, _ = quality.symbols_of([t.encode() for t in texts if t])
    grams = [tuple(int(x) for x in seen[i:i + 4]) for i in range(len(seen) - 3) if seen[i + 3]] + [tuple(r.randrange(1, 48) for _ in range(4)) for _ in range(40)]
    got = quality.gram_log_probability(model, np.array([((a * 48 + b) * 48 + c) * 48 + d for a, b, c, d in grams]))
    assert np.allclose(got, [math.log(p(g)) for g in grams], atol=1e-9)


def base_counts(text):
    w = words(text)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


@tables
def test_quality_base_counts_and_verdicts(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()] + EDGES
    got = quality.quality_rules(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((d, *base_counts(t)) for d, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(docs_of(spark, [])).count() == 0


def test_bands_reject_noise_and_keep_prose(spark):
    r = random.Random(6)
    stems = ["ta", "re", "mo", "li", "sen", "dor", "val", "kin"]
    prose = [(i, " ".join("".join(r.choice(stems) for _ in range(3)) for _ in range(150))) for i in range(120)]
    noise = [(1000 + i, " ".join("".join(r.choice("qxzjvkwyf|#$0") for _ in range(6)) for _ in range(150))) for i in range(3)]
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(docs_of(spark, prose + noise)).collect()}
    assert all(got[i] for i, _ in prose) and not any(got[i] for i, _ in noise)


# toxicity

def toxic_rows(seed, n, insult=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = ["".join(r.choice(["ta", "re", "mo", "li", "sen", "dor"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 90))]
        bad = insult and i % 4 == 0
        if bad:
            text[r.randrange(len(text))] = "grobian" + r.choice(["", "o", "ta", "li"])
        rows.append((" ".join(text), int(bad)))
    return rows


def test_network_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(np.random.default_rng(0)).items()}
    found = [b"aa bb cc dd".split() * 6, b"ee ff".split(), [], b"gg aa ii".split() * 7]
    flat = [w for f in found for w in f]
    names = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    at, mask, text_of = toxicity.laid_out(np.array([len(f) for f in found]))
    args = (np.array([names[w] for w in flat])[at], mask, text_of, np.array([1.0, 0, 0, 1]), *toxicity.word_inputs(list(names)))
    _, g = toxicity.gradients(p, *args)
    for k in p:
        j = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        step = {a: b.copy() for a, b in p.items()}
        step[k][j] += 1e-4
        up, _ = toxicity.gradients(step, *args)
        step[k][j] -= 2e-4
        down, _ = toxicity.gradients(step, *args)
        assert abs((up - down) / 2e-4 - g[k][j]) < 1e-3 * max(1, abs(g[k][j]))


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 16, 17, 40, 100])
    start, length, text_of = toxicity.windows_of(sizes)
    for i, n in enumerate(sizes):
        covered = {int(s) + k - int(sizes[:i].sum()) for s, m in zip(start[text_of == i], length[text_of == i]) for k in range(m)}
        assert covered == set(range(n)) and (text_of == i).sum() >= 1


def test_network_learns_and_scores_edges(spark):
    rows = toxic_rows(1, 300)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], steps=150)
    fresh = toxic_rows(2, 200)
    scores = toxicity.Scorer(model).scores([t for t, _ in fresh])
    assert np.mean((scores >= 0.5) == [y for _, y in fresh]) > 0.95
    got = toxicity.score_texts(docs_of(spark, EDGES), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    long = " ".join(t for t, _ in toxic_rows(3, 400, insult=False))
    whole = toxicity.Scorer(model).scores([long, long + " grobian"])
    assert whole[1] > 0.5 > whole[0]
    kept = toxicity.drop_toxic(docs_of(spark, [*EDGES, (77, "ta re grobian mo")]), model)
    want = [(d, t) for d, t in [*EDGES, (77, "ta re grobian mo")] if toxicity.Scorer(model).scores([t])[0] < 0.5]
    assert kept.columns == docs_of(spark, []).columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)
    assert (2, "") in want and (77, "ta re grobian mo") not in want
    none = toxicity.train(["a"], [0])
    assert (toxicity.Scorer(none).scores(["a", None, ""]) < 0.5).all()


@tables
def test_pooling_bounds_what_length_adds_and_keeps_single_high_windows():
    def pooled(logits):
        return toxicity.soft_maximum(logits, np.array([0]), np.zeros(len(logits), int))[0][0]
    limit = np.log(toxicity.CROWD) / toxicity.SHARP
    assert pooled(np.full(1_000_000, -6.0)) == pytest.approx(-6.0 + limit)
    assert pooled(np.full(5, -6.0)) == pytest.approx(-6.0 + np.log(5) / toxicity.SHARP)
    spiked = np.full(1_000_000, -6.0)
    spiked[777] = 6.0
    assert 6.0 <= pooled(spiked) <= 6.0 + limit
    for logits in (np.array([0.3, -1.0, 0.2]), np.concatenate([[0.9], np.full(200, 0.3)])):
        _, slope = toxicity.soft_maximum(logits, np.array([0]), np.zeros(len(logits), int))
        for i in range(3):
            step = np.where(np.arange(len(logits)) == i, 1e-6, 0)
            assert slope[i] == pytest.approx((pooled(logits + step) - pooled(logits - step)) / 2e-6, abs=1e-5)


def test_length_alone_makes_no_text_toxic():
    rows = toxic_rows(1, 300)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], steps=150)
    clean = " ".join(t for t, _ in toxic_rows(4, 3000, insult=False)).split()
    text = " ".join(clean * (1 + 1_000_000 // len(clean)))
    scores = toxicity.Scorer(model).scores([text, text + " grobian " + text[:1000]])
    assert len(text.split()) >= 1_000_000 and scores[0] < 0.5 < scores[1]


def test_scores_equal_a_plain_pass_over_every_window():
    rows = toxic_rows(1, 60)
    p = toxicity.train([t for t, _ in rows], [y for _, y in rows], steps=20)
    texts = [t for t, _ in toxic_rows(5, 12)] + ["", "one", " ".join(t for t, _ in toxic_rows(6, 9))]

    def sig(x):
        return 1 / (1 + np.exp(-x))

    def states(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            i, u = np.split(x @ p[f"w{d}"] + p[f"c{d}"], 3), np.split(h @ p[f"u{d}"], 3)
            r, z = sig(i[0] + u[0]), sig(i[1] + u[1])
            n = np.tanh(i[2] + r * u[2])
            h = n + z * (h - n)
            out.append(h)
        return out

    for text, score in zip(texts, toxicity.Scorer(p).scores(texts)):
        words, logits, a = toxicity.tokens(text), [], 0
        while True:
            xs = []
            for w in words[a:a + toxicity.WINDOW]:
                bucket, grams, _ = toxicity.word_inputs([w])
                xs.append(np.concatenate([p["words"][bucket[0]], p["chars"][grams].mean(axis=0)]).astype(float))
            pooled = np.zeros(2 * toxicity.HIDDEN)
            if xs:
                both = np.concatenate([states(xs, "f"), states(xs[::-1], "b")[::-1]], axis=1)
                weight = np.exp(np.clip(np.tanh(both @ p["att"]) @ p["attv"], -15, 15))
                pooled = weight @ both / weight.sum()
            logits.append(pooled @ p["out"] + p["bias"][0])
            a += toxicity.STRIDE
            if a + toxicity.WINDOW - toxicity.STRIDE >= len(words):
                break
        assert score == pytest.approx(sig(np.log(np.exp(toxicity.SHARP * np.array(logits)).sum()) / toxicity.SHARP), abs=1e-4)


def test_training_leaves_held_out_rows_alone(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    rows = toxicity.training_rows(docs, labels).collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert toxicity.training_rows(docs, labels.limit(0)).count() == 0


# pieces

def all_segmentations(lat, text):
    found = [((), 0.0)]
    for s in sampled_pieces.segments(text):
        number = lat[s]
        lat.add_fresh()
        base = int(lat.first[number])

        def back(place, base=base):
            if place == 0:
                return [((), 0.0)]
            return [(p + (e,), x + float(lat.log_c[e])) for e in range(int(lat.lo[base + place]), int(lat.hi[base + place])) for p, x in back(int(lat.prev[e]))]
        found = [(a + b, x + y) for a, x in found for b, y in back(int(lat.size[number]))]
    return dict(found)


@pytest.fixture(scope="module")
def vocabulary():
    path = sampled_pieces.model_path()
    if not Path(path).exists():
        pytest.skip("no vocabulary file")
    return path


def test_samples_without_replacement_have_the_right_odds(vocabulary):
    lat, text, n = sampled_pieces.Lattices(sampled_pieces.Vocabulary(vocabulary), 0.5), "ab cat", 6000
    odds = all_segmentations(lat, text)
    assert abs(sum(map(math.exp, odds.values())) - 1) < 1e-9
    first, weight = Counter(), 0.0
    seeds = np.random.default_rng(5).integers(0, 1 << 63, n).astype(np.uint64)
    for a in range(0, n, 1000):
        for best, threshold in sampled_pieces.Search(lat, 3).run([text] * 1000, seeds[a:a + 1000]):
            paths = [tuple(b[0].tolist()) for b in best]
            assert len(set(paths)) == 3 and best[0][2] >= best[1][2] >= best[2][2] >= threshold
            assert all(abs(b[1] - odds[p]) < 1e-9 for b, p in zip(best, paths))
            first[paths[0]] += 1
            weight += sum(math.exp(b[1] - sampled_pieces.log_inclusion(b[1], threshold)) for b in best)
    assert max(abs(first[p] / n - math.exp(x)) for p, x in odds.items()) < 0.03
    assert abs(weight / n - 1) < 0.03  # inclusion scores make the sample's weighted total unbiased


def test_samples_exhaust_small_texts_and_round_trip(spark, vocabulary):
    whole = sampled_pieces.Encoder(vocabulary, k=50)
    got = whole.encode(["x"], ["ab"])[0]
    assert len(got) == len(all_segmentations(whole.lat, "ab")) and all(g[2] == 0 for g in got)
    docs = docs_of(spark, EDGES)
    coded = sampled_pieces.decode(sampled_pieces.encode_samples(docs, k=3)).collect()
    texts = {d: t or "" for d, t in EDGES}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in coded)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in coded if r["doc_id"] == 4}) == 3
    assert Counter(r["doc_id"] for r in coded)[1] == 1 and Counter(r["doc_id"] for r in coded)[7] == 6
    again = sampled_pieces.encode_samples(docs.repartition(3), k=3).collect()
    assert Counter((r["doc_id"], r["sample"], tuple(r["ids"])) for r in again) == Counter((r["doc_id"], r["sample"], tuple(r["ids"])) for r in coded)
    at_once = sampled_pieces.encode_samples(docs, k=3, decoded=True).collect()
    assert Counter((r["doc_id"], r["sample"], r["decoded"]) for r in at_once) == Counter((r["doc_id"], r["sample"], r["decoded"]) for r in coded)
    assert sampled_pieces.encode_samples(docs_of(spark, [])).count() == 0


def test_forgotten_lattices_change_no_sample(vocabulary, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 41}x rare{i}{k}é" for k in range(60)) for i in range(40)] + ["", "x" * 40_000, None]
    names = [str(i) for i in range(len(texts))]
    whole = sampled_pieces.Encoder(vocabulary)
    want = whole.encode(names, texts)
    monkeypatch.setattr(sampled_pieces, "KEPT_SEGMENTS", 200)
    monkeypatch.setattr(sampled_pieces, "CHUNK_SEGMENTS", 150)
    small = sampled_pieces.Encoder(vocabulary)
    got = small.encode(names, texts)
    assert len(small.lat) < 600 < len(whole.lat)
    for x, y in zip(want, got):
        assert [(i.tolist(), round(p, 6), round(q, 6)) for i, p, q in x] == [(i.tolist(), round(p, 6), round(q, 6)) for i, p, q in y]


def test_decoder_agrees_with_the_library(vocabulary):
    import sentencepiece
    sp, v = sentencepiece.SentencePieceProcessor(model_file=vocabulary), sampled_pieces.Vocabulary(vocabulary)
    for t in ["Hello  world\nfoo", " a", "é😀 x", "a ", "tab\there"]:
        assert v.decode(sp.encode(t)) == t
        for ids, _, _ in sampled_pieces.Encoder(vocabulary).encode(["k"], [t])[0]:
            assert sp.decode(ids.tolist()) == t


# pipeline

@tables
def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, SF_DIR))
        assert docs.columns == columns, name
        old, new = {r[0]: r[1] for r in before.select("doc_id", "text").collect()}, {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
        assert set(new) <= set(old)
        rows = sorted(old.items())
        if name == "line_dedup":
            gone = line_groups(rows)
            for d, t in rows:
                kept = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
                emptied = any(g[0] == d for g in gone) and not any(fuzzy_lines.normalise(x.encode()) for x in kept)
                assert (d not in new) if emptied else new[d] == "\n".join(kept)
        if name == "near_dedup":
            assert set(new) == {d for d, root in jaccard_groups(rows, 5, 80).items() if d == root}
        if name == "decontamination":
            items = [b" " + b" ".join(decontaminate.tokens(r["text"])) + b" " for r in table(spark, SF_DIR, "benchmark").collect()]
            leaked = {d for d, t in rows if any(i in b" " + b" ".join(decontaminate.tokens(t)) + b" " for i in items)}
            assert set(new) == set(old) - leaked
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.where("not decodes").count() == 0 and last.select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = docs_of(spark, EDGES)
    spark.createDataFrame([(4, 0, 0), (6, 1, 1), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            rows = corpus_pipeline.stage(step(spark, rows, str(tmp_path)))
            assert name == "encoding" or rows.columns == docs.columns


def test_texts_are_described_a_slice_at_a_time(spark, monkeypatch):
    """What a task holds beside a batch does not grow with the batch."""
    import pyarrow as pa

    from spindlescope.llm import minhash
    from spindlescope.llm.common import BATCH_ROWS

    seen, whole = [], minhash._describe

    def spied(*args):
        of = whole(*args)
        return lambda texts: seen.append(len(texts)) or of(texts)

    class Docs:  # takes the place of a frame: hands out the function that the tasks run
        schema = {"doc_id": spark.range(1).schema["id"]}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(minhash, "_describe", spied)
    ids = list(range(2 * BATCH_ROWS + 5))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"a b c d {i}" for i in ids])], ["doc_id", "text"])
    out = list(minhash.describe(Docs(), 4, 32, 4)([batch]))
    assert max(seen) <= BATCH_ROWS and sum(seen) == len(ids)
    assert [v for b in out for v in b.column("doc_id").to_pylist()] == ids
    assert {v for b in out for v in b.column("n_shingles").to_pylist()} == {2}
