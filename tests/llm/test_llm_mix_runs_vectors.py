"""Source mixing, periodic runs and whitening: brute force, edge cases and the queries' digests."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlescope.llm import mixing, periodic, whitening
from spindlescope.llm.common import table, words

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")
LONG = " ".join(f"w{i % 4001}" for i in range(30_000))


# mixing

SCHEMA = "doc_id long, text string, source string, size string, h string, none string, target string, copies string, rest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def filled(sizes, weights, budget, most):
    """Targets by going round: who is above its cap stops there, the others share what is left."""
    full, whole = set(), budget * sum(sizes)
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        level = (whole - sum(most * s for i, s in enumerate(sizes) if i in full)) / open_weight if open_weight else 0
        above = {i for i, w in enumerate(weights) if i not in full and w * level > most * sizes[i]}
        if not above:
            return [most * s if i in full else w * level for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= above


def mixed(rows):
    """The mix by sorting each source by hash."""
    def h(d, t):
        key = "?" + hashlib.md5((t or "").encode()).hexdigest() if d is None else str(d)
        return int(hashlib.md5(f"{mixing.SEED}|{key}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((h(d, t), (d is not None, d or 0), len(words(t)), d))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(x[2] for x in by[s]) for s in names]
    goal = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    out = Counter()
    for s, size, t in zip(names, sizes, goal):
        copies = min(2, math.floor(t / size)) if size else 0
        rest, before = t - copies * size, 0
        for _, _, n, d in sorted(by[s]):
            out[d, s, n, size, t, n * (copies + (2 * before + n <= 2 * rest))] += 1
            before += n
    return out


def as_counter(df):
    return Counter((r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect())


def test_mix_equals_sorting(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join("x" * r.randrange(1, 4) for _ in range(r.randrange(0, 40))), r.choice(["a", "b", "é", "", "Z", None, "hot", "hot", "hot"])) for i in range(500)]
    rows += [(900, LONG, "long"), (901, None, "a"), (902, "", None), (903, " \t\n", "empty"), (904, "one", "tiny")]
    want = mixed(rows)
    for _ in range(2):
        assert as_counter(mixing.mix(docs_of(spark, rows).repartition(7))) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert as_counter(mixing.mix(docs_of(spark, rows))) == want
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    assert as_counter(mixing.mix(docs_of(spark, rows))) == want


def test_equal_rows_share_out_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 7)
    rows = [(5, "a b c", "s")] * 60 + [(None, "d e", "s")] * 40 + [(6, "q " * 50, "s"), (None, "x " * 9, "t"), (7, "y z " * 400, "u"), (7, "y z", "u")]
    got = as_counter(mixing.mix(docs_of(spark, rows)))
    assert got == mixed(rows) and sum(got.values()) == len(rows)
    for s in ("s", "t", "u"):
        taken, goal = sum(k[5] * n for k, n in got.items() if k[1] == s), next(k[4] for k in got if k[1] == s)
        assert abs(taken - goal) <= 400


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert as_counter(mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")]))) == {(1, None, 0, 0, 0.0, 0): 1, (2, "a", 0, 0, 0.0, 0): 1}


def test_larger_budgets_take_what_smaller_ones_take(spark):
    docs = docs_of(spark, [(i, "w " * (i % 13), f"s{i % 4}") for i in range(300)])
    taken = [{r["doc_id"]: r["taken"] for r in mixing.mix(docs, budget=b).collect()} for b in (0.2, 0.7, 1.1, 1.9)]
    assert all(a[d] <= b[d] for a, b in zip(taken, taken[1:]) for d in a)


# runs

def made(r):
    k, out = r.choice([1, 2, 3, 20, 1000]), []
    while len(out) < r.randrange(1, 700):
        if r.random() < 0.4:
            out += [f"w{r.randrange(k)}" for _ in range(r.randrange(40))]
        else:
            p = [f"w{r.randrange(k)}" for _ in range(r.randrange(1, 60))]
            out += (p * 20)[:r.randrange(1, len(p) * r.randrange(1, 8) + 2)]
    return out


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (4, LONG), (None, "no id " * 30), (5, "é 😀 " * 24), (6, "x " * 23), (7, "x " * 24), (8, "a"), (9, " ".join(f"u{i}" for i in range(20_000)))]


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text):
    return [w.decode() for w in words(text)]


def test_transform_is_exact_and_invertible():
    rng = np.random.default_rng(1)
    for n in (16, 128, 256, 8192):
        x = rng.integers(0, periodic.PRIME, (2, n)).astype(float)
        y = periodic.transform(x.copy())
        w = pow(periodic.ROOT, (periodic.PRIME - 1) // n, periodic.PRIME)
        assert int(y[1, 3]) == sum(int(v) * pow(w, 3 * i, periodic.PRIME) for i, v in enumerate(x[1])) % periodic.PRIME
        assert (periodic.reduce(periodic.transform(y, True) * float(pow(n, -1, periodic.PRIME))) == x).all()


def test_squared_differences_equal_sums():
    r = np.random.default_rng(3)
    codes = r.integers(0, 3, 90).astype(float)
    text, b, q = periodic.occurrences(codes, np.array([0, 40]), np.array([40, 50]), 1, 8, 8, range(2))
    want = {(t, i, d) for t, (s, n) in enumerate([(0, 40), (40, 50)]) for i in range(0, n - 8, 8) for d in range(1, 16)
            if i + d + 8 <= n and (codes[s + i:s + i + 8] == codes[s + i + d:s + i + d + 8]).all()}
    assert set(zip(text.tolist(), b.tolist(), q.tolist())) == want


@pytest.mark.parametrize("largest", [periodic.LARGEST, 16])
def test_runs_equal_brute_force(monkeypatch, largest):
    monkeypatch.setattr(periodic, "LARGEST", largest)
    r = random.Random(largest)
    for _ in range(25):
        texts = [made(r) for _ in range(6)]
        for (n, runs, kept), w in zip(periodic.collapse([" ".join(t) for t in texts]), texts):
            assert n == len(w) and runs == periodic.brute_force(w) and kept.decode() == collapsed(w, runs)


def test_long_texts_of_one_word_and_of_long_periods():
    assert periodic.collapse(["a " * 300_000])[0] == (300_000, [(0, 300_000, 1)], b"a")
    w = [f"w{(i * i) % 50_021}" for i in range(30_011)] * 3
    assert periodic.collapse([" ".join(w[5:])])[0][1] == []
    assert periodic.collapse([" ".join(["z", *w])])[0][1] == [(1, 90_033, 30_011)]


def test_runs_on_edges(spark):
    docs = spark.createDataFrame([(d, t, [d], "clash") for d, t in EDGES], "doc_id long, text string, runs array<long>, collapsed string")
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), bytes(r["collapsed"]).decode()) for r in periodic.periodic_runs(docs).collect())
    short = [(d, t) for d, t in EDGES if d not in (4, 9)]
    want = Counter((d, len(split(t)), tuple(x := periodic.brute_force(split(t))), collapsed(split(t), x)) for d, t in short)
    want[4, 30_000, ((0, 30_000, 4001),), " ".join(LONG.split()[:4001])] += 2
    want[9, 20_000, (), EDGES[-1][1]] += 1
    assert got == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


@tables
def test_digests_of_the_query(spark):
    want = {}
    for d, t in table(spark, SF_DIR, "documents").select("doc_id", "text").collect():
        w, h = split(t), periodic.crc_of(d)
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = periodic.brute_force(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(w, runs))]
        want[d] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)
    got = {r[0]: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, SF_DIR).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 5


# whitening

def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, n int, x string")


@pytest.mark.parametrize("d,kind", [(1, "any"), (5, "any"), (40, "any"), (40, "tied"), (120, "close")])
def test_components_equal_a_full_decomposition(d, kind):
    rng = np.random.default_rng(d)
    e = np.sort(rng.random(d))[::-1]
    if kind == "tied":
        e[2:11] = e[2]
    if kind == "close":
        e = 1 + 0.01 * e
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, found = whitening.leading_components(lambda b: v @ b, d, 8)
    k = min(d, 8)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12) and np.allclose(found.T @ found, np.eye(k), atol=1e-12)
    assert np.linalg.norm(v @ found - found * values, axis=0).max() < 2 * d * whitening.EPS * values[0]


def test_corrections_solve_their_equation():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 9))
    a = a @ a.T
    p = np.linalg.qr(rng.standard_normal((9, 3)))[0]
    r = rng.standard_normal((9, 3))
    r -= p @ (p.T @ r)
    values = np.array([200.0, 150.0, 120.0])
    t = whitening.corrections(lambda b: a @ b, values, p, r)
    for i in range(3):
        off = (a @ t[:, i] - values[i] * t[:, i]) + r[:, i] / np.linalg.norm(r[:, i])
        assert np.linalg.norm(off - p @ (p.T @ off)) < 0.1 and np.abs(p.T @ t[:, i]).max() < 1e-12


def test_whitened_rows_equal_numpy(spark):
    rng = np.random.default_rng(7)
    good = (rng.standard_normal((300, 12)) * np.arange(1, 13)[::-1] / 9).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(0, good[0].tolist()), (None, good[1].tolist())]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf"), *[0.0] * 11]), (904, [1e30] * 12), (905, []), (906, [1.0])]
    stored = whitening.stored(whitening.whole_vectors(vectors_of(spark, rows + bad)))
    model = whitening.fit(stored)
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 100_000
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    got = whitening.whitened(stored, model).collect()
    assert len(got) == 8 * len(rows) and {r["vec_id"] for r in got} == {i for i, _ in rows}
    turn = np.sign((model.vectors * u).sum(axis=0))
    w, away = c @ u / np.sqrt(e), ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for r in got:
        i, k = 0 if r["vec_id"] == 0 else 301 if r["vec_id"] is None else r["vec_id"], r["component"] - 1
        assert abs(r["whitened"] - turn[k] * w[i, k]) < 1e-9 and int(r["deviation"]) == away[i] and r["n"] == len(x)
        assert abs(r["explained"] - e[k] / np.trace(c.T @ c / len(x))) < 1e-12
    assert whitening.identity_error(stored, model) < 1e-10
    many = whitening.Centre(10 ** 12, x.sum(axis=0))
    assert [int(v) for v in many.deviations(x[:3]).to_pylist()] == [sum((10 ** 12 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0))) for r in x[:3]]


def test_whitening_without_variance(spark, tmp_path):
    stored = whitening.stored(whitening.whole_vectors(vectors_of(spark, [(1, [0.5, 0.25, 1.0]), (2, [1.5, 0.25, 1.0]), (3, [1.0, 0.25, 1.0])])))
    model = whitening.fit(stored)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened(stored, model).collect()}
    assert model.rank == 1 and len(got) == 9 and abs(abs(got[1, 1]) - 1.5 ** 0.5) < 1e-12 and got[3, 1] == 0 and got[1, 2] is None
    for i, rows in enumerate(([(1, [1.0, 2.0])], [])):
        vectors_of(spark, rows).write.parquet(str(tmp_path / f"{i}/embeddings.parquet"))
        out = whitening.op13_embedding_whitening(spark, str(tmp_path / str(i)))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 2 * len(rows)
        assert all(int(r["deviation"]) == 0 and r["whitened"] is None for r in out.collect())


@tables
def test_query_digests_of_whitening(spark):
    got = whitening.op13_embedding_whitening(spark, SF_DIR)
    assert got.count() == 8 * 500 and got.agg(F.max("identity_error")).first()[0] < 1e-9
