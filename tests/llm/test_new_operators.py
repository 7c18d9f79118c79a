"""Hard negatives, periodic runs and fingerprints against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import edge_rows, table

from freshet.llm import common, fingerprint, negatives, periodic

VEC = "vec_id long, embedding array<float>, label int, key int, cell string, low string"


# --- periodic runs ---


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((a, n, q) for (a, n), q in found.items())


def fast_runs(w):
    ids = np.unique(np.array(w), return_inverse=True)[1] if w else np.zeros(0, int)
    counts, base = periodic.lag_counts(ids.astype(np.uint64), np.array([0, len(w)]))
    limit = len(w) // 4
    assert counts.tolist() == [0] + [sum(a == b for a, b in zip(w, w[q:])) for q in range(1, limit + 1)]
    return periodic.runs_of(ids, counts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(parts):
    w = [x for part, times in parts for x in part * times]
    assert fast_runs(w) == brute_runs(w)


@pytest.mark.parametrize("heavy", [2, 5, 10**9])
def test_runs_of_longer_texts(heavy, monkeypatch):
    """Transforms and pair differences count the same; frequent words alone make no run."""
    monkeypatch.setattr(periodic, "_heavy_from", lambda n: heavy)
    rng = random.Random(heavy)
    for n, period in ((400, 3), (900, 40), (1500, 1), (700, 120)):
        w = [rng.choice("aaab" + "cdefghij") for _ in range(n)]
        at = rng.randrange(n // 8)
        for i in range(at + period, n - n // 10):
            w[i] = w[i - period]
        assert fast_runs(w) == brute_runs(w) != []


def test_one_word_very_often_is_cheap():
    n = 400_000
    ids = np.zeros(n, np.uint64)
    counts, _ = periodic.lag_counts(ids, np.array([0, n]))
    assert periodic.runs_of(ids, counts) == [(0, n, 1)]
    noise = np.random.default_rng(0).integers(0, 2, n).astype(np.uint64)
    counts, _ = periodic.lag_counts(noise, np.array([0, n]))
    got = periodic.runs_of(noise, counts)
    assert got and all(len(set(noise[a + q : a + k] == noise[a : a + k - q])) == 1 for a, k, q in got)


def brute_row(i, text, tile):
    w = (text or "").encode().split()
    n = len(w)
    if tile and i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(w)
    drop = {k for a, m, q in runs for k in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1] * math.lcm(*[x[2] for x in runs]) // r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


@pytest.mark.parametrize("tile", [True, False])
def test_periodic_runs_of_documents(spark, tile):
    rng = random.Random(2)
    rows = [(i, t if len(t or "") < 9000 else t[:4000]) for i, t in edge_rows()]
    rows += [(100 + k, " ".join(rng.choice(["x", "y é", "z\n", "\t"]) for _ in range(rng.randint(0, 200)))) for k in range(60)]
    rows += [(300, "a " * 500), (301, "a b " * 300 + "c " + "a b " * 90)]
    got = periodic.periodic_runs(table(spark, rows), tile).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute_row(i, t, tile) for i, t in rows), key=str)
    assert periodic.periodic_runs(table(spark, rows).limit(0), tile).count() == 0


# --- fingerprints ---


def brute_digest(data):
    counts = [0] * 128
    for i in range(len(data)):
        for places, factors in fingerprint.TRIPLETS:
            if i + max(places) < len(data):
                counts[sum(data[i + p] * f for p, f in zip(places, factors)) % 2**32 >> fingerprint.SHIFT] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    size = 0 if not data else 8 * (len(data).bit_length() - 1) + (8 * len(data) >> len(data).bit_length() - 1) - 7
    ratios = [15 * x // max(q[2], 1) for x in q[:2]]
    return f"{size:02x}{ratios[0]:x}{ratios[1]:x}" + "".join(f"{a * 4 + b:x}" for a, b in zip(codes[::2], codes[1::2])), (size, *ratios), codes


def brute_likeness(a, b):
    gap = sum([0, 1, 2, 6][abs(x - y)] for x, y in zip(a[2], b[2])) + sum(abs(x - y) for x, y in zip(a[1], b[1]))
    return 1 - min(gap, 256) / 256


def brute_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited = (t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()
        own, changed, after = brute_digest(t.encode()), brute_digest(edited), brute_digest(nxt.encode())
        out.append((i, len(t), hashlib.sha256(edited).hexdigest(), own[0], changed[0], brute_likeness(own, changed), brute_likeness(own, after)))
    return out


def test_fingerprints_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PIECE", 64)
    rng = random.Random(3)
    rows = [(i, t if len(t or "") < 9000 else t[:3000]) for i, t in edge_rows() if i != 5] + [(5, "one")]
    rows += [(-k, "".join(rng.choice("ab é你\U0001f600\n") for _ in range(rng.choice([1, 2, 3, 10, 300])))) for k in range(1, 40)]
    for some in (rows, rows[:1], rows[3:5]):
        got = fingerprint.fingerprints(table(spark, some)).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(brute_fingerprints(some), key=str)
    assert fingerprint.fingerprints(table(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_each_have_a_successor(spark):
    got = fingerprint.fingerprints(table(spark, [(5, "one"), (5, "one"), (5, "two words"), (6, "x"), (None, None), (None, "y")])).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=str) == sorted([(5, 3), (5, 3), (5, 9), (6, 1), (None, 0), (None, 1)], key=str)


def test_likeness_tells_edits_from_other_texts(spark):
    """A text that shares half its characters is closer than an unrelated one of the table."""
    got = fingerprint.query(spark, "/root/testdata/sf0.01").where("n_chars >= 200").select("near_edited", "near_next").collect()
    nearer = sum(r.near_edited > r.near_next for r in got)
    assert nearer / len(got) > 0.95, (nearer, len(got))


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprint.query(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").join(got, "doc_id")
    assert texts.groupBy("text").agg({"fingerprint": "min"}).count() == texts.select("text", "fingerprint").distinct().count()


# --- hard negatives ---


def brute_negatives(rows, scale=256):
    rows = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, y in rows:
        least[i] = min(least.get(i, (y, v)), (y, v))
    rows = [(i, v, y) for i, (y, v) in least.items()]
    out = []
    for i, v, y in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows if j != i)
        for p, j in [(-s, j) for s, j, z in scored if z == y][:5]:
            fits = [(k, -s) for s, k, z in scored if z != y and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, r, k, p, s) for r, (k, s) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "l") for r in rows], VEC)


def cloud(seed, n, d, labels, spread):
    """Clusters by label, exact copies, and small whole numbers so that scores tie."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    rows = []
    for k in range(n):
        y = int(rng.integers(labels))
        v = (centres[y] + spread * rng.normal(size=d)).round(2 if k % 3 else 0) if k % 7 else centres[0].round(1)
        rows.append((k * 20, [float(np.float32(x)) for x in v], y))
    return rows


@pytest.mark.parametrize("seed,n,d,spread", [(0, 300, 8, 0.3), (1, 500, 4, 1.0), (2, 400, 16, 0.05)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, n, d, spread):
    for name, value in (("CHUNK", 40), ("SAMPLE", 64), ("LEAF", 8), ("GROUP", 4), ("ANCHORS", 7)):
        monkeypatch.setattr(negatives, name, value)
    rows = cloud(seed, n, d, 4, spread)
    got = negatives.hard_negatives(vectors(spark, rows), negatives.F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows) != []


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, nan], 1), (3, [1.0, None], 2), (4, [inf, 0.0], 2), (5, [1.0, 1.0], None)]
    rows += [(6, [0.9, 0.1], 1), (6, [0.9, 0.1], 1), (6, [0.5, 0.1], 2), (7, [0.5], 2), (8, [0.4, 0.3, 9.0], 2), (9, [], 2), (100, [-1.0, 0.0], 3), (101, [1.0, 0.0], 3), (200, [0.0, 0.0], 5), (201, [0.0, 0.0], 5), (300, [1e30, 1.0], 7)]
    some = [r for r in rows if r[0] != 300]
    ask = negatives.F.col("vec_id") % 100 == 0
    got = negatives.hard_negatives(vectors(spark, some), ask).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(some) != []
    assert negatives.hard_negatives(vectors(spark, rows), ask).count() > 0
    assert negatives.hard_negatives(vectors(spark, rows).limit(0), ask).count() == 0
    assert negatives.hard_negatives(vectors(spark, [r for r in rows if r[0] == 1]), ask).count() == 0


def test_trees_prune_whole_groups(monkeypatch):
    """In clustered vectors most leaf pairs are never scored, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12)) * 4
    y = np.repeat(np.arange(20), 100)
    v = np.floor(256 * (centres[y] + 0.05 * rng.normal(size=(2000, 12)))).astype(np.int64)
    ids = np.arange(2000)
    asked = np.arange(0, 2000, 10)
    seen, add = [], negatives.Windows.add
    monkeypatch.setattr(negatives.Windows, "add", lambda self, rows, score, fits: seen.append(score.size) or add(self, rows, score, fits))
    open_ = np.full((200, 1), 2**62)
    windows = negatives.Windows(-open_, open_, -open_, 5)
    i, _, j, s = negatives.dual_search(negatives.BoxTree(v, y, 64), (ids, y, v), (ids[asked], y[asked], v[asked]), windows, same=True)
    want = v[asked] @ v.T
    want[(y[asked][:, None] != y) | (asked[:, None] == ids)] = -(2**62)
    assert sorted(zip(i.tolist(), s.tolist())) == sorted((a, int(x)) for a in range(200) for x in np.sort(want[a])[::-1][:5])
    assert sum(seen) < 0.2 * 200 * 2000, sum(seen)


@pytest.mark.parametrize("op", [negatives, periodic, fingerprint])
def test_new_oracles(spark, op):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(op.ORACLE)
    got = op.query(spark, "/root/testdata/sf0.001").select(*[d[0] for d in cur.description])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(cur.fetchall(), key=str)
    assert common
