import random
import re

import numpy as np
import pytest

from barweave.llm import embeddings as E
from barweave.llm import minhash as M
from barweave.llm.components import components


def test_components(spark, scratch):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (3, 2), (2, 3)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {n: find(n) for n in {x for l in links for x in l if l[0] != l[1]}}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain(rows, width, percent):
    sets = [(k, shingles(t, width)) for k, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted((str(k), len(s), str(None if k is None else find(k))) for k, s in sets)


def corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    rows, k = [(1000, None), (1001, ""), (1002, "Solo"), (1003, "solo"), (1004, "two Words"), (1005, " two\twords\n"), (None, "no id at all here"), (1006, "no id at all here"), (1007, "no id at all here")], 0
    for size in (8, 30, 120, 400):
        for copies in (1, 2, 6):
            base = [word() for _ in range(size)]
            for c in range(copies):
                t = list(base)
                for _ in range(rng.randrange(0, max(1, size // 18))):
                    t[rng.randrange(size)] = word()
                rows.append((k := k + 1, " ".join(t)))
    base = [word() for _ in range(200)]                # a group whose members are alike only through their base, which has a late id
    for c in range(25):
        t = list(base)
        for p in rng.sample(range(0, 200, 8), 5):
            t[p] = word()
        rows.append((k := k + 1, " ".join(t)))
    rows += [(900, " ".join(base)), (900, " ".join(base)), (901, " ".join(word() for _ in range(20000)))]
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_equal_all_pairs(spark, scratch, documents, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = corpus()
    got = M.near_duplicates(documents(rows), scratch, width=3, percent=85).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 16)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))).astype(np.uint64) for _ in range(12)]
    got = M.common_shingles(np.concatenate([np.full(len(x), i) for i, x in enumerate(sets)]), np.concatenate(sets), 12)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


def test_no_documents(spark, scratch, documents):
    assert M.near_duplicates(documents([(1, "a b c")]).limit(0), scratch).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    for n, share in ((40, .9), (3000, .85), (3000, .5), (20000, .2)):
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)])) for _ in range(2))
        a, b = (M.registers(1, np.zeros(len(s), int), s) for s in (x, y))
        j, union = M.estimate(a, b, np.array([len(x)]), np.array([len(y)]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(j[0] - true) < 5 * np.sqrt(max(true * (1 - true), .02) / union[0])
    v = np.array([(1 << 55) << 8, (0b10000000001 << 30) << 8], dtype=np.uint64)
    r = M.registers(2, np.array([0, 1]), v)[:, 0]
    assert r[0] >> 10 == 0 and r[1] >> 10 == 55 - 40 and r[1] & 1023 == 1
    assert (M.densified(M.registers(1, np.zeros(1, int), v[:1])) == r[0]).all()


def vectors(rng, spark, dim=16):
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=dim)
            for _ in range(int(rng.integers(1, 7))):
                rows.append((k := k + 1, (base + rng.normal(size=dim) * rng.uniform(0, .55)).astype(np.float32).tolist(), label))
    hot = rng.normal(size=dim)
    rows += [(k := k + 1, (hot + rng.normal(size=dim) * .05).astype(np.float32).tolist(), 1) for _ in range(60)]
    rows += [(k := k + 1, hot.astype(np.float32).tolist(), 1) for _ in range(40)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] * dim, [], [1.0] * (dim - 1), [1.0] * (dim - 1), [1e30] * dim, [1e-30] * dim]
    rows += [(k := k + 1, v, 1) for v in odd] + [(None, hot.astype(np.float32).tolist(), 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", __import__("pyspark").sql.functions.lit("x")).repartition(4)


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links_equal_all_pairs(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows, df = vectors(np.random.default_rng(2), spark)
    good = [(k, np.array(v, np.float64), l) for k, v, l in rows if k is not None and v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: 0 for k, _, _ in rows}
    root = {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r["vec_id"]: r for r in E.vector_links(df, scratch).collect()}
    assert len(got) == len(rows)
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {k: (links[k], None if k is None else find(k)) for k in links}
    assert all(r["kept"] == (k is None or r["component_id"] == k) for k, r in got.items())
    assert E.vector_links(df.limit(0), scratch).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * rng.uniform(0, 1.5, (4000, 1))
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    bits, match, spread = E.encode(x)
    steps, low, step = E.quantise(y, np.arange(4000))
    error = E.estimate(bits, match, steps, low, step) - (x * y).sum(axis=1)
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(4000)
    assert (np.abs(error) <= E.DEVIATIONS * (spread + step / 2 / match)).all()
