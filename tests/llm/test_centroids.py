import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from barweave.llm import centroids as C

KIND = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("Cluster", T.StringType())])


def plain_version(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cent)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                cent[n] = [sum(col) // len(mine) for col in zip(*mine)]
    final = [near(v) for _, v in kept]
    per = [sum(d for d, c in final if c == n) for n in range(len(cent))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted((str(i), c, d, per[c], sum(per), digest[c]) for (i, _), (d, c) in zip(kept, final))


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(4)
    for dim, k, spread in ((64, 8, 300), (3, 200, 1000), (2, 50, 4), (1, 7, 2), (5, 1, 9)):
        x, cent = rng.integers(-spread, spread, (3000, dim)), rng.integers(-spread, spread, (k, dim))
        cent[k // 2] = cent[0]                                    # equal centroids: the smaller number wins
        d = ((x[:, None, :] - cent[None]) ** 2).sum(axis=2)
        c, best, compared = C.nearest(x, cent)
        assert (best == d.min(axis=1)).all() and (c == d.argmin(axis=1)).all()
        if (dim, k) == (3, 200):
            assert compared.mean() < k / 3                         # the walk stops early


def test_walk_goes_on_at_a_tie():
    # the frontier of the unseen centroid equals the best distance: it may tie with a smaller number
    x, cent = np.array([[0, 0]]), np.array([[-5, 5], [5, -5], [5, 5]])
    assert C.nearest(x, cent)[0][0] == 0 and C.nearest(x, cent[::-1].copy())[0][0] == 0


def test_clusters_equal_plain_version(spark, scratch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(i % 3, 0.4, 5)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 4), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [1.0, math.nan, 1.0, 1.0, 1.0]), (304, [math.inf] * 5), (305, [0.0] * 5), (None, [0.5] * 5), (7, rows[7][1]), (7, rows[7][1]), (306, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND).repartition(3)
    out = C.cluster_vectors(df, scratch, dim=5, k=6, rounds=4)
    assert [c.lower() for c in out.columns].count("cluster") == 1
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect())
    assert got == plain_version(rows, 5, 6, 4)


def test_few_and_large_vectors(spark, scratch):
    df = spark.createDataFrame([(1, [3e38, -3e38], "x"), (2, [0.0, 0.0], "x")], KIND)
    got = {r["vec_id"]: r for r in C.cluster_vectors(df, scratch, dim=2, k=1, rounds=1).collect()}
    assert got[1]["distance"] >= 2 * (C.LIMIT // 2) ** 2 and got[1]["inertia"] == got[1]["distance"] + got[2]["distance"]
    assert C.cluster_vectors(df, scratch, dim=2, rounds=2).select("cluster").distinct().count() == 2
    assert C.cluster_vectors(df.limit(0), scratch, dim=2).count() == 0
