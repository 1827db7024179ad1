"""Clustering of integer vectors around centroids; nearest centroids by the threshold algorithm.

Per dimension the centroids are a list sorted by their value.  A vector walks every list outward from its
own value; the centroids met are compared exactly.  A centroid not met yet lies, in every dimension, at
least as far away as the next one in that list (the frontier), so the sum of the squared frontier
distances is a lower bound for all of them.  The walk stops when that sum strictly exceeds the best exact
distance; at a tie it goes on, as the smaller number wins.

Vectors are whole numbers, so distances, sums and floors are exact and no order of rows matters.  A round
is one pass over the written vectors: every task sends one partial sum per centroid and dimension, and the
driver holds the centroids, whose number and size are parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, without

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
LIMIT = 1 << 27          # components saturate here, so that 64 squared differences fit in 63 bits
CHUNK = 2048             # rows walked together
_ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, centroids compared) of the nearest centroid of each row; ties: the smaller number."""
    k, dim = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T                       # (dim, k): the sorted lists
    values = np.take_along_axis(centroids.T, order, axis=1)
    # both ends are closed by places that are farther than any value
    far = np.int64(1) << 40
    fenced = np.concatenate([np.full((dim, 1), -far), values, np.full((dim, 1), far)], axis=1)
    numbers = np.concatenate([np.zeros((dim, 1), order.dtype), order, np.zeros((dim, 1), order.dtype)], axis=1)
    dims = np.arange(dim)
    out_c, out_d, out_n = [], [], []
    for lo in range(0, len(x), CHUNK):
        part = x[lo:lo + CHUNK]
        rows = len(part)
        down = np.stack([np.searchsorted(values[d], part[:, d], side="left") for d in range(dim)], axis=1)     # fenced place of the last smaller value
        up = down + 1
        met = np.zeros((rows, k), dtype=bool)
        best = np.full(rows, np.iinfo(np.int64).max)
        number = np.full(rows, k)
        active = np.arange(rows)
        for _ in range(k):
            xa, da, ua = part[active], down[active], up[active]
            below, above = xa - fenced[dims, da], fenced[dims, ua] - xa
            lower = below <= above
            reached = np.where(lower, numbers[dims, da], numbers[dims, ua])
            da, ua = da - lower, ua + ~lower
            new = np.zeros((len(active), k), dtype=bool)
            new[np.arange(len(active))[:, None], reached] = True
            new &= ~met[active]
            met[active] |= new
            r, c = np.nonzero(new)
            diff = xa[r] - centroids[c]
            exact = (diff * diff).sum(axis=1)
            for s in _first_runs(r):                                              # every row at most once, its candidates by ascending number
                rr = active[r[s]]
                better = (exact[s] < best[rr]) | ((exact[s] == best[rr]) & (c[s] < number[rr]))
                best[rr[better]], number[rr[better]] = exact[s][better], c[s][better]
            frontier = np.minimum(np.minimum(xa - fenced[dims, da], fenced[dims, ua] - xa), np.int64(1) << 28)
            bound = (frontier * frontier).sum(axis=1)
            down[active], up[active] = da, ua
            active = active[(bound <= best[active]) & ~met[active].all(axis=1)]
            if not len(active):
                break
        out_c.append(number)
        out_d.append(best)
        out_n.append(met.sum(axis=1))
    if not out_c:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_c), np.concatenate(out_d), np.concatenate(out_n)


def _first_runs(r: np.ndarray):
    """Index sets that hold every value of the ascending ``r`` at most once: first ones, second ones and so on."""
    if not len(r):
        return
    start = np.r_[True, r[1:] != r[:-1]]
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
    order = np.argsort(place, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(place[order])) + 1)


def whole_numbers(vectors: DataFrame, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Rows whose vector has ``dim`` finite components, with ``_v``: floor(scale * component), saturating at ``LIMIT``."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(scale)) * F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c.cast("double")))))).cast("long"))
    return vectors.filter((F.size(v) == dim) & ~bad).withColumn("_v", whole)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def new_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k, dim = centroids.shape

    def run(batches):
        import pyarrow as pa
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            c, _, _ = nearest(x, centroids)
            counts += np.bincount(c, minlength=k)
            for i in np.unique(c):
                sums[i] += x[c == i].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dim)), pa.array(np.tile(np.arange(dim), len(used))), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], dim))],
                                         names=["number", "axis", "total", "rows"])

    parts = vectors.select("_v").mapInArrow(run, "number long, axis long, total long, rows long")
    moved = centroids.copy()
    whole = parts.groupBy("number", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
    for number, axis, total, rows in whole.collect():                              # k * dim rows at most
        moved[number, axis] = int(total) // rows
    return moved


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` without ``_v``, with ``cluster`` and ``distance``."""
    base = vectors.drop("_v")
    dim = centroids.shape[1]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            c, d, _ = nearest(_matrix(batch.column(batch.num_columns - 1), dim), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(c.astype(np.int32)), pa.array(d)], names=[*batch.schema.names[:-1], "cluster", "distance"])

    kind = T.StructType([*base.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select(*base.columns, "_v").mapInArrow(run, kind)


def cluster_vectors(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS,
                    rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """Valid rows of ``vectors`` with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Rows with a null vector, another length or a null or non-finite component are left out; components
    beyond ``LIMIT / scale`` saturate.  The first centroids are the vectors with the smallest hashes of
    their ids (a null id counts as an empty one, equal ids are ordered by components), fewer if there are
    fewer rows.  Repeated rows count each; no valid row gives no rows.  Inertia sums saturate at the
    largest long.  Columns named like an added one are replaced.
    """
    kept = scratch.keep(whole_numbers(without(vectors, *_ADDED, "_v"), vector_col, dim), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    first = kept.select(mark.alias("mark"), "_v").orderBy("mark", "_v").limit(k).collect()
    if not first:
        return kept.drop("_v").withColumns({"cluster": F.lit(0), **{c: F.lit(0).cast("long") for c in _ADDED[1:4]}, _ADDED[4]: F.lit("")})
    centroids = np.array([r["_v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        centroids = new_centroids(kept, centroids)
    found = scratch.keep(assigned(kept, centroids), "assigned")
    most = F.lit((1 << 63) - 1)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()      # k rows at most
    saturated = lambda v: F.least(most.cast("decimal(38,0)"), F.lit(v).cast("decimal(38,0)")).cast("long")
    per = F.create_map(*[x for r in sums for x in (F.lit(r["cluster"]), saturated(str(r["s"])))])
    import hashlib
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    return found.withColumns({"cluster_inertia": F.element_at(per, F.col("cluster")), "inertia": saturated(str(sum(r["s"] for r in sums))),
                              "centroid_sha256": F.get(F.array(*[F.lit(d) for d in digests]), F.col("cluster"))})


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster_vectors(vectors, Scratch(spark, "op13")).select("vec_id", *_ADDED)


def _rounds_sql() -> str:
    out, last = [], "c0"
    for i in range(ROUNDS + 1):
        near = f"""a{i} AS MATERIALIZED (SELECT vid, arg_min(number, (dist, number)) AS number, min(dist) AS distance FROM (
  SELECT v.vid, c.number, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS dist FROM v JOIN {last} c USING (axis) GROUP BY 1, 2) GROUP BY 1)"""
        out.append(near)
        if i < ROUNDS:
            # floor(sum / count) in whole numbers, also below zero
            out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.number, c.axis, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM {last} c LEFT JOIN (
  SELECT a.number, v.axis, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN v USING (vid) GROUP BY 1, 2) m ON m.number = c.number AND m.axis = c.axis)""")
            last = f"c{i + 1}"
    return ",\n".join(out)


OP13_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS vid, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS xs FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT vid, unnest(xs) AS x, unnest(range({DIM})) AS axis FROM k),
f AS (SELECT vid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), xs) - 1 AS number FROM k),
c0 AS MATERIALIZED (SELECT f.number, v.axis, v.x FROM f JOIN v USING (vid) WHERE f.number < {CENTROIDS}),
{_rounds_sql()},
h AS (SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY axis)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY number)
SELECT k.vec_id, CAST(a.number AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{ROUNDS} a JOIN k USING (vid) JOIN h USING (number)
"""
