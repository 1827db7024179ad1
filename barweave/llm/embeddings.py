"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector ``x`` is rotated at random and stored as the signs of its coordinates with two factors:
the inner product of ``x`` with its code, and from it the spread of the estimate.  For another vector ``q``,
rotated and quantised to four bits with random rounding, ``<code, q> / <code, x>`` estimates ``<x, q>``
without bias, and lies within ``DEVIATIONS`` spreads of it.  A pair whose upper bound is under the
threshold is dropped; every other pair is recomputed in double precision.

Which pairs are compared: further rotations' signs are read ``k`` at a time as keys of ``tables`` hash
tables (``k`` grows with the logarithm of the largest label, the number of tables so that a pair at the
threshold shares no key with a chance of at most ``MISS``).  A pair is counted in the first table whose key
it shares.  Equal vectors of a label are one weighted row from the start.  Buckets beyond ``BLOCK`` rows
are compared in blocks of two parts, so no task holds more, and only counts and one spanning star of each
linked set leave a block, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runs import pairs_in_runs, run_starts, whole_runs
from .scratch import Scratch
from .words import mix

BLOCK, MISS, DEVIATIONS, SEED, PAIRS = 1024, 1e-4, 5.0, 3, 1 << 18


def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation of the space."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, number)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs as bits in bytes, inner product with the code, spread factor) of unit rows."""
    turned = x @ rotation(x.shape[1], 0)
    dim = x.shape[1]
    match = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    spread = np.sqrt(np.maximum(0, 1 - match ** 2)) / match / math.sqrt(max(dim - 1, 1))
    return np.packbits(turned > 0, axis=1), match, spread


def quantise(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated rows as four-bit steps with random rounding: (steps, lowest value, step size)."""
    turned = x @ rotation(x.shape[1], 0)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / 15, 1e-12)
    noise = (mix(ids.astype(np.uint64)[:, None] * np.uint64(x.shape[1]) + np.arange(x.shape[1], dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.floor((turned - low) / step + noise), 15).astype(np.uint8), low[:, 0], step[:, 0]


def estimate(bits, match, steps, low, step) -> np.ndarray:
    """Unbiased estimates of <x, q> for aligned rows of codes and quantised queries: sums of steps over set bits, by bit planes."""
    dim = steps.shape[1]
    over = np.zeros(len(bits), dtype=np.float64)
    for plane in range(4):
        over += (1 << plane) * np.bitwise_count(np.packbits((steps >> plane) & 1, axis=1) & bits).sum(axis=1)
    ones = np.bitwise_count(bits).sum(axis=1)
    # code = (2 bit - 1) / sqrt(dim), q = low + step * steps
    product = (2 * (low * ones + step * over) - (low * dim + step * steps.sum(axis=1, dtype=np.int64))) / math.sqrt(dim)
    return product / match


def table_plan(largest: int, threshold: float) -> tuple[int, int]:
    """(bits per key, number of tables) for a label of ``largest`` vectors."""
    p = 1 - math.acos(min(1.0, threshold)) / math.pi
    k = int(min(24, max(6, round(math.log2(max(largest, 2))) - 2)))
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - p ** k)))


def keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """rows x tables keys of ``k`` signs of further rotations."""
    dim = x.shape[1]
    signs = np.concatenate([x @ rotation(dim, 1 + i) > 0 for i in range(math.ceil(k * tables / dim))], axis=1)[:, :k * tables]
    return (signs.reshape(len(x), tables, k) << np.arange(k)).sum(axis=2).astype(np.int32)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable by links (a, b) among n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def vector_links(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least
    ``threshold``.  Null and zero vectors, and those with null or non-finite components, link with nothing;
    neither do rows without an id, which have no component and are kept.  Vectors of different lengths never
    link.  Rows sharing an id are separate vectors that share a component; other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("grp", F.when(usable, F.concat_ws(":", F.size("v").cast("string"), "label"))).drop("label")
    rows = scratch.keep(rows, "vectors")
    classes = rows.filter("v is not null").groupBy("grp", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("cls", F.xxhash64("grp", "v"))
    classes = scratch.keep(classes, "classes")
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    k, tables = table_plan(largest, threshold)

    def to_keys(batches):
        import pyarrow as pa
        for batch in batches:
            grp, v, rep, weight, cls = (batch.column(i).to_pylist() for i in range(5))
            dims = np.array([len(x) for x in v])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 512):
                    pick = at[lo:lo + 512]
                    raw = np.array([v[i] for i in pick], dtype=np.float64)
                    raw /= np.abs(raw).max(axis=1, keepdims=True)     # no overflow of squares
                    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                    all_keys = keys(x, k, tables)
                    bucket = mix(mix(np.array([hash_text(grp[i]) for i in pick], dtype=np.uint64))[:, None] + mix((np.arange(tables, dtype=np.uint64) << np.uint64(32)) + all_keys.astype(np.uint64))).view(np.int64)
                    times = lambda values, kind: pa.array([y for y in values for _ in range(tables)], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(pick))), times([rep[i] for i in pick], pa.int64()), times([cls[i] for i in pick], pa.int64()), times([weight[i] for i in pick], pa.int64()),
                                                      times([grp[i] for i in pick], pa.string()), times([y.tobytes() for y in all_keys], pa.binary()), times([y.tobytes() for y in np.array([v[i] for i in pick], dtype=np.float64)], pa.binary())],
                                                     ["bucket", "tab", "rep", "cls", "weight", "grp", "keys", "v"])

    keyed = classes.select("grp", "v", "rep", "weight", "cls").mapInArrow(to_keys, "bucket long, tab int, rep long, cls long, weight long, grp string, keys binary, v binary")
    sizes = scratch.keep(classes.select("grp", "v", "rep", "weight", "cls").mapInArrow(lambda b: _only_buckets(to_keys(b)), "bucket long").groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    parts = F.ceil(F.col("c") / F.lit(BLOCK // 2)).cast("int")
    dealt = keyed.join(sizes, "bucket").withColumn("parts", F.when(F.col("c") > BLOCK, parts).otherwise(1)).withColumn("side", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "tab", "rep", "cls", "weight", "grp", "keys", "v")

    def compare(batches):
        import pyarrow as pa
        for table in whole_runs(batches, 3):
            yield _compare(table, threshold, pa)

    found = scratch.keep(dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "cls long, rep long, n long, hub long"), "found")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    links = found.filter("hub is not null").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    labels = components(links, scratch)
    named = classes.join(counts, "cls", "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = scratch.keep(named.select("grp", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    out = rows.join(named, ["grp", "v"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def hash_text(text: str) -> int:
    import zlib
    return zlib.crc32(text.encode()) << 32 | zlib.adler32(text.encode())


def _only_buckets(batches):
    for batch in batches:
        yield batch.select(["bucket"])


def _compare(table, threshold: float, pa):
    """Counts and spanning stars of the links inside the blocks of a table of whole runs."""
    starts = run_starts(table, 3)
    i_, j_, side, tab, rep, cls, weight = (table.column(c).to_numpy() for c in range(1, 8))
    grp = table.column(8).to_pylist()
    key = [np.frombuffer(b, np.int32) for b in table.column(9).to_pylist()]
    vectors = [np.frombuffer(b, np.float64) for b in table.column(10).to_pylist()]
    n = table.num_rows
    name = np.unique(grp, return_inverse=True)[1] if n else np.zeros(0, int)
    dims = np.array([len(v) for v in vectors])
    links_a, links_b = [], []
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        at = np.full(n, -1)
        at[rows] = np.arange(len(rows))
        raw = np.stack([vectors[r] for r in rows])
        x = raw / np.abs(raw).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        bits, match, spread = encode(x)
        steps, low, step = quantise(x, cls[rows])
        codes = np.stack([key[r] for r in rows])
        for a, b in pairs_in_runs(starts, PAIRS):
            ok = (at[a] >= 0) & (at[b] >= 0) & (name[a] == name[b]) & ((i_[a] == j_[a]) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            p, q = at[a], at[b]
            upper = estimate(bits[p], match[p], steps[q], low[q], step[q]) + DEVIATIONS * (spread[p] + step[q] / 2 / match[p])
            ok = upper >= threshold                          # others are out by their bound
            a, b, p, q = a[ok], b[ok], p[ok], q[ok]
            ok = np.zeros(len(a), dtype=bool)
            for lo in range(0, len(a), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                ok[s] = cosine(raw[p[s]], raw[q[s]]) >= threshold
            a, b, p, q = a[ok], b[ok], p[ok], q[ok]
            earlier = codes[p] == codes[q]
            ok = earlier.argmax(axis=1) == tab[a]            # counted in the first table that both share
            links_a.append(a[ok])
            links_b.append(b[ok])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b))
    count = np.zeros(n, dtype=np.int64)
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    root = _roots(a, b, n)
    some = np.flatnonzero(count > 0)
    hub = rep[root[some]]
    return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(rep[some]), pa.array(count[some]), pa.array(hub, mask=hub == rep[some])], ["cls", "rep", "n", "hub"])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of aligned rows in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op3"))


OP3_SQL = """
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
c(vec_id, o) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.vec_id, e.b FROM c JOIN e ON e.a = c.o),
m AS (SELECT vec_id, min(o) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
