"""MinHash near-duplicates with HyperMinHash registers.

A document's set is its distinct word shingles.  One hash sends a shingle to one of 256 buckets; a
bucket keeps its smallest value as a register of leading-zero count and ten mantissa bits (16 bits).
Empty buckets borrow registers of others for banding only.  Bands of registers give candidates; the
estimate from equal registers, corrected for the collisions expected of different minima, must not
lie five deviations under the threshold; what passes is confirmed on the full sets.

Documents with equal sets are one class from the start, so copies cost a row each.  No step sends out
all pairs of a group.  First every member of a band bucket is held against the bucket's most connected
member.  Then, only for buckets whose members still lie in several components, members whose estimates
pass are gathered into clusters, and the full sets of a cluster are compared in blocks, counting common
shingles as matrix products; a block sends out a spanning forest of its links.  Every pair that shares a
band is thereby confirmed, rejected by its estimate or on full sets, or already connected, so the
components equal those of all links among them.  At the threshold a pair shares no band with a chance of
about 2e-9.  Blocks hold at most two parts of about ``BLOCK`` rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runs import pairs_in_runs, run_starts, whole_runs
from .scratch import Scratch
from .words import mix, order_by_row, words_of

BUCKETS, MANTISSA, EMPTY = 256, 10, np.uint16(0xFFFF)
BLOCK, SLICE, MISS, TASK_PAIRS = 512, 4096, 1e-8, 1 << 22
_C = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column, width: int = 3):
    """(rows, row, hash) per chunk: the distinct shingles of each text, ascending by (row, hash)."""
    for w in words_of(column):
        h, row = w.hashes(lower=True, seed=11), w.row
        at = np.flatnonzero(row[width - 1:] == row[:len(row) - width + 1]) if len(row) >= width else np.zeros(0, np.int64)
        acc = mix(h[at])
        for j in range(1, width):
            acc = mix(acc * _C + h[at + j])
        rows, sets = [row[at]], [acc]
        first = w.first()
        size = np.diff(first)
        for n in range(1, width):                     # shorter texts: the whole sequence
            r = np.flatnonzero(size == n)
            acc = mix(h[first[r]] + np.uint64(n))
            for j in range(1, n):
                acc = mix(acc * _C + h[first[r] + j])
            rows.append(r)
            sets.append(acc)
        r, s = np.concatenate(rows), np.concatenate(sets)
        o = order_by_row(r, s)
        r, s = r[o], s[o]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        yield w.rows, r[new], s[new]


def registers(rows: int, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """rows x BUCKETS registers of 6 bits of leading zeros and 10 mantissa bits; ``EMPTY`` without a shingle."""
    least = np.full(rows * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, row.astype(np.int64) * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), hashes >> np.uint64(8))
    some = least != np.iinfo(np.uint64).max
    v = (least >> np.uint64(4)) & np.uint64((1 << 52) - 1)
    _, exponent = np.frexp(v.astype(np.float64))          # 52 bits are exact in a double
    zeros = (52 - exponent).astype(np.uint64)
    shift = exponent.astype(np.int64) - 1 - MANTISSA
    mantissa = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(some, (zeros << np.uint64(MANTISSA)) | mantissa, np.uint64(EMPTY)).astype(np.uint16).reshape(rows, BUCKETS)


def densified(regs: np.ndarray, tries: int = 24) -> np.ndarray:
    """Empty buckets take the register of a bucket drawn by a fixed hash of their number, or else of the next full one."""
    out, empty = regs.copy(), regs == EMPTY
    todo = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    if not len(todo):
        return out
    part, gaps = regs[todo], empty[todo]
    fill = part.copy()
    number = np.arange(BUCKETS, dtype=np.uint64)
    for a in range(tries):
        if not gaps.any():
            break
        got = part[:, (mix(number * np.uint64(1000) + np.uint64(a)) & np.uint64(BUCKETS - 1)).astype(np.int64)]
        take = gaps & (got != EMPTY)
        fill[take] = got[take]
        gaps &= ~take
    for step in range(1, BUCKETS):
        if not gaps.any():
            break
        got = np.roll(part, -step, axis=1)
        take = gaps & (got != EMPTY)
        fill[take] = got[take]
        gaps &= ~take
    out[todo] = fill
    return out


def band_rows(percent: int) -> int:
    """The longest bands with which a pair at the threshold shares none with a chance of at most ``MISS``."""
    t = percent / 100
    return max([r for r in range(1, 17) if (1 - t ** r) ** (BUCKETS // r) <= MISS], default=1)


def band_keys(regs: np.ndarray, r: int) -> np.ndarray:
    d = densified(regs).astype(np.uint64)
    bands = BUCKETS // r
    acc = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 20)), (len(regs), bands))
    for j in range(r):
        acc = mix(acc * _C + d[:, j:bands * r:r])
    return acc.view(np.int64) if acc.flags["C_CONTIGUOUS"] else np.ascontiguousarray(acc).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated Jaccard similarity, non-empty buckets of the union) of register rows with set sizes na, nb.

    Two different minima of ``m`` values share a register with the chance summed over leading-zero levels:
    the cell width there times the integral of the product of their densities.
    """
    full = (a != EMPTY) | (b != EMPTY)
    union = full.sum(axis=-1).astype(np.float64)
    equal = ((a == b) & full).sum(axis=-1)
    ma, mb = np.maximum(na / BUCKETS, 1e-9), np.maximum(nb / BUCKETS, 1e-9)
    chance = np.zeros(np.broadcast(ma, mb).shape)
    for z in range(40):
        chance = chance + ma * mb / (ma + mb) * (np.exp(-(ma + mb) * 2.0 ** -(z + 1)) - np.exp(-(ma + mb) * 2.0 ** -z)) * 2.0 ** -(z + 1 + MANTISSA)
    seen = equal / np.maximum(union, 1)
    return np.maximum(0, seen - (1 - seen) * np.minimum(chance, 1)), union


def passes(j: np.ndarray, union: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Not excluded: by set sizes, or by an estimate five deviations under the threshold."""
    t = percent / 100
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (j >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(union, 1)))


def _sketches(batches, width):
    import pyarrow as pa
    for batch in batches:
        at = 0
        for rows, row, h in shingle_sets(batch.column(1), width):
            size = np.bincount(row, minlength=rows)
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            sums = []
            for salt in (0x51ED270B, 0x2545F491):
                total = np.zeros(rows, dtype=np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    total[full] = np.add.reduceat(mix(h + np.uint64(salt)), first[full])
                sums.append(total.view(np.int64))
            regs = registers(rows, row, h)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), _binary(regs)], ["id", "n", "h1", "h2", "regs"])
            at += rows


def _binary(regs: np.ndarray):
    import pyarrow as pa
    size = 2 * BUCKETS
    return pa.Array.from_buffers(pa.binary(), len(regs), [None, pa.py_buffer((np.arange(len(regs) + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(np.ascontiguousarray(regs).tobytes())])


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def _confirm(batches, width, percent):
    """Rows (a, b, text of a, text of b) -> linked pairs, on full sets."""
    import pyarrow as pa
    for batch in batches:
        ok = np.zeros(batch.num_rows, dtype=bool)
        for lo in range(0, batch.num_rows, 256):
            n = min(256, batch.num_rows - lo)
            both = pa.chunked_array([batch.column(2).slice(lo, n), batch.column(3).slice(lo, n)]).combine_chunks()
            sets, at = [], 0
            for rows, row, h in shingle_sets(both, width):
                sets += np.split(h, np.searchsorted(row, np.arange(1, rows)))
            for i in range(n):
                x, y = sets[i], sets[n + i]
                if not len(x) or not len(y):
                    continue
                place = np.searchsorted(y, x)
                inter = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                ok[lo + i] = 100 * inter >= percent * (len(x) + len(y) - inter)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])


def _gather(batches, percent):
    """Sorted rows (block key, side, rep, comp, n, regs, failed) -> (rep, first rep) of sets joined by estimates that pass between components."""
    import pyarrow as pa
    for table in whole_runs(batches, 3):
        starts = run_starts(table, 3)
        rep, comp, n = (table.column(c).to_numpy() for c in (4, 5, 6))
        side, regs, failed = table.column(3).to_numpy(), _regs(table.column(7)), table.column(8).to_pylist()
        i_, j_ = table.column(1).to_numpy(), table.column(2).to_numpy()
        links = [np.zeros((2, 0), dtype=np.int64)]
        names = np.unique(rep)
        number = np.searchsorted(names, rep)
        known = [(x, y) for x, others in zip(number, failed) for y in np.searchsorted(names, np.intersect1d(others or [], names))]
        known = np.unique([min(p) * len(names) + max(p) for p in known]) if known else np.zeros(0, np.int64)
        for a, b in pairs_in_runs(starts, 1 << 13):
            ok = (comp[a] != comp[b]) & ((side[a] != side[b]) | (i_[a] == j_[a]))
            a, b = a[ok], b[ok]
            if len(a):
                j, union = estimate(regs[a], regs[b], n[a], n[b])
                low, high = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
                ok = passes(j, union, n[a], n[b], percent) & (low != high) & ~np.isin(low * len(names) + high, known)
                links.append(np.stack([a[ok], b[ok]]))
        a, b = np.concatenate(links, axis=1)
        root = roots(a, b, table.num_rows)
        some = np.flatnonzero(root != np.arange(table.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]])], ["a", "b"])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable by links (a, b) among n rows."""
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


def common_shingles(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of common shingles of distinct (row, hash) pairs, by products of 0/1 matrices over slices of the shared ones."""
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    at = place[number]
    row, at = row[at >= 0], at[at >= 0]
    total = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, len(shared), SLICE):
        s, e = np.searchsorted(at, [lo, lo + SLICE])
        part = np.zeros((n, SLICE), dtype=np.float32)
        part[row[s:e], at[s:e] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _compare(batches, width, percent):
    """Sorted rows (block key, side, id, comp, text) -> a spanning forest of the links between components inside each block."""
    import pyarrow as pa
    for table in whole_runs(batches, 3):
        for lo, hi in (x for s in [run_starts(table, 3)] for x in zip(s[:-1], s[1:])):
            block = table.slice(lo, hi - lo)
            side, ids, comp = (block.column(c).to_numpy() for c in (3, 4, 5))
            if (comp == comp[0]).all():
                continue
            across = block.column(1)[0].as_py() != block.column(2)[0].as_py()
            rows, hashes, at = [], [], 0
            for n, row, h in shingle_sets(block.column(6), width):
                rows.append(row + at)
                hashes.append(h)
                at += n
            row, h = np.concatenate(rows), np.concatenate(hashes)
            size = np.bincount(row, minlength=at)
            common = common_shingles(row, h, at)
            linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (common > 0) & (comp[:, None] != comp[None, :])
            if across:
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked, 1))
            root = roots(a, b, at)
            some = np.flatnonzero(root != np.arange(at))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], ["a", "b"])


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts that are null or without words have the empty set and link with nothing.  Rows without an id
    link with nothing, have no component and are kept.  Rows that share an id count as one document: it
    links where any of its texts does, and all its rows have its component.  Other columns are ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    r = band_rows(percent)
    sketch = scratch.keep(texts.mapInArrow(lambda b: _sketches(b, width), "id long, n long, h1 long, h2 long, regs binary"), "sketches")
    reps = sketch.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    reps = scratch.keep(reps, "classes")

    def to_bands(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_regs(batch.column(1)), r)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["band", "rep"])

    bands = reps.select("rep", "regs").mapInArrow(to_bands, "band long, rep long")
    shared = bands.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    members = scratch.keep(bands.join(shared, "band"), "members")
    popular = members.groupBy("rep").agg(F.sum("c").alias("deg"))
    hubs = members.join(popular, "rep").groupBy("band").agg(F.max(F.struct("deg", -F.col("rep"))).alias("top")).select("band", (-F.col("top.col2")).alias("hub"))
    hubs = scratch.keep(hubs, "hubs")
    star = members.select("band", "rep").join(hubs, "band").filter("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))

    def screen(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                ok = np.zeros(batch.num_rows, dtype=bool)
                for lo in range(0, batch.num_rows, 2048):
                    k = slice(lo, lo + 2048)
                    j, union = estimate(_regs(batch.column(3).slice(lo, 2048)), _regs(batch.column(5).slice(lo, 2048)), na[k], nb[k])
                    ok[k] = passes(j, union, na[k], nb[k], percent)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    pairs = scratch.keep(star, "star").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ra", "nb", "rb")
    fresh = scratch.keep(pairs.mapInArrow(screen, "a long, b long"), "candidates")

    def confirm(candidates: DataFrame) -> DataFrame:
        ids = scratch.keep(candidates.select(F.col("a").alias("id")).unionAll(candidates.select("b")).distinct(), "ids")
        own = scratch.keep(texts.join(ids, "id"), "texts")
        ta, tb = own.select(F.col("id").alias("a"), F.col("text").alias("ta")), own.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        tested = candidates.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        done = scratch.keep(tested.mapInArrow(lambda x: _confirm(x, width, percent), "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "tested")
        scratch.drop(own, ids)
        return done

    def blocks(rows: DataFrame, group: str, item: str, count: str, *cols: str) -> DataFrame:
        """Rows of a group dealt into blocks (i, j) of its parts, sorted by block."""
        parts = F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")
        d = rows.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64(item), "parts").cast("int"))
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        d = d.select(group, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", item, *cols)
        # as many partitions as the pairs ask for; a given number is not merged into few long tasks
        pairs = rows.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] / 2
        tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
        return d.repartition(tasks, group, "i", "j").sortWithinPartitions(group, "i", "j")

    tested, labels = confirm(fresh), None
    links = tested.filter("linked").select("a", "b")
    labels = components(links, scratch)
    part_of = labels.select(F.col("node").alias("rep"), "component")
    # buckets of two were tested whole; others only matter while they span components
    rows = scratch.keep(members.filter("c > 2").join(part_of, "rep", "left").select("band", "rep", "c", F.coalesce("component", "rep").alias("comp")), "open")
    mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    # a failed pair is noted at the member that is not the hub: one a band, so a list is never longer than the bands
    unlinked = tested.filter("not linked").select("a", "b")
    noted = members.select("band", "rep").join(hubs, "band").filter("rep != hub").select("rep", F.col("hub").alias("other")).distinct()
    failed = noted.join(unlinked, (F.least("rep", "other") == F.col("a")) & (F.greatest("rep", "other") == F.col("b")))
    failed = failed.groupBy("rep").agg(F.collect_list("other").alias("failed"))
    own = rows.join(mixed, "band").join(reps.select("rep", "n", "regs"), "rep").join(failed, "rep", "left")
    near = scratch.keep(blocks(own, "band", "rep", "c", "comp", "n", "regs", "failed").mapInArrow(lambda b: _gather(b, percent), "a long, b long").distinct(), "near")
    if not near.isEmpty():
        cluster = components(near, scratch)
        size = cluster.groupBy("component").agg(F.count("*").alias("c"))
        cluster = scratch.keep(cluster.join(size, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"), "c"), "clusters")
        own = cluster.join(part_of.withColumnRenamed("rep", "id"), "id", "left").select("id", "cluster", "c", F.coalesce("component", "id").alias("comp")).join(texts, "id")
        more = scratch.keep(blocks(own, "cluster", "id", "c", "comp", "text").mapInArrow(lambda b: _compare(b, width, percent), "a long, b long"), "more-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
    named = reps.select("h1", "h2", "n", "rep")
    named = named.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = scratch.keep(named.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component")), "components")
    out = sketch.select("id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, Scratch(spark, "op5"), width=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.k >= 85 * (na.n + nb.n - x.k)),
c(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.o),
m AS (SELECT doc_id, min(o) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
