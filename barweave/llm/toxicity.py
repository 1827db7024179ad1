"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words without outer punctuation and their four- and five-byte
heads, hashed into ``2**BITS`` buckets; a text is the set of its terms, scaled to length one.  The
score is ``sigmoid(bias + <w, x> + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2))``: the factors
let a pair of terms count more than both alone.

The machine is fitted on at most ``per_class`` labelled texts of either class, chosen by a hash of the
id, so fitting is bounded at any size; scoring is one pass over all rows without a shuffle.  The model
(at most ``2**BITS`` terms) is the only thing sent to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, without
from .words import _LOWER, hash_spans, words_of

BITS, FACTORS, PER_CLASS, THRESHOLD, RATE = 20, 6, 3000, 0.7, 20.0
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?\"'()[]{}<>*#&%$-_/\\|")] = True


@dataclass
class Machine:
    bias: float
    place: np.ndarray           # bucket -> row of the weights, or -1
    scale: np.ndarray           # value of the term before the text's set is scaled: its class log odds
    linear: np.ndarray
    factors: np.ndarray


def text_terms(column):
    """(first row, rows, row of term, bucket) per chunk; a text's terms are distinct and ascending."""
    for w in words_of(column):
        start, end = w.start.copy(), w.end.copy()
        for _ in range(5):
            end -= (end > start) & _PUNCT[w.data[np.maximum(end - 1, 0)]]
            start += (end > start) & _PUNCT[w.data[np.minimum(start, max(len(w.data) - 1, 0))]]
        some = end > start
        start, end, row = start[some], end[some], w.row[some]
        data = _LOWER[w.data]
        size = end - start
        parts = [(row, hash_spans(data, start, end, 1))]
        for head in (4, 5):
            k = size >= head
            parts.append((row[k], hash_spans(data, start[k], start[k] + head, head)))
        key = np.concatenate([(r.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for r, h in parts])
        key = np.unique(key)
        yield w.lo, w.rows, key >> BITS, key & ((1 << BITS) - 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; ``first`` has one more entry than runs."""
    total = np.zeros((len(first) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, first[full], axis=0)
    return total


def fit(texts: list[np.ndarray], toxic: np.ndarray, factors: int = FACTORS, rounds: int = 16, seed: int = 7, least: int = 3, prior: float = 1.0, decay: float = 2e-3) -> Machine:
    """Fit on bucket sets by averaged gradient steps; terms seen in fewer than ``least`` texts are left out.

    A term's value is its smoothed log odds between the classes squared, so that the many terms
    that a few texts share by chance hardly count.
    """
    n1 = float(toxic.sum())
    n0 = len(toxic) - n1
    share = n1 / len(toxic) if len(toxic) else 0.0
    every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    label = np.repeat(toxic, [len(t) for t in texts]) if texts else np.zeros(0)
    count = np.bincount(every, minlength=1 << BITS)
    in1 = np.bincount(every, weights=label, minlength=1 << BITS)
    chosen = np.flatnonzero(count >= least)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    half = min(n1, n0) or 1.0
    p1, p0 = (in1[chosen] * half / max(n1, 1) + prior), ((count - in1)[chosen] * half / max(n0, 1) + prior)
    scale = (np.log(p1 / p0) ** 2).astype(np.float32)
    rng = np.random.default_rng(seed)
    table = np.concatenate([np.zeros((len(chosen), 1)), rng.normal(0, 0.02, (len(chosen), factors))], axis=1).astype(np.float32)
    m = Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), place, scale, table[:, 0], table[:, 1:])
    if not len(chosen) or share in (0.0, 1.0):
        return m
    sets = [place[t][place[t] >= 0] for t in texts]
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    m.bias = 0.0
    for _ in range(rounds):
        for pick in np.array_split(rng.permutation(len(sets)), max(1, len(sets) // 100)):
            size = np.array([len(sets[i]) for i in pick])
            first = np.concatenate([[0], np.cumsum(size)])
            term = np.concatenate([sets[i] for i in pick])
            x = scale[term] * np.repeat(1 / np.sqrt(np.maximum(size, 1)), size).astype(np.float32)
            y, inner = _raw(table, m.bias, term, x, first)
            pull = weight[pick] * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic[pick]) / len(pick)
            g = np.repeat(pull, size)[:, None] * x[:, None]
            grad = np.concatenate([g, g * (np.repeat(inner, size, axis=0) - table[term, 1:] * x[:, None])], axis=1)
            order = np.argsort(term, kind="stable")
            seen, at = np.unique(term[order], return_index=True)
            grad = np.add.reduceat(grad[order], at, axis=0) + decay * table[seen] / len(sets) * len(pick)
            table[seen] -= RATE * grad
            m.bias -= RATE * float(pull.sum())
    m.linear, m.factors = table[:, 0].copy(), table[:, 1:].copy()
    return m


def _raw(table, bias, term, x, first):
    v = table[term] * x[:, None]
    total = _sums(v, first)
    inner = total[:, 1:]
    square = _sums((v[:, 1:] ** 2).sum(axis=1), first)
    return bias + total[:, 0] + 0.5 * ((inner ** 2).sum(axis=1) - square), inner


def score_column(column, m: Machine) -> np.ndarray:
    table = np.concatenate([m.linear[:, None], m.factors], axis=1)
    out = [np.zeros(0)]
    for _, rows, row, bucket in text_terms(column):
        term = m.place[bucket]
        known = term >= 0
        row, term = row[known], term[known]
        first = np.searchsorted(row, np.arange(rows + 1))
        x = m.scale[term] * np.repeat(1 / np.sqrt(np.maximum(np.diff(first), 1)), np.diff(first)).astype(np.float32)
        y, _ = _raw(table, m.bias, term, x, first) if len(term) else (np.full(rows, m.bias), None)
        out.append(1 / (1 + np.exp(-np.clip(y.astype(np.float64), -500, 500))))
    return np.concatenate(out)


def train_toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Machine:
    """Fit on the ``per_class`` labelled ids of each class with the smallest hash.

    Null ids and labels are left out; an id labelled more than once counts as toxic if any label
    says so.  Without labels, or with one class only, the score is constant.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = scratch.keep(picked, "picked")              # at most 2 * per_class rows of 12 bytes
    chosen = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "k")

    def terms(batches):
        import pyarrow as pa
        for batch in batches:
            sets = []
            for _, rows, row, bucket in text_terms(batch.column(1)):
                sets += [s.astype("<i4").tobytes() for s in np.split(bucket, np.searchsorted(row, np.arange(1, rows)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], ["k", "y", "terms"])

    def learn(batches):
        import pyarrow as pa
        rows = sorted(((k, y, t) for b in batches for k, y, t in zip(*(b.column(c).to_pylist() for c in range(3)))), key=lambda r: (r[0], r[2]))
        m = fit([np.frombuffer(t, "<i4").astype(np.int64) for _, _, t in rows], np.array([y for _, y, _ in rows], dtype=np.float64))
        yield pa.RecordBatch.from_pydict({"bias": [m.bias], "place": [np.flatnonzero(m.place >= 0).astype("<i4").tobytes()], "scale": [m.scale.astype("<f4").tobytes()], "linear": [m.linear.astype("<f4").tobytes()], "factors": [m.factors.astype("<f4").tobytes()]})

    sample = scratch.keep(chosen.mapInArrow(terms, "k long, y int, terms binary"), "sample")
    model = scratch.keep(sample.repartition(1).mapInArrow(learn, "bias double, place binary, scale binary, linear binary, factors binary"), "model").first()
    if model is None:
        return Machine(-7.0, np.full(1 << BITS, -1, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    chosen = np.frombuffer(model["place"], "<i4")
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    return Machine(model["bias"], place, np.frombuffer(model["scale"], "<f4"), np.frombuffer(model["linear"], "<f4"), np.frombuffer(model["factors"], "<f4").reshape(len(chosen), FACTORS))


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (double, 0 to 1) of every whole text; a null text scores as an empty one.  A clashing column is replaced."""
    base = without(docs, name)
    at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_column(batch.column(at), shared.value))], [*batch.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    machine = train_toxicity(docs, labels, Scratch(spark, "op7"))
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
