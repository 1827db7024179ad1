"""Importance resampling: Gumbel top-k over the ratio of two hashed n-gram models.

The target model counts hashed words and word pairs of target texts (a bounded, documented sample of
labelled rows), the raw model those of every text.  A text's log weight is the sum over its n-grams of
``log p_target - log p_raw`` (both smoothed); adding standard Gumbel noise and keeping the k largest
draws k texts without replacement in proportion to their weights.

Two passes over the texts, no shuffle of texts: tasks send one row per non-empty bucket.  The k-th
largest key is found by narrowing a histogram, exactly, on (id, key) rows; equal keys at the border
are all kept.  Noise depends on seed and id only, so retries and partitions change nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, without
from .words import mix, words_of

BITS, SMOOTHING, TARGET_ROWS, KEEP_SHARE, SEED = 15, 0.5, 6000, 0.9, 20
_BUCKETS = 1 << BITS
SLICE, FINAL = 1024, 4096


def ngram_buckets(column):
    """(rows, row, bucket) of the lower-cased words and word pairs of each chunk of texts."""
    for w in words_of(column):
        h = w.hashes(lower=True, seed=3)
        pair = w.row[1:] == w.row[:-1]
        both = mix(h[:-1][pair] * np.uint64(0x9FB21C651E98DF25) + h[1:][pair])
        yield w.rows, np.concatenate([w.row, w.row[:-1][pair]]), (np.concatenate([h, both]) >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over every text of a one-column frame."""
    def count(batches):
        import pyarrow as pa
        total = np.zeros(_BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in ngram_buckets(batch.column(0)):
                total += np.bincount(bucket, minlength=_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """log p_target - log p_raw per bucket; the driver gets the ``2**BITS`` counts of each."""
    p = []
    for df in (target, raw):
        n = np.full(_BUCKETS, SMOOTHING)
        for r in df.collect():
            n[r["bucket"]] += r["n"]
        p.append(np.log(n / n.sum()))
    return p[0] - p[1]


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_ngrams`` and ``log_weight``; a text without words has no weight (null)."""
    base = without(docs, "n_ngrams", "log_weight")
    at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n, s = [np.zeros(0, np.int64)], [np.zeros(0)]
            for rows, row, bucket in ngram_buckets(batch.column(at)):
                n.append(np.bincount(row, minlength=rows))
                s.append(np.bincount(row, weights=shared.value[bucket], minlength=rows))
            n, s = np.concatenate(n), np.concatenate(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(s, mask=n == 0)], [*batch.schema.names, "n_ngrams", "log_weight"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def gumbel(seed: int, id_col: str):
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col(id_col)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, name: str, k: int) -> float | None:
    """The k-th largest non-null value, by narrowing a histogram of ``SLICE`` slices until at most ``FINAL`` values are left."""
    keys = keys.select(F.col(name).alias("v")).filter("v is not null")
    n, lo, hi = keys.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if k <= 0 or n == 0:
        return None
    if k >= n:
        return lo
    left, above = n, 0                                   # values in [lo, hi], values above hi
    while left > FINAL and hi > lo:
        width = (hi - lo) / SLICE
        if width == 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col("v") - lo) / width), F.lit(SLICE - 1))
        rows = sorted(keys.filter(F.col("v").between(lo, hi)).groupBy(at.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: -r["s"])
        for r in rows:                                   # at most SLICE rows
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] == left:
            lo, hi = r["lo"], r["hi"]
            if hi - lo >= width * SLICE * 0.999:
                break
        left, lo, hi = r["n"], r["lo"], r["hi"]
    if hi == lo:
        return lo
    counted = keys.filter(F.col("v").between(lo, hi)).groupBy("v").count().orderBy(F.desc("v"))
    for r in counted.toLocalIterator():
        above += r["count"]
        if above >= k:
            return r["v"]
    return lo


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_ngrams, log_weight, key, kept (among the ``keep_share`` of all rows with the largest keys).

    ``target`` holds the target texts.  Null and empty texts have no weight and are never drawn; a
    null id draws the same noise as other null ids; repeated rows share their key.
    """
    ratio = log_ratios(bucket_counts(target.select(F.col(text_col).cast("string"))), bucket_counts(docs.select(F.col(text_col).cast("string"))))
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    weighed = log_weights(slim, ratio, text_col).drop(text_col)
    scored = scratch.keep(weighed.withColumn("key", F.col("log_weight") + gumbel(seed, id_col)), "scored")
    k = int(np.ceil(keep_share * scored.count()))
    border = kth_largest(scored, "key", k)
    return scored.withColumn("kept", F.coalesce(F.col("key") >= F.lit(border).cast("double"), F.lit(False)))


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    scratch = Scratch(spark, "op10")
    good = scratch.keep(good, "target")                  # at most TARGET_ROWS ids
    return resample(docs, docs.join(F.broadcast(good), "doc_id", "left_semi"), scratch)
