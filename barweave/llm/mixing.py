"""Temperature mixing of sources, all in DataFrame operations.

A source's weight is its token share to the power ``alpha``, normalised.  ``alpha`` is bisected in
[0, 1] to the flattest mixture that keeps every source within ``repetition_limit`` epochs of the least
repeated one, or to the mixture of a given entropy.  The budget (by default the smallest that shows
every document at least once) is split by the weights.  A source's documents lie in hash buckets of
about ``bucket_tokens``; every epoch permutes the buckets, and buckets are drawn until the source's
budget is used.  The draws of a source are spread evenly over the output blocks, so that each block has
the target mixture; inside a block, documents of all sources are permuted together.

Texts need no shuffle for planning: it works on token counts.  Prefix sums run in two levels (groups of
about ``GROUP`` buckets, then inside a group), so a source with a third of all rows is split like any
other.  The driver sees ``2**LOOK - 1`` candidate exponents per bisection job, never the sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, without

SEED, REPETITION_LIMIT, BLOCK_TOKENS, BUCKET_TOKENS = "mix", 2.0, 1 << 18, 1 << 11
GROUP, LOOK, STEPS = 4096, 5, 8
_ADDED = ("epoch", "block", "position", "n_tokens")


def word_tokens(text: str = "text") -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text and its end."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def draw(*parts) -> Column:
    """60 bits of md5 of the parts; nulls are skipped."""
    text = F.concat_ws("|", F.lit(SEED), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key(source: str) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def bisect_exponent(shares: DataFrame, repetition_limit: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The smallest exponent whose mixture meets the limits, to 2**-(LOOK*STEPS); 1 when even natural shares do not.

    ``shares`` has one row per source with its share ``p``.  Every job evaluates all midpoints of the next
    ``LOOK`` halvings in one aggregation.
    """
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        points = [lo + (hi - lo) * i / (1 << LOOK) for i in range(1, 1 << LOOK)]
        row = shares.agg(F.min("p"), F.max("p"), *[f for a in points for f in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]).first()
        least, most = row[0], row[1]

        def meets(i: int) -> bool:
            a, z, s = points[i - 1], row[2 * i], row[2 * i + 1]
            if target_entropy is not None:
                return math.log(z) - a * s / z <= target_entropy
            if budget is not None:
                return budget * least ** (a - 1) / z <= repetition_limit
            return (least / most) ** (a - 1) <= repetition_limit

        low, high = 0, 1 << LOOK
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if meets(mid) else (mid, high)
        lo, hi = lo + (hi - lo) * low / (1 << LOOK), lo + (hi - lo) * high / (1 << LOOK)
    return round(hi, 9)


def mixing_plan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repetition_limit: float = REPETITION_LIMIT,
                target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> tuple[DataFrame, DataFrame] | None:
    """(quotas per source, draws of buckets), or None for a table without rows."""
    slim = scratch.keep(docs.select(source_key(source_col).alias("src"), draw(F.col(id_col)).alias("h"), word_tokens(text_col).alias("n_tokens")), "sizes")
    sources = scratch.keep(slim.groupBy("src").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if total is None:
        return None
    alpha = bisect_exponent(sources.select((F.col("tokens") / F.lit(total)).alias("p")), repetition_limit, target_entropy, budget_tokens / total if budget_tokens else None)
    powered = sources.withColumn("power", F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)))
    z = powered.agg(F.sum("power")).first()[0]
    weighed = powered.select("src", "tokens", (F.col("power") / F.lit(z)).alias("weight"))
    budget = float(budget_tokens) if budget_tokens else weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    blocks = max(1, math.ceil(budget / block_tokens - 1e-6))
    quotas = scratch.keep(weighed.select("src", "tokens", "weight", F.ceil(F.col("weight") * F.lit(budget) - 1e-3).cast("long").alias("quota"),
                                         F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(bucket_tokens))).cast("long").alias("buckets"), F.lit(blocks).cast("long").alias("blocks"), F.lit(alpha).alias("alpha")), "quotas")
    bucketed = slim.join(quotas, "src").groupBy("src", (F.col("h") % F.col("buckets")).alias("bucket")).agg(F.sum("n_tokens").alias("size"))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("tokens")).cast("long") - 1)).alias("epoch")
    turns = bucketed.join(quotas, "src").filter("quota > 0").select("*", epochs).withColumn("key", draw(F.col("epoch"), F.col("src"), F.col("bucket")))
    turns = scratch.keep(turns.withColumn("grp", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.ceil(F.col("buckets") / F.lit(GROUP)))), "turns")
    groups = turns.groupBy("src", "epoch", "grp").agg(F.sum("size").alias("grp_size"))
    before = Window.partitionBy("src", "epoch").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = scratch.keep(groups.withColumn("grp_start", F.coalesce(F.sum("grp_size").over(before), F.lit(0))).drop("grp_size"), "groups")
    inside = Window.partitionBy("src", "epoch", "grp").orderBy("key", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(groups, ["src", "epoch", "grp"])
    start = F.col("epoch") * F.col("tokens") + F.col("grp_start") + F.col("inner")
    draws = placed.withColumn("start", start).filter("start < quota").select("src", "bucket", "epoch", F.least(F.floor(F.col("start") / F.col("quota") * F.col("blocks")), F.col("blocks") - 1).alias("block"))
    return quotas, scratch.keep(draws, "draws")


def mix_sources(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """``docs`` as drawn: a row per draw with ``epoch``, ``block``, ``position`` (from 0 in its block) and ``n_tokens``.

    Null texts count as empty (one token), a null source is a source of its own, rows without an id share
    a bucket, repeated rows are drawn together; an empty table gives no rows.  Columns named like an added
    one are replaced.
    """
    base = without(docs, *_ADDED)
    planned = mixing_plan(docs, scratch, id_col, text_col, source_col, **limits)
    added = {"epoch": "long", "block": "long", "position": "long", "n_tokens": "long"}
    if planned is None:
        return base.select("*", *[F.lit(0).cast(t).alias(c) for c, t in added.items()]).limit(0)
    quotas, draws = planned
    rows = base.withColumns({"_src": source_key(source_col), "_h": draw(F.col(id_col)), "n_tokens": word_tokens(text_col)})
    rows = rows.join(quotas.select(F.col("src").alias("_src"), F.col("buckets").alias("_b")), "_src").withColumn("bucket", F.col("_h") % F.col("_b"))
    rows = rows.join(draws.select(F.col("src").alias("_src"), F.col("bucket"), F.col("epoch"), F.col("block")), ["_src", "bucket"])
    order = Window.partitionBy("block").orderBy(draw(F.col("epoch"), F.col(id_col)), id_col, "epoch")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).select(*base.columns, *added)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, Scratch(spark, "op4")).select("doc_id", "source", "epoch", "block", "position", "n_tokens")


def _draw_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


OP4_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce('=' || source, '') AS src, {_draw_sql('doc_id')} AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
s AS MATERIALIZED (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
t AS (SELECT sum(tokens) AS total, min(tokens) / sum(tokens) AS least, max(tokens) / sum(tokens) AS most FROM s),
b(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= {REPETITION_LIMIT} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= {REPETITION_LIMIT} THEN (lo + hi) / 2 ELSE hi END FROM b, t WHERE i < {LOOK * STEPS}),
a AS (SELECT round(hi, 9) AS alpha FROM b WHERE i = {LOOK * STEPS}),
w AS (SELECT src, tokens, pow(tokens / total, alpha) / (SELECT sum(pow(tokens / total, alpha)) FROM s, t, a) AS weight FROM s, t, a),
g AS (SELECT max(tokens / weight) AS budget FROM w),
q AS MATERIALIZED (SELECT src, tokens, CAST(ceil(weight * budget - 1e-3) AS BIGINT) AS quota, CAST(greatest(1, ceil(tokens / {BUCKET_TOKENS})) AS BIGINT) AS buckets,
  CAST(greatest(1, ceil(budget / {BLOCK_TOKENS} - 1e-6)) AS BIGINT) AS blocks FROM w, g),
k AS (SELECT src, h % buckets AS bucket, any_value(tokens) AS tokens, any_value(quota) AS quota, any_value(blocks) AS blocks, CAST(sum(n_tokens) AS BIGINT) AS size FROM d JOIN q USING (src) GROUP BY 1, 2),
e AS (SELECT *, {_draw_sql('epoch', 'src', 'bucket')} AS key FROM (SELECT *, unnest(generate_series(0, CAST(ceil(quota / tokens) AS BIGINT) - 1)) AS epoch FROM k)),
p AS (SELECT *, epoch * tokens + coalesce(CAST(sum(size) OVER (PARTITION BY src, epoch ORDER BY key, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM e),
r AS (SELECT src, bucket, epoch, CAST(least(floor(start / quota * blocks), blocks - 1) AS BIGINT) AS block FROM p WHERE start < quota)
SELECT d.doc_id, d.source, CAST(r.epoch AS BIGINT) AS epoch, r.block,
  row_number() OVER (PARTITION BY r.block ORDER BY {_draw_sql('r.epoch', 'd.doc_id')}, d.doc_id, r.epoch) - 1 AS position, d.n_tokens
FROM d JOIN q USING (src) JOIN r ON r.src = d.src AND r.bucket = d.h % q.buckets
"""
