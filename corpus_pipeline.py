"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet in the shared
folder and hands the reread table to the next, so a lost executor never costs more than one stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.llm.minhash import near_duplicates
from barweave.llm.mixing import mix_sources
from barweave.llm.packing import pack_documents
from barweave.llm.pii import replace_personal_data
from barweave.llm.scratch import Scratch
from barweave.llm.toxicity import THRESHOLD, held_out, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    machine = train_toxicity(docs, labels, Scratch(spark, "toxicity"))
    scored = score_toxicity(docs, machine, name="_score")
    return scored.filter(F.col("_score") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group (similarity 0.8 over five-word shingles): the smallest id, and one row of it.

    A document is an id with a text: where an id repeats with different texts, each is judged by itself
    (and comes before the others of its group).  Rows without words and rows without an id stay.
    """
    scratch = Scratch(spark, "dedup")
    rows = docs.withColumn("_rid", F.col("doc_id").cast("long"))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = scratch.keep(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min(digest).alias("lo"), F.max(digest).alias("hi"))
                            .filter("c > 1").select(F.col("doc_id").alias("_id"), (F.col("lo") != F.col("hi")).alias("_several")), "repeated")
    single = repeated.isEmpty()
    if not single:
        own = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 61))
        rows = rows.join(repeated, F.col("doc_id") == F.col("_id"), "left").withColumn("_rid", F.when(F.col("_several"), own).otherwise(F.col("_rid")))
    found = scratch.keep(near_duplicates(rows, scratch, id_col="_rid"), "groups")
    gone = found.filter("not kept").select("_rid").distinct()
    kept = rows.join(gone, "_rid", "left_anti")
    if single:
        return kept.select(*docs.columns)
    again = found.filter("kept and _rid is not null and n_shingles > 0").groupBy("_rid").count().filter("count > 1").select("_rid")
    again = scratch.keep(again, "equal-rows")
    row = Window.partitionBy("_rid").orderBy(*[c for c in docs.columns if c != "doc_id"])
    first = kept.join(again, "_rid", "left_semi").withColumn("_row", F.row_number().over(row)).filter("_row = 1").select(*docs.columns)
    return kept.join(again, "_rid", "left_anti").select(*docs.columns).unionByName(first)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the changed texts."""
    out = replace_personal_data(docs, Scratch(spark, "pii"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as drawn for the target mixture, in block order; every document is drawn at least once."""
    drawn = mix_sources(docs, Scratch(spark, "mix"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartitionByRange(parts, "block", "position").sortWithinPartitions("block", "position").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences with their ids."""
    import public_tokenizers
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "pack"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("surrogates", replace_private), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None          # a fitted model decides the first stage; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
