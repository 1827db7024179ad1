"""Session settings and the one place where a plan is cut into stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # summaries join back on keys that may be hot: split them even at the price of a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # wide window plans make methods that the JVM never compiles; beyond its limit the split form is faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "barweave", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves local sessions (tests); on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barweave-"))
    return sc.getCheckpointDir().rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/barweave/{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet below the checkpoint folder and read it back.

    Used where a plan reads the same intermediate several times (block summaries joined back
    to their rows).  The copy survives lost executors, keeps column pruning and filter
    pushdown for the later stages, and gives the optimizer real sizes for its join choices.
    """
    path = f"{stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete everything this application staged; results that still read it become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
