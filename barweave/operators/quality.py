"""Data-quality checks per symbol with a 0-100 score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from ..sources.bars import OHLCV, seconds
from .blocks import BLOCK, block_window, close_blocks, exact_percentiles, open_blocks

REQUIRED = ("ts", *OHLCV)


def schema_issues(df: DataFrame) -> list[tuple[str, float]]:
    """Missing or non-numeric columns; a question of the schema, no job runs."""
    issues = []
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        issues.append((f"missing columns: {', '.join(missing)}", 30.0))
    for c in OHLCV:
        if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType):
            issues.append((f"column {c} is not numeric", 10.0))
    return issues


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def as_numbers(df: DataFrame) -> DataFrame:
    """All required columns: missing ones are null, others that are not numeric are read as numbers where they can be."""
    made = {c: F.lit(None).cast("double") for c in OHLCV if c not in df.columns}
    made |= {c: F.col(c).cast("string").try_cast("double") for c in OHLCV if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)}
    if "ts" not in df.columns:
        made["ts"] = F.lit(None).cast("timestamp_ntz")
    return df.withColumns(made) if made else df


def checks(bars: DataFrame, key: Sequence[str], gap: float = 3.0, z: float = 5.0, size: int = BLOCK) -> DataFrame:
    """One row of counts per key.  ``bars`` carries ``rn``; duplicates in time are allowed.

    The rows go through one shuffle; spacings and returns are then read from a narrow staged copy, and
    the median spacing is selected by rank among counted spacings.
    """
    key = list(key)
    bars = as_numbers(bars)
    d = open_blocks(bars, 1, size)
    w = block_window(key)
    pc = F.lag("close").over(w)
    d = close_blocks(d.withColumns({
        "_gap": seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w),
        "_ret": (F.col("close") - pc) / F.nullif(pc, F.lit(0.0))}))
    d = stage(d.select(*key, "ts", *OHLCV, "_gap", "_ret"))
    c = {n: F.col(n) for n in OHLCV}
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(c[n] <= 0).alias(f"nonpos_{n}") for n in OHLCV[:4]]
    counts += [F.count_if(c["volume"] < 0).alias("neg_volume"),
               F.count_if(c["high"] < c["low"]).alias("high_below_low"),
               F.count_if((c["high"] < c["open"]) | (c["high"] < c["close"])).alias("high_below_body"),
               F.count_if((c["low"] > c["open"]) | (c["low"] > c["close"])).alias("low_above_body"),
               # positions follow time, so equal neighbours are exactly the duplicates
               F.count_if(F.col("_gap") == 0).alias("dup_ts")]
    counts += [F.count_if(c[n].isNull() | F.isnan(c[n])).alias(f"null_{n}") for n in OHLCV]
    counts += [F.count_if(F.abs(c[n]) == float("inf")).alias(f"inf_{n}") for n in OHLCV]
    counts += [F.avg("_ret").alias("_mr"), F.stddev_samp("_ret").alias("_sr"),
               F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("close").alias("close_mean"),
               F.min("close").alias("close_min"), F.max("close").alias("close_max"), F.sum("volume").alias("volume_total")]
    a = d.groupBy(*key).agg(*counts)
    middle = exact_percentiles(d.select(*key, "_gap"), key, "_gap", {"_mg": 0.5})
    a = stage(a.join(middle, key, "left"))
    odd = d.select(*key, "_gap", "_ret").join(a.select(*key, "_mg", "_mr", "_sr", "rows"), key).groupBy(*key).agg(
        F.count_if(F.col("_gap") > F.col("_mg") * gap).alias("gaps"),
        F.count_if((F.col("rows") >= 5) & (F.col("_sr") >= 1e-10)
                   & (F.abs((F.col("_ret") - F.col("_mr")) / F.nullif(F.col("_sr"), F.lit(0.0))) > z)).alias("outliers"))
    return a.drop("_mg", "_mr", "_sr").join(odd, key)


def quality_report(bars: DataFrame, key: Sequence[str], gap: float = 3.0, z: float = 5.0,
                   size: int = BLOCK) -> DataFrame:
    """Score = 100 minus the deductions; issues are serious, warnings are not; passed at 50.

    Missing and non-numeric columns count in every key's score; a missing column has no other checks.
    """
    a = checks(bars, key, gap, z, size)
    rows = F.col("rows")
    shape = schema_issues(bars)
    ded, issues, warnings = [F.lit(amount) for _, amount in shape], [F.lit(text) for text, _ in shape], []
    present = [c for c in OHLCV if c in bars.columns]

    def rule(cond: Column, amount, text: Column, serious: bool) -> None:
        ded.append(F.when(cond, amount if isinstance(amount, Column) else F.lit(float(amount))).otherwise(0.0))
        (issues if serious else warnings).append(F.when(cond, text))

    for n in OHLCV[:4]:
        rule(F.col(f"nonpos_{n}") > 0, 10, F.format_string(f"%d non-positive {n}", f"nonpos_{n}"), True)
    rule(F.col("neg_volume") > 0, 5, F.format_string("%d negative volume", "neg_volume"), True)
    rule(F.col("high_below_low") > 0, 10, F.format_string("%d high below low", "high_below_low"), True)
    rule(F.col("high_below_body") > 0, 3, F.format_string("%d high below open or close", "high_below_body"), False)
    rule(F.col("low_above_body") > 0, 3, F.format_string("%d low above open or close", "low_above_body"), False)
    rule(F.col("dup_ts") > 0, 5, F.format_string("%d duplicate times", "dup_ts"), True)
    rule(F.col("gaps") > 0, F.least(F.lit(20.0), F.col("gaps") / rows * 200.0), F.format_string("%d gaps", "gaps"), False)
    rule(F.col("outliers") > 0, F.least(F.lit(10.0), F.col("outliers") * 2.0),
         F.format_string("%d extreme returns", "outliers"), False)
    for n in present:
        rule(F.col(f"null_{n}") > 0, 5, F.format_string(f"%d null {n}", f"null_{n}"), True)
        rule(F.col(f"inf_{n}") > 0, 5, F.format_string(f"%d infinite {n}", f"inf_{n}"), True)
    total = sum(ded, F.lit(0.0))
    return a.withColumns({"score": F.greatest(F.lit(0.0), 100.0 - total), "issues": F.array_compact(F.array(*issues)),
                          "warnings": F.array_compact(F.array(*warnings))}).withColumn("passed", F.col("score") >= 50)
