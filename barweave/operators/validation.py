"""Out-of-sample splits, rolling folds, walk-forward search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import BLOCK, running, span
from .metrics import performance
from .positions import equity_curve, round_trips
from .signals import signals_from_masks
from .sweep import ma_cross_flags

# Trading bars per day by interval.
TRADING_BARS_PER_DAY = {"1m": 390.0, "5m": 78.0, "15m": 26.0, "30m": 13.0, "1h": 7.0, "2h": 3.0, "4h": 2.0, "6h": 1.0,
                        "8h": 1.0, "1d": 1.0, "1w": 0.2, "1M": 0.05}


def holdout_split(bars: DataFrame, ratio: float = 0.7, n: str = "n") -> DataFrame:
    """Tag rows in/out of sample at ``int(n*ratio)``; positions restart in the later part."""
    cut = F.greatest(F.lit(1), F.least(F.col(n) - 1, F.floor(F.col(n) * F.lit(ratio))))
    first = F.col("rn") <= cut
    return bars.withColumns({"part": F.when(first, "in").otherwise("out"), "part_rn": F.when(first, F.col("rn")).otherwise(F.col("rn") - cut)})


def holdout_verdict(ins: DataFrame, oos: DataFrame, key: Sequence[str]) -> DataFrame:
    a = ins.select(*key, F.col("sharpe_ratio").alias("in_sharpe"), F.col("total_return_pct").alias("in_return_pct"))
    b = oos.select(*key, F.col("sharpe_ratio").alias("out_sharpe"), F.col("total_return_pct").alias("out_return_pct"))
    v = (F.when(F.col("in_sharpe").isNull() | F.col("out_sharpe").isNull(), "insufficient_data")
         .when(F.col("out_return_pct") < 0, "failed")
         .when((F.col("in_sharpe") > 0.1) & (F.col("out_sharpe") < F.col("in_sharpe") * 0.5), "degraded").otherwise("stable"))
    return a.join(b, list(key), "full").withColumn("verdict", v)


def make_folds(bars: DataFrame, key: Sequence[str], window: int = 252, step: int = 63, interval: str = "1d") -> DataFrame:
    """Rolling train/test windows per key; short series fall back to 60 % / 20 %."""
    n = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    cpd = TRADING_BARS_PER_DAY.get(interval, 1.0)
    w, s = F.lit(window), F.lit(step)
    if cpd > 1:
        w = F.least(F.lit(int(window * cpd)), F.floor(F.col("n") * 0.75))
        s = F.lit(max(1, int(step * cpd)))
    d = n.withColumns({"_w": w.cast("long"), "_s": s.cast("long")})
    short = (F.col("n") < F.col("_w") + F.col("_s")) | (F.floor((F.col("n") - F.col("_w")) / F.col("_s")) < 2)
    d = d.withColumns({"win": F.when(short, F.floor(F.col("n") * 0.60)).otherwise(F.col("_w")).cast("long"),
                       "step": F.when(short, F.greatest(F.lit(1), F.floor(F.col("n") * 0.20))).otherwise(F.col("_s")).cast("long")})
    d = d.filter(F.col("n") >= F.col("win") + F.col("step"))
    folds = F.floor((F.col("n") - F.col("win") - F.col("step")) / F.col("step"))
    return (d.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), folds.cast("long"))))
            .select(*key, "fold", (F.col("fold") * F.col("step")).alias("train_start"),
                    (F.col("fold") * F.col("step") + F.col("win")).alias("test_start"),
                    (F.col("fold") * F.col("step") + F.col("win") + F.col("step")).alias("test_end"), "win", "step", "n"))


def assign_folds(bars: DataFrame, folds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Copy each bar into the folds that contain it.

    Folds are evenly spaced, so the folds of a row are an interval of numbers: the row
    explodes into exactly those -- an equi-join on the key instead of a range join.
    """
    key = list(key)
    plan = folds.groupBy(*key).agg(F.max("fold").alias("_last"), F.max("win").alias("_w"), F.max("step").alias("_s"))
    i = F.col("rn") - 1
    lo = F.greatest(F.lit(0), F.ceil((i - F.col("_w") - F.col("_s") + 1) / F.col("_s"))).cast("long")
    hi = F.least(F.col("_last"), F.floor(i / F.col("_s"))).cast("long")
    d = bars.join(plan, key).filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    at = i - F.col("fold") * F.col("_s")
    return d.withColumns({"part": F.when(at < F.col("_w"), "train").otherwise("test"),
                          "rn": F.when(at < F.col("_w"), at + 1).otherwise(at - F.col("_w") + 1)}).drop("_last", "_w", "_s")


def walk_forward(bars: DataFrame, grid: DataFrame, key: Sequence[str], window: int = 252, step: int = 63,
                 interval: str = "1d", capital: float = 100_000.0, size: int = BLOCK) -> DataFrame:
    """Moving-average grid search inside each train window, best set applied to its test window.

    Every (key, fold, part, parameter set) is one group of rows; all run in the same plan.
    ``grid``: ``param_id, fast, slow``; ties keep the smallest ``param_id``.
    """
    key = list(key)
    seg = assign_folds(bars.select(*key, "rn", "ts", "open", "high", "low", "close", "volume"),
                       make_folds(bars, key, window, step, interval), key)
    k3 = [*key, "fold", "part"]
    flags = ma_cross_flags(stage(seg), k3, grid, size=size)
    k4 = [*k3, "param_id"]
    sig = stage(signals_from_masks(flags, k4, size=size))
    m = performance(stage(equity_curve(sig, k4, capital, size=size)), round_trips(sig, k4, size=size), k4, size)
    m = stage(m.select(*k4, "sharpe_ratio", "total_return_pct", "max_drawdown_pct", "num_trades", "win_rate"))
    best = m.filter("part = 'train'").groupBy(*key, "fold").agg(
        F.max_by(F.struct("param_id", "sharpe_ratio"), F.struct("sharpe_ratio", (-F.col("param_id")).alias("_t"))).alias("_b"))
    best = best.select(*key, "fold", F.col("_b.param_id").alias("param_id"), F.round("_b.sharpe_ratio", 3).alias("train_sharpe"))
    test = m.filter("part = 'test'").drop("part")
    return best.join(test, [*key, "fold", "param_id"]).select(
        *key, "fold", "param_id", "train_sharpe", F.round("total_return_pct", 3).alias("return_pct"),
        F.round("sharpe_ratio", 3).alias("sharpe"), F.round("max_drawdown_pct", 3).alias("max_dd_pct"), "num_trades", "win_rate")


def stitch_equity(segments: DataFrame, key: Sequence[str], capital: float = 10_000.0) -> DataFrame:
    """Chain fold curves: each is scaled to start where the one before ended.

    ``segments``: ``fold, rn, ts, equity`` with row 0 as the start of a fold.
    """
    key = list(key)
    ends = segments.groupBy(*key, "fold").agg((F.max_by("equity", "rn") / F.nullif(F.min_by("equity", "rn"), F.lit(0.0))).alias("_g"),
                                              F.min_by("equity", "rn").alias("_e0"))
    before = span(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)     # one row per fold
    ends = ends.withColumn("_f", F.lit(capital) * F.exp(F.coalesce(F.sum(F.ln("_g")).over(before), F.lit(0.0))) / F.col("_e0"))
    d = segments.join(ends.select(*key, "fold", "_f"), [*key, "fold"])
    return d.filter("rn >= 1").withColumn("equity", F.col("equity") * F.col("_f")).drop("_f")


def wfe(folds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Walk-forward efficiency: mean out-of-sample over mean in-sample Sharpe, within [0, 2]."""
    a = folds.groupBy(*key).agg(F.count(F.lit(1)).alias("folds"), F.avg("train_sharpe").alias("mean_is"), F.avg("sharpe").alias("mean_oos"))
    r = F.least(F.greatest(F.col("mean_oos") / F.nullif(F.col("mean_is"), F.lit(0.0)), F.lit(0.0)), F.lit(2.0))
    return a.withColumn("wfe", F.when(F.col("mean_is") > 0.05, F.round(r, 4)))


def tag_oos(df: DataFrame, split: Column) -> DataFrame:
    return df.withColumn("sample", F.when(F.col("ts") >= split, "out").otherwise("in"))
