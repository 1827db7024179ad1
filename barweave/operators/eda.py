"""Exploratory statistics per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import OHLCV, seconds
from .blocks import BLOCK, block_window, close_blocks, exact_percentiles, open_blocks, span
from .indicators import open_panel, use


def returns(bars: DataFrame, key: Sequence[str], size: int = BLOCK, halo: int = 1) -> DataFrame:
    d = open_blocks(bars, halo, size)
    pc = F.lag("close").over(block_window(key))
    return close_blocks(d.withColumns({"ret": (F.col("close") - pc) / F.nullif(pc, F.lit(0.0)),
                                       "log_ret": F.ln(F.col("close") / F.nullif(pc, F.lit(0.0)))}))


def eda_stats(bars: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    key = list(key)
    r = returns(bars, key, size)
    a = r.groupBy(*key).agg(
        F.count(F.lit(1)).alias("candles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg("close").alias("close_mean"), F.stddev_samp("close").alias("close_std"), F.min("close").alias("close_min"),
        F.max("close").alias("close_max"), F.sum("volume").alias("volume_total"), F.avg("volume").alias("volume_mean"),
        F.max("volume").alias("volume_max"), F.avg("ret").alias("_rm"), F.stddev_samp("ret").alias("_rs"),
        F.min_by("close", "rn").alias("_c0"), F.max_by("close", "rn").alias("_c1"))
    q = exact_percentiles(bars, key, "close", {"close_q25": 0.25, "close_median": 0.5, "close_q75": 0.75})
    days = F.floor((seconds(F.col("last_ts")) - seconds(F.col("first_ts"))) / 86400.0)
    return a.join(q, key).select(
        *key, "candles", "first_ts", "last_ts", days.cast("long").alias("days"),
        *[F.round(c, 4).alias(c) for c in ("close_mean", "close_median", "close_std", "close_min", "close_max",
                                           "close_q25", "close_q75")],
        *[F.round(c, 2).alias(c) for c in ("volume_total", "volume_mean", "volume_max")],
        F.round(F.col("_rm") * 100, 4).alias("ret_mean_pct"), F.round(F.col("_rs") * 100, 4).alias("ret_std_pct"),
        F.round((F.col("_c1") / F.nullif(F.col("_c0"), F.lit(0.0)) - 1) * 100, 2).alias("ret_total_pct"))


def normality_p(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson omnibus test from n, skewness and excess kurtosis (n >= 8)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    zs = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    b2 = kurt + 3
    x = (b2 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    q = 1 + x * F.sqrt(2 / (a - 4))
    zk = (1 - 2 / (9 * a) - F.signum(q) * F.pow((1 - 2 / a) / F.nullif(F.abs(q), F.lit(0.0)), 1 / 3)) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, F.exp(-(zs * zs + zk * zk) / 2))


def eda_distribution(bars: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    r = returns(bars, key, size).filter("ret is not null")
    a = r.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.skewness("ret").alias("_g"), F.kurtosis("ret").alias("_k"),
                            F.stddev_samp("log_ret").alias("_ls"), F.avg((F.col("ret") > 0).cast("double")).alias("_up"))
    p = normality_p(F.col("_n"), F.col("_g"), F.col("_k"))
    return a.withColumn("_p", p).select(
        *key, F.round("_g", 4).alias("skewness"), F.round("_k", 4).alias("kurtosis"),
        F.round("_p", 6).alias("normality_p_value"), (F.col("_p") > 0.05).alias("is_normal"),
        F.round("_ls", 6).alias("log_return_std"), F.round(F.col("_up") * 100, 2).alias("positive_pct"))


def histogram(df: DataFrame, key: Sequence[str], col: str, bins: int) -> DataFrame:
    """Equal-width counts over each key's own range, last bin closed, empty bins included."""
    key = list(key)
    rng = df.groupBy(*key).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    d = df.filter(F.col(col).isNotNull()).join(rng, key)
    b = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)))
    cnt = d.groupBy(*key, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(cnt, [*key, "bin"], "left").select(
        *key, "bin", (F.col("lo") + (F.col("bin") + 0.5) * step).alias("mid"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram_width(df: DataFrame, key: Sequence[str], col: str, width: float) -> DataFrame:
    """Fixed-width buckets from the lowest to the highest, empty ones filled with zero."""
    key = list(key)
    cnt = df.filter(F.col(col).isNotNull()).groupBy(*key, (F.floor(F.col(col) / width) * width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"))
    rng = cnt.groupBy(*key).agg((F.min("bucket") / width).cast("long").alias("_a"), (F.max("bucket") / width).cast("long").alias("_b"))
    grid = rng.select(*key, F.explode(F.transform(F.sequence("_a", "_b"), lambda i: i * width)).alias("bucket"))
    return grid.join(cnt, [*key, "bucket"], "left").na.fill(0, ["count"])


def histogram_edges(df: DataFrame, key: Sequence[str], col: str, edges: Sequence[float]) -> DataFrame:
    """Counts between fixed edges; the outer buckets are open."""
    b = F.lit(0)
    for i, e in enumerate(edges, 1):
        b = F.when(F.col(col) >= e, i).otherwise(b)
    return df.filter(F.col(col).isNotNull()).groupBy(*key, b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def eda_seasonality(bars: DataFrame, key: Sequence[str], part: str = "month", size: int = BLOCK) -> DataFrame:
    """Mean, spread and count of returns by month or weekday, best and worst marked."""
    r = returns(bars, key, size)
    p, fmt = (F.month("ts"), "MMM") if part == "month" else (F.weekday("ts"), "EEE")
    a = r.groupBy(*key, p.alias(part)).agg(F.date_format(F.min("ts"), fmt).alias("name"), F.round(F.avg("ret"), 6).alias("avg_return"),
                                           F.round(F.stddev_samp("ret"), 6).alias("volatility"), F.count("ret").alias("candles"))
    w = span(key)    # at most 12 rows per key
    return a.withColumns({"best": F.col(part) == F.max_by(part, "avg_return").over(w),
                          "worst": F.col(part) == F.min_by(part, "avg_return").over(w)})


def eda_trend(bars: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Averages, simple RSI, MACD and distance from the high at the last bar (``n`` = total rows)."""
    key = list(key)
    p = open_panel(bars, key, [use("macd")], extra=200, size=size)
    d = p.tmp(F.col("close") - p.lag(F.col("close")))
    up, dn = p.tmp(F.greatest(d, F.lit(0.0))), p.tmp(F.greatest(-d, F.lit(0.0)))
    up, dn = F.when(d.isNotNull(), up), F.when(d.isNotNull(), dn)
    for n in (20, 50, 200):
        p.put(f"ma_{n}", p.sma(F.col("close"), n))
    g, l = p.roll(F.avg, up, 14), p.roll(F.avg, dn, 14)
    p.put("rsi_14", 100 - 100 / (1 + g / F.nullif(l, F.lit(0.0))))
    last = p.close().filter(F.col("rn") == F.col("n"))
    ext = bars.groupBy(*key).agg(F.max("high").alias("ath"), F.min("low").alias("atl"))
    return last.join(ext, key).select(
        *key, F.round("close", 4).alias("last_close"), *[F.round(f"ma_{n}", 4).alias(f"ma_{n}") for n in (20, 50, 200)],
        F.round("rsi_14", 2).alias("rsi_14"), F.round("macd", 4).alias("macd"), F.round("macd_signal", 4).alias("macd_signal"),
        F.round("ath", 4).alias("ath"), F.round("atl", 4).alias("atl"),
        F.round((F.col("close") - F.col("ath")) / F.col("ath") * 100, 2).alias("pct_from_ath"))


def eda_corr(bars: DataFrame, key: Sequence[str]) -> DataFrame:
    """Correlation matrix of the five columns in long form, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(OHLCV) for b in OHLCV[i:]]
    a = bars.groupBy(*key).agg(*[F.round(F.corr(x, y), 4).alias(f"{x}_{y}") for x, y in pairs])
    items = ", ".join(f"'{x}', '{y}', `{x}_{y}`" for x, y in pairs)
    return a.selectExpr(*key, f"stack({len(pairs)}, {items}) as (a, b, corr)")


def eda_volatility(bars: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    key = list(key)
    d = open_blocks(bars, 31, size)
    w = block_window(key)
    pc = F.lag("close").over(w)
    d = d.withColumn("_r", (F.col("close") - pc) / F.nullif(pc, F.lit(0.0)))
    b = w.rowsBetween(-29, Window.currentRow)
    d = close_blocks(d.withColumn("_v", F.when(F.count("_r").over(b) == 30, F.stddev_samp("_r").over(b)) * F.sqrt(F.lit(252.0))))
    a = d.groupBy(*key).agg(F.stddev_samp("_r").alias("_d"), F.max("_v").alias("_max"), F.min("_v").alias("_min"),
                            F.max_by("_v", "rn").alias("_cur"))
    return a.select(*key, F.round(F.col("_d") * 100, 4).alias("daily_vol_pct"),
                    F.round(F.col("_d") * F.sqrt(F.lit(252.0)) * 100, 2).alias("annual_vol_pct"),
                    F.round(F.col("_max") * 100, 2).alias("max_roll30_pct"), F.round(F.col("_min") * 100, 2).alias("min_roll30_pct"),
                    F.round(F.col("_cur") * 100, 2).alias("cur_roll30_pct"))
