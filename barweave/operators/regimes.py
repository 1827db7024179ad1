"""Market regimes: labels whose window length depends on the key, and reports by regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import BLOCK, block_window, close_blocks, exact_percentiles, open_blocks, running, span
from .metrics import candles_per_day, risk_aggs, risk_ratios, with_returns

REGIMES = ("bull", "bear", "sideways")


def regime_windows(bars: DataFrame, key: Sequence[str]) -> DataFrame:
    """Long and short average lengths per key, in bars, from the amount of data it has."""
    n = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    d = n.join(candles_per_day(bars, key), list(key))
    long_days = F.least(F.greatest(F.col("_n") / F.col("cpd") / 5, F.lit(10.0)), F.lit(60.0))
    d = d.withColumn("_ld", long_days)
    return d.select(*key, "cpd", F.greatest(F.lit(2), F.rint(F.col("_ld") * F.col("cpd"))).cast("long").alias("long_w"),
                    F.greatest(F.lit(2), F.rint(F.greatest(F.lit(2.0), F.col("_ld") / 3) * F.col("cpd"))).cast("long").alias("short_w"))


def shifted(df: DataFrame, key: Sequence[str], cols: dict[str, str], by: str) -> DataFrame:
    """Values of the row ``by`` positions earlier, where ``by`` is a column: an equi-join."""
    src = df.select(*key, (F.col("rn") + F.col(by)).alias("rn"), *[F.col(c).alias(o) for o, c in cols.items()])
    return df.join(src, [*key, "rn"], "left")


def dynamic_mean(df: DataFrame, key: Sequence[str], total: str, width: str, out: str) -> DataFrame:
    """Rolling mean whose frame length is a column: difference of running totals."""
    d = shifted(df, key, {"_was": total}, width)
    return d.withColumn(out, F.when(F.col("rn") >= F.col(width),
                                    (F.col(total) - F.coalesce("_was", F.lit(0.0))) / F.col(width))).drop("_was")


def classify_regimes(bars: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Label every bar bull, bear or sideways.

    The flatness threshold uses the median volatility of the whole series, so labels describe
    the past and are no trading signal.  ``bars`` should be staged: it is read several times.
    """
    key = list(key)
    r = with_returns(bars.select(*key, "rn", "ts", "close"), key, "close", "ret", size)
    # sums of returns relative to the first price keep the running squares well conditioned
    d = running(stage(r), key, {"_cs": ("sum", "close"), "_rs": ("sum", "ret"), "_rq": ("sum", F.col("ret") * F.col("ret"))}, size)
    d = stage(d.join(regime_windows(bars, key), key))
    d = dynamic_mean(d, key, "_cs", "long_w", "long_ma")
    d = shifted(d, key, {"_c0": "_cs", "_r0": "_rs", "_q0": "_rq"}, "short_w")
    w = F.col("short_w")
    d = d.withColumn("short_ma", F.when(F.col("rn") >= w, (F.col("_cs") - F.coalesce("_c0", F.lit(0.0))) / w))
    m = F.least(F.col("rn") - 1, w)     # returns in the frame (the first bar has none)
    s1 = F.col("_rs") - F.coalesce("_r0", F.lit(0.0))
    s2 = F.col("_rq") - F.coalesce("_q0", F.lit(0.0))
    var = (s2 - s1 * s1 / F.nullif(m, F.lit(0))) / F.nullif(m - 1, F.lit(0))
    d = stage(d.withColumn("_rv", F.when(m >= 2, F.sqrt(F.greatest(var, F.lit(0.0)))))
              .select(*key, "rn", "ts", "close", "short_w", "long_ma", "short_ma", "_rv"))
    med = exact_percentiles(d, key, "_rv", {"_med": 0.5})
    d = shifted(d, key, {"_prev_ma": "short_ma"}, "short_w").join(med, key, "left")
    slope = F.col("short_ma") / F.nullif(F.col("_prev_ma"), F.lit(0.0)) - 1
    eps = F.greatest(0.3 * F.coalesce("_med", F.lit(1e-4)), F.lit(1e-5))
    c, lm, sm = F.col("close"), F.col("long_ma"), F.col("short_ma")
    label = F.when((c > lm) & (sm > lm) & (slope > eps), "bull").when((c < lm) & (sm < lm) & (slope < -eps), "bear").otherwise("sideways")
    return d.select(*key, "rn", "ts", "close", label.alias("regime"))


def regime_mix(labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bars, share and dominance of each regime per key."""
    c = labels.groupBy(*key, "regime").agg(F.count(F.lit(1)).alias("bars"))
    w = span(key)       # at most three rows
    return c.withColumns({"share_pct": F.round(100.0 * F.col("bars") / F.sum("bars").over(w), 2),
                          "dominant": F.col("regime") == F.max_by("regime", F.struct("bars", "regime")).over(w)})


def regime_returns(equity: DataFrame, labels: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Return from each bar to the next, credited to the regime of the starting bar."""
    key = list(key)
    r = with_returns(equity.filter("rn >= 1"), key, "equity", "fwd_ret", size)
    fwd = r.select(*key, (F.col("rn") - 1).alias("rn"), "fwd_ret").filter("rn >= 1")
    return labels.join(fwd, [*key, "rn"], "left")


def regime_metrics(equity: DataFrame, labels: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    key = list(key)
    d = regime_returns(equity, labels, key, size)
    a = d.groupBy(*key, "regime").agg(F.count(F.lit(1)).alias("num_candles"), *risk_aggs(F.col("fwd_ret")),
                                      F.coalesce(F.exp(F.sum(F.log1p("fwd_ret"))), F.lit(1.0)).alias("_g"))
    n = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    a = a.join(n, key).join(candles_per_day(labels, key), key).withColumns(risk_ratios(F.col("cpd")))
    ok = F.col("num_candles") >= 2
    z = lambda c: F.round(F.when(ok, c).otherwise(0.0), 4)
    return a.select(*key, "regime", z((F.col("_g") - 1) * 100).alias("total_return_pct"), z(F.col("sharpe_ratio")).alias("sharpe_ratio"),
                    z(F.col("sortino_ratio")).alias("sortino_ratio"), z(F.col("_vol") * 100).alias("volatility_pct"), "num_candles",
                    F.round(100.0 * F.col("num_candles") / F.col("_n"), 2).alias("pct_of_period"))


def regime_drawdown(equity: DataFrame, labels: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Deepest drawdown of the curve stitched from the returns of one regime (starting at 1)."""
    k2 = [*key, "regime"]
    d = regime_returns(equity, labels, key, size).filter("fwd_ret is not null")
    d = running(stage(d), k2, {"_lg": ("sum", F.log1p("fwd_ret"))}, size)
    d = running(stage(d), k2, {"_pk": ("max", "_lg")}, size)
    dd = F.exp(F.col("_lg") - F.greatest(F.col("_pk"), F.lit(0.0))) - 1
    return d.groupBy(*k2).agg(F.round(F.least(F.min(dd), F.lit(0.0)) * 100, 4).alias("max_drawdown_pct"))


def attribute_trades(trades: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Regime of the entry bar; where no bar has that time, the first bar of the same date."""
    key = list(key)
    exact = labels.select(*key, F.col("ts").alias("entry_time"), F.col("regime").alias("_r1"))
    day = labels.groupBy(*key, F.to_date("ts").alias("_d")).agg(F.min_by("regime", "ts").alias("_r2"))
    t = trades.withColumn("_d", F.to_date("entry_time"))
    return (t.join(exact, [*key, "entry_time"], "left").join(day, [*key, "_d"], "left")
             .withColumn("regime", F.coalesce("_r1", "_r2")).drop("_d", "_r1", "_r2"))


def regime_periods(labels: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Contiguous stretches of one regime."""
    d = open_blocks(labels, 1, size)
    prev = F.lag("regime").over(block_window(key))
    d = close_blocks(d.withColumn("_new", F.when(prev.isNull() | (prev != F.col("regime")), 1).otherwise(0)))
    d = running(stage(d), key, {"period": ("sum", "_new")}, size)
    return d.groupBy(*key, "period").agg(F.min_by("regime", "rn").alias("regime"), F.min("ts").alias("start_ts"),
                                         F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("bars"))


def regime_vol_scales(labels: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Volatility of log returns in each regime relative to all, and the share of bars.

    ``labels`` carries ``close``; a return belongs to the regime of its starting bar.
    """
    key = list(key)
    d = open_blocks(labels, 1, size)
    w = block_window(key)
    d = close_blocks(d.withColumns({"_lr": F.ln(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0))),
                                    "_from": F.lag("regime").over(w)}))
    allv = d.groupBy(*key).agg(F.stddev_pop("_lr").alias("_all"), F.count(F.lit(1)).alias("_n"))
    part = d.filter("_from is not null").groupBy(*key, F.col("_from").alias("regime")).agg(F.stddev_pop("_lr").alias("_s"), F.count("_lr").alias("_c"))
    share = d.groupBy(*key, "regime").agg(F.count(F.lit(1)).alias("_b"))
    vol = F.when(F.col("_all") < 1e-8, 1e-4).otherwise(F.col("_all"))
    return (share.join(allv, key).join(part, [*key, "regime"], "left")
            .select(*key, "regime", F.round(F.when(F.coalesce("_c", F.lit(0)) < 2, 1.0).otherwise(F.col("_s") / vol), 4).alias("vol_scale"),
                    (F.col("_b") / F.col("_n")).alias("fraction")))


def regime_distribution(paths: DataFrame, key: Sequence[str], floor_pct: float = 0.0) -> DataFrame:
    """Share of paths by dominant regime, and share of paths that end above ``floor_pct`` (by default: with a profit)."""
    p = paths.groupBy(*key).pivot("regime", list(REGIMES)).agg(F.count(F.lit(1)))
    s = paths.groupBy(*key).agg(F.count(F.lit(1)).alias("paths"), F.round(100.0 * F.avg((F.col("return_pct") > floor_pct).cast("double")), 2).alias("survival_pct"))
    return s.join(p, list(key)).select(*key, "paths", *[F.round(100.0 * F.coalesce(F.col(r), F.lit(0)) / F.col("paths"), 2).alias(f"{r}_pct") for r in REGIMES], "survival_pct")
