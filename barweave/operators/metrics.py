"""Performance metrics grouped by key.  ``equity`` has ``rn`` (0 = starting capital), ``ts``, ``equity``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from ..sources.bars import seconds
from .blocks import BLK, BLOCK, CORE, block_window, close_blocks, open_blocks, running, span

DAYS = 252.0
TINY = 1e-10


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def candles_per_day(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bars per day from the median of the first 49 spacings (a fixed 50 rows per key)."""
    first = df.filter((F.col("rn") >= 1) & (F.col("rn") <= 50))
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(span(key).orderBy("rn"))
    d = first.withColumn("_g", gap).groupBy(*key).agg(F.median("_g").alias("_m"))
    cpd = F.greatest(F.lit(1.0 / 31.0), 86400.0 / F.nullif(F.col("_m"), F.lit(0.0)))
    return d.select(*key, F.coalesce(cpd, F.lit(1.0)).alias("cpd"))


def with_returns(equity: DataFrame, key: Sequence[str], col: str = "equity", out: str = "ret",
                 size: int = BLOCK) -> DataFrame:
    """Simple return of each row against the row before it (one-row halo)."""
    d = open_blocks(equity.withColumn("_r1", F.col("rn") + 1), 1, size, "_r1")
    w = block_window(key, "_r1")
    prev = F.lag(col).over(w)
    return close_blocks(d.withColumn(out, (F.col(col) - prev) / F.nullif(prev, F.lit(0.0)))).drop("_r1")


def return_aggs() -> list[Column]:
    return [F.min_by("equity", "rn").alias("_first"), F.max_by("equity", "rn").alias("_last"), F.count(F.lit(1)).alias("_n")]


def return_columns() -> dict[str, Column]:
    """Total, annualised and final values from the aggregates and bars per day."""
    days = F.greatest(F.col("_n") / F.col("cpd"), F.lit(1.0))
    growth = F.col("_last") / F.nullif(F.col("_first"), F.lit(0.0))
    return {"total_return_usd": F.col("_last") - F.col("_first"), "_tr": growth - 1,
            "_ann": F.when(F.col("_first") > 0, F.pow(F.greatest(growth, F.lit(0.0)), F.lit(DAYS) / days) - 1).otherwise(0.0),
            "final_equity": F.col("_last"), "initial_capital": F.col("_first")}


def return_metrics(equity: DataFrame, cpd: DataFrame, key: Sequence[str]) -> DataFrame:
    return equity.groupBy(*key).agg(*return_aggs()).join(cpd, list(key)).select(*key, "cpd", *[c.alias(n) for n, c in return_columns().items()])


def risk_aggs(r: Column) -> list[Column]:
    down = F.when(r < 0, r)
    return [F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_std"), F.stddev_pop(down).alias("_dstd"),
            F.count(down).alias("_dn")]


def risk_ratios(cpd: Column) -> dict[str, Column]:
    mean, std = F.coalesce("_mean", F.lit(0.0)), F.coalesce("_std", F.lit(0.0))
    year = F.sqrt(F.lit(DAYS) * cpd)
    down = F.when(F.col("_dn") > 1, F.col("_dstd")).otherwise(F.lit(TINY))
    return {"sharpe_ratio": F.when(std > TINY, mean / F.nullif(std, F.lit(0.0)) * year).otherwise(0.0),
            "sortino_ratio": F.when(down > TINY, mean / F.nullif(down, F.lit(0.0)) * year).otherwise(0.0),
            "_vol": F.when(std > 0, std * year).otherwise(0.0)}


def risk_metrics(equity: DataFrame, cpd: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    a = with_returns(equity, key, size=size).groupBy(*key).agg(*risk_aggs(F.col("ret"))).join(cpd, list(key))
    return a.withColumns(risk_ratios(F.col("cpd"))).select(*key, "sharpe_ratio", "sortino_ratio", "_vol")


def drawdowns(equity: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Running peak, drawdown (<= 0), rows since the peak and return of every row.

    The running maximum of (equity, position) carries where the latest peak was, so the
    length of a stretch below it needs no second pass.  ``equity`` is read twice.
    """
    d = running(equity.withColumn("_r1", F.col("rn") + 1), key,
                {"_pk": ("max", F.struct("equity", "_r1")), "_pe": ("prev", "equity")}, size, "_r1")
    peak = F.col("_pk.equity")
    return d.withColumns({
        "peak": peak, "below": F.col("_r1") - F.col("_pk._r1"),
        "drawdown": F.coalesce((F.col("equity") - peak) / F.nullif(peak, F.lit(0.0)), F.lit(0.0)),
        "ret": (F.col("equity") - F.col("_pe")) / F.nullif(F.col("_pe"), F.lit(0.0))}).drop("_pk", "_pe", "_r1")


def dd_duration(dd: DataFrame, key: Sequence[str]) -> DataFrame:
    """Longest stretch below the peak, in rows."""
    return dd.groupBy(*key).agg(F.max("below").alias("max_dd_duration_candles"))


def calmar(ann: Column, max_dd: Column) -> Column:
    return F.when(F.abs(max_dd) > TINY, ann / F.nullif(F.abs(max_dd), F.lit(0.0))).otherwise(0.0)


def trade_stats(trades: DataFrame, key: Sequence[str]) -> DataFrame:
    """Win rate, profit factor (infinite without losses), durations -- one hash aggregation."""
    p = F.col("pnl")
    hours = (seconds(F.col("exit_time")) - seconds(F.col("entry_time"))) / 3600.0
    a = trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("num_trades"), F.count_if(p > 0).alias("_win"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_gp"),
        F.abs(F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))).alias("_gl"), F.avg(p).alias("_avg"),
        F.max(p).alias("_best"), F.min(p).alias("_worst"), F.avg(hours).alias("_h"),
        F.min("entry_time").alias("_t0"), F.max("exit_time").alias("_t1"))
    days = F.greatest(F.floor((seconds(F.col("_t1")) - seconds(F.col("_t0"))) / 86400.0), F.lit(1))
    return a.select(*key, "num_trades", F.round(F.col("_win") / F.col("num_trades") * 100, 2).alias("win_rate"),
                    F.round(F.when(F.col("_gl") > TINY, F.col("_gp") / F.nullif(F.col("_gl"), F.lit(0.0)))
                            .otherwise(F.lit(float("inf"))), 4).alias("profit_factor"),
                    F.round("_avg", 4).alias("avg_trade_pnl"), F.round("_best", 4).alias("best_trade"),
                    F.round("_worst", 4).alias("worst_trade"), F.round("_gp", 4).alias("gross_profit"),
                    F.round("_gl", 4).alias("gross_loss"), F.round("_h", 2).alias("avg_trade_duration"),
                    F.round(F.col("num_trades") / days, 4).alias("trades_per_day"))


TRADE_FIELDS = ["num_trades", "win_rate", "profit_factor", "avg_trade_pnl", "best_trade", "worst_trade",
                "gross_profit", "gross_loss", "avg_trade_duration", "trades_per_day"]


def performance(equity: DataFrame, trades: DataFrame | None, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """All scalar metrics, one row per key, from one pass with one running scan.

    ``equity`` should be staged: it is read twice.
    """
    key = list(key)
    a = drawdowns(equity, key, size).groupBy(*key).agg(
        *return_aggs(), *risk_aggs(F.col("ret")), F.min("drawdown").alias("_mdd"), F.max("below").alias("max_dd_duration_candles"))
    m = a.join(candles_per_day(equity, key), key).withColumns({**return_columns(), **risk_ratios(F.col("cpd"))})
    pct = lambda c: F.round(F.col(c) * 100, 4)
    m = m.select(*key, F.round("total_return_usd", 4).alias("total_return_usd"), pct("_tr").alias("total_return_pct"),
                 pct("_ann").alias("annualised_return_pct"), F.round("final_equity", 4).alias("final_equity"),
                 F.round("initial_capital", 4).alias("initial_capital"), F.round("sharpe_ratio", 4).alias("sharpe_ratio"),
                 F.round("sortino_ratio", 4).alias("sortino_ratio"), F.round(calmar(F.col("_ann"), F.col("_mdd")), 4).alias("calmar_ratio"),
                 pct("_vol").alias("volatility_pct"), pct("_mdd").alias("max_drawdown_pct"), "max_dd_duration_candles")
    if trades is None:
        return m
    return m.join(trade_stats(trades, key), key, "left").na.fill(0, TRADE_FIELDS)


# Weights and clamp ranges of the absolute composite score.
SCORE = {"sharpe_ratio": (0.35, -3.0, 3.0), "total_return_pct": (0.25, -50.0, 100.0),
         "sortino_ratio": (0.20, -3.0, 3.0), "calmar_ratio": (0.10, -3.0, 3.0), "max_drawdown_pct": (0.10, 0.0, 50.0)}


def _norm(name: str) -> Column:
    _, lo, hi = SCORE[name]
    v = F.abs(F.col(name)) if name == "max_drawdown_pct" else F.col(name)
    n = (F.least(F.greatest(v, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)
    n = 1 - n if name == "max_drawdown_pct" else n
    return F.when(F.col(name).isNull(), 0.5).otherwise(n)


def score(df: DataFrame) -> DataFrame:
    """Absolute score in [0, 1]; a missing metric counts half; drawdown by its size."""
    total = sum((F.lit(w) * _norm(n) for n, (w, _, _) in SCORE.items()), F.lit(0.0))
    return df.withColumn("score", F.round(total, 4))


def score_breakdown(df: DataFrame, key: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(w).alias("weight"), F.col(n).cast("double").alias("value"),
                              F.round(_norm(n), 4).alias("normalized"),
                              F.round(F.lit(w) * _norm(n), 4).alias("contribution")) for n, (w, _, _) in SCORE.items()])
    return df.select(*key, F.explode(rows).alias("_r")).select(*key, "_r.*")


def rolling_risk(equity: DataFrame, key: Sequence[str], n: int = 30, size: int = BLOCK) -> DataFrame:
    """Sharpe over the last <= n returns and the running drawdown."""
    d = drawdowns(equity, key, size).withColumn("_r1", F.col("rn") + 1)
    o = open_blocks(d, n, size, "_r1")
    w = block_window(key, "_r1").rowsBetween(-(n - 1), Window.currentRow)
    sd = F.stddev_pop("ret").over(w)
    o = o.withColumn("rolling_sharpe", F.when(sd > TINY, F.avg("ret").over(w) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(DAYS)))
                     .when(F.count("ret").over(w) > 0, 0.0))
    return close_blocks(o).drop("ret", "_r1", "peak", "below")


def monthly_pnl(trades: DataFrame, key: Sequence[str]) -> DataFrame:
    """Year x month table of realised profit, empty months are zero."""
    d = trades.select(*key, F.year("exit_time").alias("year"), F.month("exit_time").alias("_m"), "pnl")
    p = d.groupBy(*key, "year").pivot("_m", list(range(1, 13))).agg(F.sum("pnl"))
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    return p.select(*key, "year", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names, 1)])


def monthly_equity_change(equity: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last equity of a month minus that of the month before (months per key are few)."""
    m = (equity.groupBy(*key, F.year("ts").alias("year"), F.month("ts").alias("month"))
         .agg(F.max_by("equity", "rn").alias("month_end"), F.min_by("equity", "rn").alias("_first")))
    prev = F.lag("month_end").over(span(key).orderBy("year", "month"))
    return m.withColumn("change", F.col("month_end") - F.coalesce(prev, F.col("_first"))).drop("_first")


def downsample(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Every k-th row so that at most about ``n`` stay, and always the last one."""
    size = df.groupBy(*key).agg(F.max("rn").alias("_n"))
    d = df.join(size, list(key))
    step = F.greatest(F.ceil((F.col("_n") + 1) / F.lit(n)), F.lit(1))
    return d.filter((F.col("rn") % step == 0) | (F.col("rn") == F.col("_n"))).drop("_n")


# Direction of improvement per metric (1 = higher is better).
DIRECTION = {"total_return_pct": 1, "annualised_return_pct": 1, "sharpe_ratio": 1, "sortino_ratio": 1,
             "calmar_ratio": 1, "win_rate": 1, "profit_factor": 1, "avg_trade_pnl": 1, "volatility_pct": -1,
             "max_drawdown_pct": 1, "max_dd_duration_candles": -1}


def metric_rows(df: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return df.selectExpr(*key, f"stack({len(metrics)}, {pairs}) as (metric, value)")


def metric_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Original against improved: delta, change in percent, and whether it got better."""
    names = list(DIRECTION)
    x = metric_rows(a, key, names).withColumnRenamed("value", "original")
    y = metric_rows(b, key, names).withColumnRenamed("value", "improved")
    d = x.join(y, [*key, "metric"])
    delta = F.col("improved") - F.col("original")
    sign = F.when(F.col("metric").isin([m for m, s in DIRECTION.items() if s < 0]), -1).otherwise(1)
    return d.withColumns({"delta": F.round(delta, 4), "pct_change": F.round(delta / F.nullif(F.abs("original"), F.lit(0.0)) * 100, 2),
                          "better": delta * sign > 0})


def buy_hold_verdict(bars: DataFrame, metrics: DataFrame, key: Sequence[str]) -> DataFrame:
    """Buy-and-hold return of the same bars, whether it was beaten, and a plain tier."""
    h = bars.groupBy(*key).agg(((F.max_by("close", "rn") / F.nullif(F.min_by("close", "rn"), F.lit(0.0)) - 1) * 100).alias("_h"))
    d = metrics.join(h, list(key))
    gained = F.col("total_return_pct") > 0
    tier = (F.when(F.col("num_trades") == 0, "no trades").when(gained & (F.col("sharpe_ratio") >= 1), "promising")
            .when(gained & (F.col("sharpe_ratio") > 0), "modest").otherwise("underperforms"))
    return d.select(*key, "total_return_pct", F.round("_h", 4).alias("buy_hold_pct"),
                    (F.col("total_return_pct") > F.col("_h")).alias("beats_hold"), tier.alias("tier"),
                    (F.abs("max_drawdown_pct") > 20).alias("severe_drawdown"))


def metric_table(df: DataFrame, key: Sequence[str], across: str, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics as rows, the given ``across`` values (strategies, in/out of sample) as columns."""
    m = metric_rows(df, [*key, across], metrics)
    return m.groupBy(*key, "metric").pivot(across, list(names)).agg(F.first("value"))
