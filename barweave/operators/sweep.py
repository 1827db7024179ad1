"""Parameter grids, sweeps, ranking and comparison of runs."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import BLOCK, span
from .indicators import open_panel, use
from .metrics import performance
from .positions import equity_curve, round_trips
from .signals import cross_above, cross_below, flags_from, signals_from_masks

BATCH = 100          # parameter sets per plan

# Sweep ranges of the three classic strategies.
GRID_RANGES = {"num_levels": [3, 5, 7, 10], "spacing": ["linear", "exponential"], "invest": [200.0, 500.0, 1000.0]}
DCA_RANGES = {"buy_interval_hours": [24, 48, 72], "invest": [100.0, 300.0, 500.0], "hold_days": [14, 30, 60]}
DCA_EXITS = [("time", 10.0), ("profit", 10.0), ("profit", 5.0), ("profit", 15.0)]
PLA_RANGES = {"ema": [(9, 21), (12, 26), (20, 50)],
              "levels": [(0.0, -1.0, -2.5, -4.0), (0.0, -2.0, -4.0, -6.0), (0.0, -0.5, -1.5, -3.0)],
              "invest": [(200.0, 200.0, 400.0, 600.0), (300.0, 300.0, 600.0, 900.0), (500.0, 500.0, 1000.0, 1500.0)],
              "exit": [("crossover", 5.0), ("take_profit", 5.0), ("take_profit", 10.0)]}


def param_grid(spark: SparkSession, **ranges: Sequence) -> DataFrame:
    """Cartesian product of parameter ranges."""
    names = list(ranges)
    combos = list(itertools.product(*ranges.values()))
    return spark.createDataFrame([(i, *c) for i, c in enumerate(combos, 1)], ["param_id", *names])


def preset_grids(spark: SparkSession) -> DataFrame:
    """The grids of the classic strategies as one table of JSON parameters."""
    rows = [("GRID", dict(zip(GRID_RANGES, c))) for c in itertools.product(*GRID_RANGES.values())]
    rows += [("DCA", {**dict(zip(DCA_RANGES, c)), "exit_type": e, "profit_target_pct": t})
             for c in itertools.product(*DCA_RANGES.values()) for e, t in DCA_EXITS]
    rows += [("PLA", {"fast": e[0], "slow": e[1], "levels": list(lv), "invest": list(iv), "exit_type": x, "take_profit_pct": tp})
             for e, lv, iv, (x, tp) in itertools.product(*PLA_RANGES.values())]
    import json
    return spark.createDataFrame([(i, s, json.dumps(p, sort_keys=True)) for i, (s, p) in enumerate(rows, 1)],
                                 "param_no int, strategy string, params string").withColumn("param_id", F.sha2(F.concat("strategy", "params"), 256))


def ma_cross_flags(bars: DataFrame, key: Sequence[str], grid: DataFrame, kind: str = "sma", size: int = BLOCK) -> DataFrame:
    """Crossing flags for every (key, parameter set).

    Averages are computed once per distinct length and shared by the parameter sets of a batch;
    a batch becomes one literal array, so each bar fans out to narrow flag rows without a join.
    """
    sets = sorted(grid.select("param_id", "fast", "slow").collect(), key=lambda r: (r["fast"], r["slow"], r["param_id"]))
    out = None
    for lo in range(0, len(sets), BATCH):
        part = _batch_flags(bars, key, sets[lo:lo + BATCH], kind, size)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _batch_flags(bars, key, [(0, 1, 1)], kind, size).filter(F.lit(False))


def _batch_flags(bars: DataFrame, key: Sequence[str], sets: Sequence, kind: str, size: int) -> DataFrame:
    lengths = sorted({int(v) for _, f, s in sets for v in (f, s)})
    p = open_panel(bars, key, [use(kind, f"_{n}", length=n) for n in lengths], extra=1, size=size)
    both = []
    for n in lengths:
        cur = F.col(f"{kind}_{n}")
        both.append((n, cur, p.put(f"_was_{n}", p.lag(cur))))
    ma = {n: (cur, was) for n, cur, was in both}
    rows = []
    for pid, fast, slow in sets:
        (f, fw), (s, sw) = ma[int(fast)], ma[int(slow)]
        was, now = fw - sw, f - s
        rows.append(F.struct(F.lit(pid).alias("param_id"), F.coalesce((was <= 0) & (now > 0), F.lit(False)).alias("entry"),
                             F.coalesce((was >= 0) & (now < 0), F.lit(False)).alias("exit")))
    return p.close().select(*key, "rn", "ts", "close", F.explode(F.array(*rows)).alias("_r")).select(*key, "_r.param_id", "rn", "ts", "close", "_r.entry", "_r.exit")


def sweep(bars: DataFrame, grid: DataFrame, key: Sequence[str], kind: str = "sma", capital: float = 100_000.0,
          invest: float = 1000.0, size: int = BLOCK) -> DataFrame:
    """One metrics row per (key, parameter set); groups without a trade are kept with zeros."""
    k = [*key, "param_id"]
    sig = stage(signals_from_masks(ma_cross_flags(bars, key, grid, kind, size), k, invest, size=size))
    m = performance(stage(equity_curve(sig, k, capital, size=size)), round_trips(sig, k, size=size), k, size)
    return m.withColumn("error", F.when(F.col("num_trades") == 0, "no trades"))


def cap(v: Column, lo: float = -20.0, hi: float = 20.0) -> Column:
    bad = v.isNull() | F.isnan(v)
    return F.when(bad, lo).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


# Weights of the batch score.
BATCH_WEIGHTS = {"sharpe_ratio": 0.35, "total_return_pct": 0.25, "sortino_ratio": 0.20, "calmar_ratio": 0.10, "max_drawdown_pct": 0.10}


def composite_score(runs: DataFrame, valid: Column | None = None) -> DataFrame:
    """Min-max score over all valid runs; others score 0.

    The ranges are one aggregated row carried as literals, so nothing gathers or joins all runs.
    """
    ok = (F.col("num_trades") > 0) if valid is None else valid
    val = {m: F.abs(F.col(m)) if m == "max_drawdown_pct" else F.col(m) for m in BATCH_WEIGHTS}
    rng = runs.filter(ok).agg(*[F.min(c).alias(f"_lo_{m}") for m, c in val.items()], *[F.max(c).alias(f"_hi_{m}") for m, c in val.items()])
    row = rng.first()
    total = F.lit(0.0)
    for m, c in val.items():
        lo, hi = (F.lit(row[f"_{e}_{m}"]).cast("double") for e in ("lo", "hi"))
        x = (c - lo) / F.when(hi - lo > 1e-10, hi - lo).otherwise(1.0)
        total = total + BATCH_WEIGHTS[m] * (1 - x if m == "max_drawdown_pct" else x)
    return runs.withColumn("composite_score", F.when(ok, F.round(total, 4)).otherwise(0.0))


def leaderboard(runs: DataFrame, k: int, by: str = "composite_score", ties: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` with rank.  The limit comes first, so the ranking window sees ``k`` rows."""
    top = runs.orderBy(F.desc(by), *ties).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), *ties)))


def best_per(runs: DataFrame, group: Sequence[str], by: str = "composite_score", ties: Sequence[str] = ()) -> DataFrame:
    """Best run of each group as a max-by aggregation; ties go to the smallest tie columns."""
    rest = [c for c in runs.columns if c not in group]
    order = F.struct((-F.col(by)).alias("_s"), *ties)
    return runs.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*group, "_b.*")


def compare_runs(runs: DataFrame, jobs: DataFrame, ids: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Selected runs with their jobs; the best value of each metric is flagged."""
    d = runs.join(ids, "run_id", "left_semi").join(jobs, "run_id", "left")
    best = d.agg(*[F.max(m).alias(m) for m in metrics]).first()
    return d.withColumns({f"best_{m}": F.col(m) == F.lit(best[m]) for m in metrics})


def column_ranges(runs: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = runs.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in cols], *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols])
    items = ", ".join(f"'{c}', coalesce(`lo_{c}`, 0D), coalesce(`hi_{c}`, 1D)" for c in cols)
    return a.selectExpr(f"stack({len(cols)}, {items}) as (metric, lo, hi)")


def outcome_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("strategy", "category").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("total_return_pct"), 4).alias("avg_return"),
                                                  F.round(F.avg("sharpe_ratio"), 4).alias("avg_sharpe"), F.round(F.avg("win_rate"), 4).alias("avg_win_rate"))


def cached_outcomes(new: DataFrame, log: DataFrame, key: str = "cache_key", newest: str = "created_at") -> DataFrame:
    """Newest earlier outcome with the same key; the log is reduced to one row per key first."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias("hit"))
    return new.join(last, key, "left")


def plateau(rounds: DataFrame, key: Sequence[str], eps: float = 0.02, limit: int | None = None) -> DataFrame:
    """Best round (first on ties) among those that would have run, and where progress stopped.

    All rounds up to the plateau count; rounds after a ``limit`` only if one is given.
    """
    key = list(key)
    w = span(key).orderBy("round")
    d = (rounds if limit is None else rounds.filter(F.col("round") <= limit)).withColumn("_gain", F.col("score") - F.lag("score").over(w))
    stop = d.groupBy(*key).agg(F.min(F.when((F.col("round") >= 2) & (F.col("_gain") < eps), F.col("round"))).alias("plateau_round"))
    d = d.join(stop, key).filter(F.col("plateau_round").isNull() | (F.col("round") <= F.col("plateau_round")))
    return d.groupBy(*key).agg(F.min_by("round", F.struct((-F.col("score")).alias("s"), "round")).alias("best_round"),
                               F.max("score").alias("best_score"), F.max("plateau_round").alias("plateau_round"), F.max("round").alias("rounds_run"))


def fetch_runs(jobs: DataFrame, results: DataFrame, trades: DataFrame, on: str) -> DataFrame:
    """Jobs with their result and number of trades; jobs without either are kept."""
    t = trades.groupBy(on).agg(F.count(F.lit(1)).alias("n_trades"))
    return jobs.join(results, on, "left").join(t, on, "left").na.fill(0, ["n_trades"])
