"""Trade resampling, run summaries, tail risk and robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..session import stage
from ..sources.bars import seconds
from .blocks import BLOCK, exact_percentiles, index_rows, running, span


def resample_trades(trades: DataFrame, key: Sequence[str], runs: int, capital: float = 10_000.0, skip: float = 0.1,
                    seed: int = 7, size: int = BLOCK, bucket_rows: int = 2048) -> DataFrame:
    """Drop a share of the trades, shuffle the rest, rebuild equity floored at zero; one row per run.

    The shuffle is the order of a per-trade draw.  Positions in that order are counted by
    buckets of the draw, so no run is sorted as one group; the floored curve is a running sum
    minus its running minimum.  Keys with fewer than three trades give no runs.
    """
    key = list(key)
    n = trades.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("entry_time").alias("_t0"), F.max("exit_time").alias("_t1"))
    n = n.filter("n >= 3").withColumn("keep", F.greatest(F.lit(1), F.rint(F.col("n") * (1 - skip))).cast("long"))
    days = F.greatest((seconds(F.col("_t1")) - seconds(F.col("_t0"))) / 86400.0, F.lit(1.0))
    n = n.withColumn("per_year", F.greatest(F.lit(1.0), F.col("n") / days * 365.0))
    k2 = [*key, "run_id"]
    d = (trades.select(*key, "trade_no", "pnl").join(n, key)
         .withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(runs)))))
    d = d.withColumn("u", uniform(f"{seed}drop", *key, "run_id", "trade_no"))
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows))
    d = index_rows(stage(d), k2, ["u", "trade_no"], [F.floor(F.col("u") * cuts)], out="pick").filter("pick <= keep")
    d = d.withColumn("v", uniform(f"{seed}mix", *key, "run_id", "trade_no"))
    d = stage(index_rows(stage(d), k2, ["v", "trade_no"], [F.floor(F.col("v") * cuts)]))
    d = running(d, k2, {"_s": ("sum", "pnl")}, size)
    d = d.withColumn("_s", F.round(F.lit(capital) + F.col("_s"), 8))
    d = running(stage(d), k2, {"_m": ("min", "_s")}, size)
    d = d.withColumn("equity", F.col("_s") - F.least(F.lit(0.0), F.col("_m")))
    d = running(stage(d), k2, {"_pk": ("max", "equity")}, size)
    peak = F.greatest(F.col("_pk"), F.lit(float(capital)))
    d = d.withColumn("_dd", (F.col("equity") - peak) / F.when(peak > 0, peak).otherwise(1.0))
    r = F.col("pnl") / capital
    a = d.groupBy(*k2).agg(F.max_by("equity", "rn").alias("_f"), F.min("_dd").alias("_mdd"), F.avg((F.col("pnl") > 0).cast("double")).alias("_w"),
                           F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_std"), F.max("per_year").alias("_py"), F.count(F.lit(1)).alias("num_trades"))
    sharpe = F.when(F.col("_std") > 1e-10, F.col("_mean") / F.nullif(F.col("_std"), F.lit(0.0)) * F.sqrt("_py")).otherwise(0.0)
    return a.select(*k2, F.round((F.col("_f") - capital) / capital * 100, 4).alias("return_pct"),
                    F.round(F.least(F.col("_mdd"), F.lit(0.0)) * 100, 4).alias("max_dd_pct"), F.round(F.col("_w") * 100, 4).alias("win_rate"),
                    F.round(sharpe, 4).alias("sharpe"), F.round("_f", 2).alias("final_equity"), "num_trades")


def resample_report(keys: DataFrame, trades: DataFrame, runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key of ``keys``: its trades, its resampled runs and, where there are none, why."""
    key = list(key)
    n = trades.groupBy(*key).agg(F.count(F.lit(1)).alias("trades"))
    m = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"))
    d = keys.select(*key).distinct().join(n, key, "left").join(m, key, "left").na.fill(0, ["trades", "runs"])
    return d.withColumn("note", F.when(F.col("trades") == 0, "no trades").when(F.col("trades") < 3, "fewer than 3 trades"))


TAILS = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def run_percentiles(runs: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """p5, p50, p95, worst and best per metric (long form)."""
    items = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    d = runs.selectExpr(*key, f"stack({len(metrics)}, {items}) as (metric, v)")
    a = d.groupBy(*key, "metric").agg(F.count("v").alias("runs"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    a = a.join(exact_percentiles(d, [*key, "metric"], "v", TAILS), [*key, "metric"])
    return a.select(*key, "metric", "runs", *[F.round(n, 4).alias(n) for n in TAILS],
                    F.round("_lo", 4).alias("worst"), F.round("_hi", 4).alias("best"))


def cvar_ruin(runs: DataFrame, key: Sequence[str], capital: float = 10_000.0) -> DataFrame:
    """Mean of the returns at or below the 5 % quantile, and the share of runs losing half."""
    q = exact_percentiles(runs, key, "return_pct", {"_q": 0.05})
    d = runs.join(q, list(key))
    return d.groupBy(*key).agg(F.round(F.avg(F.when(F.col("return_pct") <= F.col("_q"), F.col("return_pct"))), 4).alias("cvar_5"),
                               F.round(F.avg((F.col("final_equity") < capital * 0.5).cast("double")), 4).alias("prob_ruin"))


def representative_run(runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Run whose return is closest to the median, the first one on ties."""
    q = exact_percentiles(runs, key, "return_pct", {"p50": 0.5})
    d = runs.join(q, list(key))
    return d.groupBy(*key).agg(F.min_by("run_id", F.struct(F.round(F.abs(F.col("return_pct") - F.col("p50")), 9).alias("d"), F.col("run_id").alias("r"))).alias("run_id"),
                               F.first("p50").alias("p50"))


def equity_fan(equity: DataFrame, key: Sequence[str], path: str = "run_id", common: bool = False) -> DataFrame:
    """p5/p50/p95 over the runs of each bar and how many runs reach it; with ``common`` only bars that all runs reach."""
    key = list(key)
    if common:
        short = equity.groupBy(*key, path).agg(F.max("rn").alias("_l")).groupBy(*key).agg(F.min("_l").alias("_l"))
        equity = stage(equity.join(short, key).filter(F.col("rn") <= F.col("_l")).drop("_l"))
    bar = [*key, "rn"]
    runs = equity.groupBy(*bar).agg(F.count("equity").alias("runs"))
    a = runs.join(exact_percentiles(equity, bar, "equity", TAILS, splits=8, fine=8), bar)
    return a.select(*bar, "runs", *[F.round(n, 4).alias(n) for n in TAILS])


def even_indices(n: Column, k: int) -> Column:
    """``k`` evenly spaced indices from 0 to n-1, rounded half to even."""
    m = F.least(n, F.lit(k))
    return F.array_distinct(F.when(m <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.rint(i * (n - 1) / (m - 1)).cast("long"))))


def sample_paths(paths: DataFrame, key: Sequence[str], max_paths: int, max_points: int, path: str = "path_id",
                 step: str = "step", value: str = "close") -> DataFrame:
    """Evenly spaced paths and points, as change in percent from the first point of the path.

    Indices are made on one row per key and turn into a semi-join, so the paths themselves
    are only filtered.
    """
    key = list(key)
    shape = paths.groupBy(*key).agg(F.max(path).alias("_np"), F.max(step).alias("_ns"))
    ids = shape.select(*key, F.explode(even_indices(F.col("_np").cast("long"), max_paths)).alias("_i")).select(*key, (F.col("_i") + 1).cast("int").alias(path))
    pts = shape.select(*key, F.explode(even_indices(F.col("_ns").cast("long"), max_points)).alias("_i")).select(*key, (F.col("_i") + 1).cast("int").alias(step))
    first = paths.filter(F.col(step) == 1).select(*key, path, F.col(value).alias("_v0"))
    d = paths.join(ids, [*key, path], "left_semi").join(pts, [*key, step], "left_semi")
    return d.join(first, [*key, path]).select(*key, path, step, F.round((F.col(value) / F.col("_v0") - 1) * 100, 3).alias("pct"))


def path_delta(equity: DataFrame, baseline: DataFrame, key: Sequence[str]) -> DataFrame:
    b = baseline.select(*key, "rn", F.col("equity").alias("_b"))
    return equity.join(b, [*key, "rn"]).withColumn("delta_pct", F.round((F.col("equity") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0)) * 100, 4)).drop("_b")


# Weights of the robustness axes and grade limits.
AXES = {"survival": 0.30, "stability": 0.25, "tail_safety": 0.20, "overfit_resistance": 0.25}
GRADES = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))
TEXTS = {"A+": "Excellent", "A": "Good", "B": "Acceptable", "C": "Marginal", "D": "Weak", "F": "Very weak"}


def clip(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def robustness(runs: DataFrame, key: Sequence[str], capital: float = 10_000.0, wfe: DataFrame | None = None) -> DataFrame:
    """Score 0-100 from survival, stability, tail safety and walk-forward efficiency.

    Without an efficiency the other weights are scaled up and the score is provisional; a key
    with fewer than two runs has no score.
    """
    key = list(key)
    a = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("return_pct") > -20).cast("double")).alias("_alive"))
    a = a.join(exact_percentiles(runs, key, "return_pct", TAILS), key).join(cvar_ruin(runs, key, capital), key)
    a = a.join(wfe.select(*key, "wfe"), key, "left") if wfe is not None else a.withColumn("wfe", F.lit(None).cast("double"))
    p5, p50, p95 = (F.col(n) for n in TAILS)
    a = a.withColumns({
        "survival": 60 * F.col("_alive") + 0.4 * clip((p50 + 100) / 150 * 100),
        "stability": 0.5 * F.when(p5 > 0, 100.0).otherwise(F.greatest(F.lit(0.0), (p5 + 50) / 50 * 50)) + 0.5 * F.greatest(F.lit(0.0), 100 - F.abs(p95 - p5)),
        "tail_safety": 0.5 * clip(F.col("cvar_5") + 100) + 0.5 * F.greatest(F.lit(0.0), (1 - F.col("prob_ruin")) * 100),
        "overfit_resistance": clip(F.col("wfe") * 100)})
    base = sum((F.col(n) * AXES[n] for n in ("survival", "stability", "tail_safety")), F.lit(0.0))
    full = F.when(F.col("wfe").isNull(), base / 0.75).otherwise(base + F.col("overfit_resistance") * AXES["overfit_resistance"])
    a = a.withColumn("score", F.when(F.col("runs") >= 2, F.round(clip(full), 1)))
    grade = F.when(F.col("score").isNull(), F.lit(None))
    text = grade
    for limit, g in GRADES:
        grade = grade.when(F.col("score") >= limit, g)
    a = a.withColumn("grade", grade.otherwise("F"))
    text = F.when(F.col("grade").isNull(), F.lit(None))
    for g, t in TEXTS.items():
        text = text.when(F.col("grade") == g, t)
    return a.select(*key, "runs", "score", "grade", F.col("wfe").isNull().alias("provisional"), F.round("wfe", 3).alias("wfe"),
                    *[F.round(n, 1).alias(n) for n in AXES], text.alias("interpretation"))


def scenario_verdict(runs: DataFrame, base: DataFrame, key: Sequence[str], soft: float = -5.0, hard: float = -20.0) -> DataFrame:
    """Change of the median return against the baseline, with adjustable cut-offs."""
    key = list(key)
    s = runs.groupBy(*key, "scenario").agg(F.min("return_pct").alias("_w"), F.count(F.lit(1)).alias("runs"))
    s = s.join(exact_percentiles(runs, [*key, "scenario"], "return_pct", {"_m": 0.5}), [*key, "scenario"])
    d = s.join(base.select(*key, F.col("return_pct").alias("_b")), key)
    delta = F.col("_m") - F.col("_b")
    return d.select(*key, "scenario", "runs", F.round("_b", 2).alias("baseline_pct"), F.round("_m", 2).alias("median_pct"), F.round("_w", 2).alias("worst_pct"),
                    F.round(delta, 2).alias("delta_pct"), F.when(delta > soft, "SURVIVED").when(delta > hard, "DEGRADED").otherwise("SEVERE").alias("verdict"))


def path_summary(runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Return quantiles, means and the share of profitable paths."""
    key = list(key)
    a = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_paths"), F.avg("return_pct").alias("_m"), F.avg((F.col("return_pct") > 0).cast("double")).alias("_up"),
                               F.avg("sharpe").alias("_s"), F.avg("max_dd_pct").alias("_d"))
    a = a.join(exact_percentiles(runs, key, "return_pct", TAILS), key)
    return a.select(*key, "n_paths", *[F.round(n, 2).alias(f"return_{n}") for n in TAILS],
                    F.round("_m", 2).alias("mean_return"), F.round(F.col("_up") * 100, 1).alias("prob_profit_pct"),
                    F.round("_s", 3).alias("mean_sharpe"), F.round("_d", 2).alias("mean_max_dd"))


def compare_methods(methods: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Summaries of several resampling methods side by side."""
    out = None
    for name, d in methods.items():
        d = d.withColumn("method", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return path_summary(out, [*key, "method"])


def run_log(runs: DataFrame, where: str = "all", by: str = "return_pct") -> DataFrame:
    cond = {"all": F.lit(True), "profitable": F.col("return_pct") > 0, "losing": F.col("return_pct") <= 0}[where]
    return runs.filter(cond).orderBy(F.desc(by), "run_id")


def run_log_totals(runs: DataFrame, key: Sequence[str]) -> DataFrame:
    return runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("return_pct") > 0).alias("profitable"),
                                  F.round(F.sum("return_pct"), 4).alias("total_return"), F.sum("num_trades").alias("total_trades"))


def path_performance(paths: DataFrame, key: Sequence[str], path: str = "path_id") -> DataFrame:
    """Buy-and-hold return, drawdown and Sharpe of every path (bounded by its horizon)."""
    k = [*key, path]
    w = Window.partitionBy(*k).orderBy("step")
    d = paths.withColumns({"_r": F.col("close") / F.lag("close").over(w) - 1,
                           "_pk": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    a = d.groupBy(*k).agg((F.max_by("close", "step") / F.min_by("open", "step") * 100 - 100).alias("_ret"), F.min(F.col("close") / F.col("_pk") - 1).alias("_dd"),
                          F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    return a.select(*k, F.round("_ret", 4).alias("return_pct"), F.round(F.col("_dd") * 100, 4).alias("max_dd_pct"),
                    F.round(F.when(F.col("_s") > 1e-10, F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).otherwise(0.0), 4).alias("sharpe"),
                    F.round(100 * (1 + F.col("_ret") / 100), 4).alias("final_value"))
