"""Strategy runs as rows of a table: sweeps of any family, walk-forward, stressed and resampled paths.

A job is one row: key columns, ``param_id``, ``strategy`` (GRID, DCA, PLA or the name of a preset), ``option`` (spacing of
the grid, exit of the cascade), ``params`` (numbers by name) and the ``levels`` and ``amounts`` of a cascade.  Bars meet
jobs by an equi-join, so the grid stays a table; every run is a group of rows and all runs share one ledger plan.  A job
that cannot run or does not trade is a result row with its ``error``.

A key may be a symbol, a stressed series (symbol, scenario, run) or a path (symbol, path): the key is any list of columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import signals as G
from .blocks import BLOCK, block_of, span
from .indicators import Panel, open_panel, use
from .metrics import performance
from .montecarlo import scenario_verdict
from .positions import equity_curve, round_trips
from .presets import PRESETS, preset_flags
from .regimes import classify_regimes, regime_distribution, regime_mix
from .scenarios import PRESETS as SCENARIOS
from .scenarios import apply_scenario, plan_runs, stressed_slippage
from .sweep import DCA_EXITS, DCA_RANGES, GRID_RANGES, PLA_RANGES, cap
from .validation import assign_folds, holdout_split, holdout_verdict, make_folds

CELLS = 16           # a hot key's bars meet its jobs in this many tasks
BARS = ("rn", "ts", "open", "high", "low", "close", "volume")
METRICS = ("total_return_pct", "annualised_return_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown_pct", "volatility_pct",
           "num_trades", "win_rate", "profit_factor", "final_equity")


def job(strategy: str, option: str | None = None, levels: Sequence[float] | None = None, amounts: Sequence[float] | None = None, **params) -> tuple:
    """One parameter set, to be numbered by ``jobs_for``."""
    return strategy, option, params, levels, amounts


def classic_jobs(lower: float | None = None, upper: float | None = None) -> list[tuple]:
    """The classic grids (24 GRID, 108 DCA, 81 PLA sets); without bounds GRID takes those of its bars."""
    bounds = {} if lower is None else {"lower": lower, "upper": upper}
    out = [job("GRID", sp, num_levels=n, invest=inv, **bounds) for n, sp, inv in itertools.product(*GRID_RANGES.values())]
    out += [job("DCA", e, hours=h, invest=inv, hold_days=d, target=t) for h, inv, d in itertools.product(*DCA_RANGES.values()) for e, t in DCA_EXITS]
    out += [job("PLA", x, lv, am, fast=f, slow=s, target=tp) for (f, s), lv, am, (x, tp) in itertools.product(*PLA_RANGES.values())]
    return out


def jobs_for(keys: DataFrame, sets: Sequence[tuple]) -> DataFrame:
    """Every key with every parameter set: the sets are a literal array, so one row per key fans out without a join."""
    def arr(v):
        return F.lit(None).cast("array<double>") if v is None else F.array(*[F.lit(float(x)) for x in v])
    rows = [F.struct(F.lit(i).cast("bigint").alias("param_id"), F.lit(s).alias("strategy"), F.lit(o).cast("string").alias("option"),
                     F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, float(v))]).cast("map<string,double>").alias("params"),
                     arr(lv).alias("levels"), arr(am).alias("amounts")) for i, (s, o, p, lv, am) in enumerate(sets, 1)]
    return keys.select(*keys.columns, F.explode(F.array(*rows)).alias("_j")).select(*keys.columns, "_j.*")


def number(name: str, default: float | None = None) -> Column:
    v = F.col("params")[name]
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def job_problem() -> Column:
    """Why a job cannot run, or null."""
    s, p = F.col("strategy"), number
    grid = (F.when(~p("num_levels", 10).between(2, 10_000), "GRID needs 2 to 10000 levels")
            .when(p("lower").isNull() != p("upper").isNull(), "GRID needs both bounds or none")
            .when(p("lower") >= p("upper"), "lower bound is not below the upper one")
            .when(~F.coalesce("option", F.lit("linear")).isin("linear", "exponential"), "unknown spacing")
            .when((F.col("option") == "exponential") & (p("lower") <= 0), "exponential spacing needs positive bounds"))
    dca = (F.when((p("hours", 24) <= 0) | (p("hold_days", 30) <= 0), "DCA needs positive times")
           .when(~F.coalesce("option", F.lit("time")).isin("time", "profit"), "unknown exit"))
    pla = (F.when(~F.coalesce("option", F.lit("crossover")).isin("crossover", "take_profit", "stop_loss"), "unknown exit")
           .when(p("fast", 12) >= p("slow", 26), "fast average is not shorter than the slow one").when(p("fast", 12) < 1, "lengths start at 1")
           .when(F.size(F.coalesce("levels", F.array())) != F.size(F.coalesce("amounts", F.array())), "levels and amounts differ in number"))
    return (F.when(s == "GRID", grid).when(s == "DCA", dca).when(s == "PLA", pla)
            .when(s.isin(*PRESETS), F.when(F.col("option").isNotNull(), "a preset has no option"))
            .otherwise(F.concat(F.lit("unknown strategy "), F.coalesce(s, F.lit("null")))))


def fan_out(bars: DataFrame, jobs: DataFrame, key: Sequence[str], cells: int = CELLS) -> DataFrame:
    """Bars of every job of their key.  Blocks of a key go to ``cells`` groups, each with its copy of the key's jobs."""
    b = bars.withColumn("_cell", F.pmod(block_of(F.col("rn"), BLOCK), F.lit(cells)).cast("int"))
    j = jobs.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return b.join(j, [*key, "_cell"]).drop("_cell")


SIGNAL = ("rn", "ts", "close", "signal", "quantity")


def grid_runs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Levels crossed since the previous close, for any number of levels, spacing and bounds per row.

    Bounds that are not given lie a tenth of the price range outside the closes (the lower one not below half the lowest).
    """
    key = list(key)
    p = Panel(bars.select(*key, "rn", "ts", "close"), key, 1, size)
    p.put("_prev", p.lag(F.col("close")))
    b = p.close()
    ends = bars.groupBy(*key).agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    j = jobs.join(ends, key)
    pad = (F.col("_hi") - F.col("_lo")) * 0.10
    j = j.select(*key, "param_id", number("num_levels", 10).cast("int").alias("_n"), (F.coalesce("option", F.lit("linear")) == "exponential").alias("_exp"),
                 number("invest", 100).alias("_inv"), F.coalesce(number("lower"), F.greatest(F.col("_lo") * 0.5, F.col("_lo") - pad)).alias("_lo"),
                 F.coalesce(number("upper"), F.col("_hi") + pad).alias("_hi"))
    even, ratio = (G.grid_levels(F.col("_lo"), F.col("_hi"), F.col("_n"), s) for s in ("linear", "exponential"))
    j = j.withColumn("_lv", F.when(F.col("_exp"), ratio).otherwise(even)).drop("_n", "_exp", "_lo", "_hi")
    d = fan_out(b, j, key)
    prev, cur = F.col("_prev"), F.col("close")
    ups = F.size(F.filter("_lv", lambda x: (prev < x) & (x <= cur)))
    dns = F.size(F.filter("_lv", lambda x: (prev > x) & (x >= cur)))
    d = d.withColumns({"_u": F.when(prev.isNull(), 0).otherwise(ups), "_d": F.when(prev.isNull(), 0).otherwise(dns)})
    hit = F.when(F.col("_u") > 0, F.col("_u")).otherwise(F.col("_d"))
    return d.withColumns({"signal": F.when(F.col("_u") > 0, G.SELL).when(F.col("_d") > 0, G.BUY).otherwise(G.HOLD),
                          "quantity": F.when(hit > 0, G.order_qty(cur, F.col("_inv"), 0.001) * hit).otherwise(0.0)}).select(*key, "param_id", *SIGNAL)


def dca_runs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Regular buys with a time exit (cycles by arithmetic) or a profit exit (a fold per run)."""
    key = list(key)
    k = [*key, "param_id"]
    n = bars.groupBy(*key).agg(F.max("rn").alias("n"))
    gap = G.spacing_hours(bars, key, size).join(n, key)
    j = jobs.join(gap, key).select(
        *k, "n", (F.coalesce("option", F.lit("time")) == "profit").alias("_by_profit"), number("invest", 100).alias("_inv"), number("target", 10).alias("_tp"),
        F.greatest(F.lit(1), F.rint(number("hours", 24) / F.col("spacing_h"))).cast("long").alias("every"),
        F.greatest(F.lit(1), F.rint(number("hold_days", 30) * 24.0 / F.col("spacing_h"))).cast("long").alias("hold"))
    d = fan_out(bars.select(*key, "rn", "ts", "close"), j, key)
    t = d.filter(~F.col("_by_profit")).withColumns({"_cycle": F.floor((F.col("rn") - 1) / (F.col("hold") + 1)), "_at": (F.col("rn") - 1) % (F.col("hold") + 1)})
    t = t.withColumn("_q", F.when((F.col("_at") < F.col("hold")) & (F.col("_at") % F.col("every") == 0), G.order_qty(F.col("close"), F.col("_inv"), 0.001)).otherwise(0.0))
    t = t.withColumn("_sum", F.sum("_q").over(span([*k, "_cycle"])))
    sell = ((F.col("_at") == F.col("hold")) | (F.col("rn") == F.col("n"))) & (F.col("_sum") > 0)
    t = t.withColumns({"signal": F.when(sell, G.SELL).when(F.col("_q") > 0, G.BUY).otherwise(G.HOLD),
                       "quantity": F.when(sell, F.col("_sum")).otherwise(F.col("_q"))}).select(*k, *SIGNAL)
    if jobs.filter("option = 'profit'").isEmpty():
        return t

    def fold(pdf, s):
        run = G._dca_profit_fold(float(pdf["_inv"].iloc[0]), 0.001, float(pdf["_tp"].iloc[0]))
        return run(pdf, s)
    x = stage(d.filter("_by_profit"))
    x = G.chained_fold(x, k, fold, [0.0, 0.0, 0.0], G._doubles("_act", "quantity"), ["close", "n", "every", "hold", "_inv", "_tp"], size=size)
    x = x.withColumn("signal", F.when(F.col("_act") == 1, G.BUY).when(F.col("_act") == 2, G.SELL).otherwise(G.HOLD)).select(*k, *SIGNAL)
    return t.unionByName(x)


def pla_runs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Averaging-down cascades.  Each distinct average of the grid is built once per key, in one pass over its bars.

    The driver learns the distinct lengths and the largest number of levels of the grid.
    """
    key = list(key)
    k = [*key, "param_id"]
    j = jobs.select(*k, F.coalesce("option", F.lit("crossover")).alias("_exit"), number("fast", 12).cast("int").alias("_f"), number("slow", 26).cast("int").alias("_s"),
                    number("target", 5).alias("_tp"), F.coalesce("levels", F.array(*[F.lit(v) for v in G.PLA_LEVELS])).alias("_lv"),
                    F.coalesce("amounts", F.array(*[F.lit(v) for v in G.PLA_INVEST])).alias("_am"))
    shape = j.agg(F.collect_set("_f").alias("f"), F.collect_set("_s").alias("s"), F.max(F.size("_lv")).alias("m")).first()
    lengths = sorted({*shape.f, *shape.s})
    p = open_panel(bars, key, [use("ema", f"_{n}", length=n) for n in lengths], extra=1, size=size)
    pairs = []
    for n in lengths:
        cur = F.col(f"ema_{n}")
        pairs += [F.lit(n), F.struct(cur.alias("cur"), p.put(f"_was_{n}", p.lag(cur)).alias("was"))]
    b = p.close().withColumn("_ma", F.create_map(*pairs)).select(*key, "rn", "ts", "close", "_ma")
    d = fan_out(b, j, key)
    f, s = F.col("_ma")[F.col("_f")], F.col("_ma")[F.col("_s")]
    d = stage(d.withColumns({"_diff": f["cur"] - s["cur"], "_prev": f["was"] - s["was"]}).drop("_ma", "_f", "_s"))

    def fold(pdf, state):
        one = pdf.iloc[0]
        tp = float(one["_tp"])
        return G._pla_fold([float(v) for v in one["_lv"]], [float(v) for v in one["_am"]], one["_exit"], tp, tp)(pdf, state)
    x = G.chained_fold(d, k, fold, [0.0] * (3 + max(2, shape.m)), G._doubles("_act", "quantity", "_why"), ["close", "_prev", "_diff", "_lv", "_am", "_exit", "_tp"], size=size)
    return x.withColumn("signal", F.when(F.col("_act") == 1, G.BUY).when(F.col("_act") == 2, G.SELL).otherwise(G.HOLD)).select(*k, *SIGNAL)


def preset_runs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Presets with any parameters: flags once per distinct parameter set and key, then one latch for all runs.

    The driver learns the distinct sets, a small grid; flags are written set by set, so no plan grows with their number.
    """
    key = list(key)
    sets = jobs.groupBy("strategy", F.map_entries("params").alias("p")).agg(F.min("param_id").alias("i")).orderBy("i").collect()
    out = None
    for r in sets:
        given = {e.key: e.value for e in r.p or []}
        own = {n: int(v) if isinstance(PRESETS[r.strategy].params.get(n), int) else v for n, v in given.items()}
        ids = jobs.filter((F.col("strategy") == r.strategy) & (F.map_entries("params") == F.array(*[
            F.struct(F.lit(n).alias("key"), F.lit(v).alias("value")) for n, v in given.items()]).cast("array<struct<key:string,value:double>>")))
        flags = preset_flags(bars, key, r.strategy, size, **own).select(*key, "rn", "ts", "close", "entry", "exit")
        part = stage(fan_out(flags, ids.select(*key, "param_id", number("invest", 1000).alias("_inv")), key))
        out = part if out is None else out.unionByName(part)
    return G.signals_from_masks(out, [*key, "param_id"], F.col("_inv"), size=size).select(*key, "param_id", *SIGNAL)


FAMILIES = {"GRID": grid_runs, "DCA": dca_runs, "PLA": pla_runs}


def job_signals(bars: DataFrame, jobs: DataFrame, key: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Signals of every runnable job, keyed by (key, param_id).  ``bars`` and ``jobs`` should be staged."""
    names = {r.strategy for r in jobs.select("strategy").distinct().collect()}
    parts = [fn(bars, jobs.filter(F.col("strategy") == n), key, size) for n, fn in FAMILIES.items() if n in names]
    if names - set(FAMILIES):
        parts.append(preset_runs(bars, jobs.filter(~F.col("strategy").isin(*FAMILIES)), key, size))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def run_jobs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], capital: float = 100_000.0, slippage: str | None = None, size: int = BLOCK) -> DataFrame:
    """One row of metrics per job, also for those that fail: ``error`` says why, their numbers are zero.

    ``slippage`` names a column that is constant within a key (a stressed slippage); without it the usual 0.1 % is paid.
    Jobs of keys without bars end as ``no data``; an empty table of jobs gives an empty result.
    """
    key = list(key)
    k = [*key, "param_id"]
    has = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("_bars"), *([F.first(slippage).alias("_slip")] if slippage else []))
    jobs = stage(jobs.join(has, key, "left").withColumn("error", F.coalesce(job_problem(), F.when(F.col("_bars").isNull(), "no data"))))
    good = jobs.filter("error is null")
    kept = jobs.select(*k, "strategy", "option", "params", "error")
    if good.isEmpty():
        zero = {m: F.lit(float(capital)) if m == "final_equity" else F.lit(0).cast("bigint") if m == "num_trades" else F.lit(0.0) for m in METRICS}
        return kept.withColumns(zero)
    cols = [c for c in BARS if c in bars.columns]
    sig = job_signals(bars.select(*key, *cols), good.drop("_bars", "error", "_slip"), key, size)
    slip, ks = 0.001, k
    if slippage:
        # the column is a function of the key, so it may ride along as one more key column
        sig = sig.join(good.select(*k, "_slip"), k)
        slip, ks = F.col("_slip"), [*k, "_slip"]
    sig = stage(sig)
    m = performance(stage(equity_curve(sig, ks, capital, slip, size=size)), round_trips(sig, ks, slip, size=size), ks, size)
    m = kept.join(m.select(*k, *METRICS), k, "left")
    m = m.withColumn("error", F.coalesce("error", F.when(F.coalesce("num_trades", F.lit(0)) == 0, "no trades")))
    return m.na.fill(0, [c for c in METRICS if c != "final_equity"]).na.fill({"final_equity": float(capital)})


def sweep_jobs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], capital: float = 100_000.0, size: int = BLOCK) -> DataFrame:
    """Runs for ranking: ratios within [-20, 20], so that a run without a losing trade (an infinite factor) compares."""
    m = run_jobs(bars, jobs, key, capital, size=size)
    return m.withColumns({c: cap(F.col(c)) for c in ("sharpe_ratio", "sortino_ratio", "calmar_ratio", "profit_factor")})


# ------------------------------------------------------------------ walk-forward

def walk_forward_jobs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], window: int = 252, step: int = 63, interval: str = "1d",
                      capital: float = 100_000.0, size: int = BLOCK) -> DataFrame:
    """Best parameter set of each train window, applied to its test window; any strategy, sets that cannot run never win.

    Bounds a GRID lacks come from its train window and hold in the test window too.  A set that does not trade counts
    with a Sharpe ratio of zero; ties keep the smallest ``param_id``.
    """
    key = list(key)
    folds = stage(make_folds(bars, key, window, step, interval))
    seg = stage(assign_folds(bars.select(*key, *BARS), folds, key))
    train = seg.filter("part = 'train'")
    ends = train.groupBy(*key, "fold").agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    pad = (F.col("_hi") - F.col("_lo")) * 0.10
    bounds = F.create_map(F.lit("lower"), F.greatest(F.col("_lo") * 0.5, F.col("_lo") - pad), F.lit("upper"), F.col("_hi") + pad)
    j = jobs.join(ends, key)
    lacks = (F.col("strategy") == "GRID") & number("lower").isNull() & number("upper").isNull()
    j = stage(j.withColumn("params", F.when(lacks, F.map_concat("params", bounds)).otherwise(F.col("params"))).drop("_lo", "_hi"))
    k = [*key, "fold"]
    ran = stage(run_jobs(stage(train.drop("part")), j, k, capital, size=size))
    best = ran.filter("error is null or error = 'no trades'").groupBy(*k).agg(F.max_by(F.struct("param_id", "sharpe_ratio"), F.struct("sharpe_ratio", (-F.col("param_id")).alias("_t"))).alias("_b"))
    best = stage(best.select(*k, F.col("_b.param_id").alias("param_id"), F.round("_b.sharpe_ratio", 3).alias("train_sharpe")))
    chosen = j.join(best.select(*k, "param_id"), [*k, "param_id"], "left_semi")
    test = run_jobs(stage(seg.filter("part = 'test'").drop("part")), chosen, k, capital, size=size)
    return best.join(test, [*k, "param_id"]).select(
        *k, "param_id", "strategy", "train_sharpe", F.round("total_return_pct", 3).alias("return_pct"), F.round("sharpe_ratio", 3).alias("sharpe"),
        F.round("max_drawdown_pct", 3).alias("max_dd_pct"), "num_trades", "win_rate", "error")


def holdout_jobs(bars: DataFrame, jobs: DataFrame, key: Sequence[str], ratio: float = 0.7, capital: float = 100_000.0, size: int = BLOCK) -> DataFrame:
    """In-sample against out-of-sample metrics of every job with the verdict; ``bars`` carries ``n``."""
    key = list(key)
    d = holdout_split(bars, ratio)
    d = stage(d.withColumn("rn", F.col("part_rn")).select(*key, "part", *BARS))
    j = jobs.withColumn("part", F.explode(F.array(F.lit("in"), F.lit("out"))))
    m = stage(run_jobs(d, j, [*key, "part"], capital, size=size))
    k = [*key, "param_id"]
    v = holdout_verdict(m.filter("part = 'in'"), m.filter("part = 'out'"), k)
    t = m.groupBy(*k).agg(*[F.max(F.when(F.col("part") == p, F.col("num_trades"))).alias(f"{p}_trades") for p in ("in", "out")])
    return v.join(t, k)


# ------------------------------------------------------------------ stressed and resampled series

def as_runs(m: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Metrics under the names that the run reports read."""
    return m.select(*ids, F.col("total_return_pct").alias("return_pct"), F.col("max_drawdown_pct").alias("max_dd_pct"), F.col("sharpe_ratio").alias("sharpe"),
                    F.col("sortino_ratio").alias("sortino"), F.col("calmar_ratio").alias("calmar"), "win_rate", "num_trades", "final_equity", "error")


def stressed_runs(bars: DataFrame, spark: SparkSession, sets: Sequence[tuple], runs: int, severity: float = 1.0, seed: int = 7,
                  names: Sequence[str] | None = None, capital: float = 10_000.0, slippage: float = 0.001, size: int = BLOCK) -> DataFrame:
    """A strategy on every shocked copy of the bars, paying the scenario's slippage: one row per (symbol, scenario, run, set)."""
    k = ["symbol", "scenario", "run_id"]
    x = apply_scenario(bars, plan_runs(bars, spark, runs, severity, seed, names), seed, size)
    # the multiplier is a fixed value per scenario (17 literals), so no table is joined
    mult = F.coalesce(*[F.when(F.col("scenario") == n, F.lit(float(v["slip_mult"]))) for n, v in SCENARIOS.items() if "slip_mult" in v], F.lit(1.0))
    # Rounded like prices: a path that is rebuilt must not differ in its last bits from the one that was drawn.
    x = stage(x.select(*k, "rn", "ts", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume",
                       stressed_slippage(slippage, mult, F.col("severity")).alias("slip")))
    keys = stage(x.select(*k).distinct())
    return as_runs(run_jobs(x, jobs_for(keys, sets), k, capital, "slip", size), [*k, "param_id"])


def stress_report(stressed: DataFrame, bars: DataFrame, sets: Sequence[tuple], capital: float = 10_000.0, size: int = BLOCK) -> DataFrame:
    """Verdict per scenario against the same strategy on the untouched bars."""
    keys = stage(bars.select("symbol").distinct())
    base = stage(as_runs(run_jobs(bars, jobs_for(keys, sets), ["symbol"], capital, size=size), ["symbol", "param_id"]))
    return scenario_verdict(stressed, base, ["symbol", "param_id"])


def path_runs(hist: DataFrame, paths: DataFrame, sets: Sequence[tuple], warmup: int = 64, every: int = 86_400,
              capital: float = 10_000.0, size: int = BLOCK) -> DataFrame:
    """A strategy on every resampled path, begun on the last ``warmup`` bars of history: one row per (symbol, path, set).

    The warm-up bars let indicators settle; they are part of the run, as the paths continue the history.
    """
    k = ["symbol", "path_id"]
    x = stage(path_bars(hist, paths, warmup, every))
    return as_runs(run_jobs(x, jobs_for(stage(x.select(*k).distinct()), sets), k, capital, size=size), [*k, "param_id"])


def path_bars(hist: DataFrame, paths: DataFrame, warmup: int = 64, every: int = 86_400) -> DataFrame:
    """Warm-up bars and path of every (symbol, path), numbered from 1, one bar in ``every`` seconds.

    A path of a symbol with less history than ``warmup`` is numbered from the bars it has.
    """
    from ..sources.bars import with_warmup
    h = hist.groupBy("symbol").agg(F.least(F.max("n"), F.lit(warmup)).cast("long").alias("_h"))
    p = with_warmup(hist, paths.withColumn("step", F.col("step").cast("long")), warmup).join(h, "symbol")
    rn = F.col("step") + F.col("_h")
    return p.select("symbol", "path_id", rn.alias("rn"), F.timestamp_seconds(rn * every).cast("timestamp_ntz").alias("ts"),
                    *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume")


def path_regimes(paths: DataFrame, size: int = BLOCK) -> DataFrame:
    """Dominant regime of every path by the classifier of bars; ``paths`` as from ``path_bars``."""
    k = ["symbol", "path_id"]
    lab = stage(classify_regimes(paths, k, size))
    return regime_mix(lab, k).filter("dominant").select(*k, "regime", "share_pct")


def path_report(runs: DataFrame, regimes: DataFrame) -> DataFrame:
    """Share of paths by dominant regime and of paths that end with a profit, per strategy set."""
    return regime_distribution(runs.join(regimes.select("symbol", "path_id", "regime"), ["symbol", "path_id"]), ["symbol", "param_id"])
