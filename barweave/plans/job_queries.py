"""Sweeps of any strategy family, walk-forward and hold-out of any strategy, strategies on stressed and resampled paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import montecarlo as C
from ..operators import sweep as W
from ..session import stage
from ..sources.tables import event_bars, order_bars
from .oracle import Sql, lag, latch_tail, roll
from .position_queries import CAP, EQUITY, PERF, TRADES, TS, ledger_sql, regime_sql, walk_sql
from .registry import ORACLE, OVER, bars_cte, fin, query, rx, secs
from .signal_queries import K, SMA_SIGNALS, flags_sql
from .whatif_queries import BOOT, RUNS, robust_sql

OUT = ["error", "total_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "num_trades", "win_rate", "profit_factor", "final_equity"]
# Everything after the equity rows, for ledgers: bars per day, performance and trade counts of each series.
CPD = f"cpd AS (SELECT symbol, greatest(1.0 / 31, 86400 / median(g)) AS cpd FROM (SELECT symbol, {secs('ts')} - lag({secs('ts')}) OVER ({OVER}) AS g FROM bars WHERE rn <= 50) GROUP BY symbol)"
LEDGER = f"{ledger_sql('x')}, eqs AS (SELECT * FROM leq), {CPD}{PERF[len(EQUITY):]}, trades AS (SELECT * FROM ltrades), ts AS ({TS})"


def part(i: int, kind: str = "BIGINT") -> str:
    return f"CAST(split_part(symbol, '|', {i}) AS {kind})"


def job_rows(failed: dict[int, str], src: str = "b0") -> str:
    """Result rows of all runs, and of the sets that cannot run for every symbol of ``src``."""
    good = f"""SELECT split_part(symbol, '|', 1) AS symbol, {part(2)} AS param_id, CASE WHEN num_trades IS NULL THEN 'no trades' END AS error, total_return_pct, {', '.join(f'least(greatest({c}, -20.0), 20.0) AS {c}' for c in ('sharpe_ratio', 'sortino_ratio'))}, max_drawdown_pct,
      coalesce(num_trades, 0) AS num_trades, coalesce(win_rate, 0.0) AS win_rate, CASE WHEN num_trades IS NULL THEN 0.0 WHEN gross_loss = 0 THEN CASE WHEN gross_profit > 0 THEN 20.0 ELSE 0.0 END ELSE least(profit_factor, 20.0) END AS profit_factor, final_equity FROM perf LEFT JOIN ts USING (symbol)"""
    bad = [f"SELECT DISTINCT symbol, {i}::BIGINT, '{why}', 0.0, 0.0, 0.0, 0.0, 0::BIGINT, 0.0, 0.0, {CAP} FROM {src}" for i, why in failed.items()]
    return " UNION ALL ".join([good, *bad])


def swept(s, d, sets, interval="1h"):
    b = stage(event_bars(s, d, interval))
    return J.sweep_jobs(b, J.jobs_for(b.select("symbol").distinct(), sets), K, CAP)


# ------------------------------------------------------------------ GRID

GRID_SETS = [J.job("GRID", "linear", num_levels=7, invest=500, lower=105, upper=240), J.job("GRID", "exponential", num_levels=5, invest=1000, lower=105, upper=240),
             J.job("GRID", "linear", num_levels=4, invest=200), J.job("GRID", "exponential", num_levels=6, invest=200), J.job("GRID", "linear", num_levels=5, invest=200, lower=240, upper=105),
             J.job("GRID", "spiral", num_levels=5, invest=200), J.job("GRID", "linear", num_levels=5, invest=200, lower=900, upper=990)]


def grid_x(src: str) -> str:
    """Signals of grid runs; ``src`` carries bounds ``lo``, ``hi``, levels ``nl``, spacing ``ex`` and amount ``inv`` per series."""
    level = "CASE WHEN ex THEN exp(ln(lo) + i * (ln(hi) - ln(lo)) / (nl - 1)) ELSE lo + i * (hi - lo) / (nl - 1) END"
    return f"""gl AS (SELECT symbol, rn, ts, close, lo, hi, nl, ex, inv, {lag('close')} AS p FROM {src}),
   gc AS (SELECT symbol, ts, close, inv, count(*) FILTER (p < lv AND lv <= close) AS u, count(*) FILTER (p > lv AND lv >= close) AS v FROM (SELECT *, {level} AS lv FROM gl, (SELECT unnest(range(0, 10)) AS i) WHERE i < nl) GROUP BY ALL),
   x AS MATERIALIZED (SELECT symbol, ts, CASE WHEN u > 0 THEN 'SELL' WHEN v > 0 THEN 'BUY' ELSE 'HOLD' END AS signal, CASE WHEN u > 0 THEN inv / close * u ELSE inv / close * v END AS quantity FROM gc)"""


ENDS = "greatest(min(close) * 0.5, min(close) - (max(close) - min(close)) * 0.1) AS dlo, max(close) + (max(close) - min(close)) * 0.1 AS dhi"


@query("sweep_grid", f"""WITH RECURSIVE {bars_cte('hour', 'b0')}, ends AS (SELECT symbol, {ENDS} FROM b0 GROUP BY symbol),
   g(pid, nl, ex, inv, lo, hi) AS (VALUES (1, 7, false, 500.0::DOUBLE, 105.0::DOUBLE, 240.0::DOUBLE), (2, 5, true, 1000.0, 105.0, 240.0), (3, 4, false, 200.0, NULL, NULL), (4, 6, true, 200.0, NULL, NULL), (7, 5, false, 200.0, 900.0, 990.0)),
   bars AS MATERIALIZED (SELECT b0.symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, n, nl, ex, inv, coalesce(lo, dlo) AS lo, coalesce(hi, dhi) AS hi FROM b0 JOIN ends USING (symbol), g),
   {grid_x('bars')}{LEDGER} {job_rows({5: 'lower bound is not below the upper one', 6: 'unknown spacing'})}""")
def _(s, d):
    return swept(s, d, GRID_SETS).select("symbol", "param_id", *OUT)


# ------------------------------------------------------------------ DCA

DCA_SETS = [J.job("DCA", "time", hours=6, invest=100, hold_days=2), J.job("DCA", "time", hours=24, invest=300, hold_days=5), J.job("DCA", "profit", hours=6, invest=100, hold_days=2, target=12),
            J.job("DCA", "profit", hours=12, invest=500, hold_days=7, target=5), J.job("DCA", "time", hours=0, invest=100, hold_days=2)]


@query("sweep_dca", f"""WITH RECURSIVE {bars_cte('hour', 'b0')}, sp AS (SELECT symbol, median(gap) AS h FROM (SELECT symbol, (epoch_us(ts) - epoch_us({lag('ts')})) / 3.6e9 AS gap FROM b0) GROUP BY symbol),
   g(pid, hours, inv, days, tp) AS (VALUES (1, 6, 100.0::DOUBLE, 2, 1e300::DOUBLE), (2, 24, 300.0, 5, 1e300), (3, 6, 100.0, 2, 12.0), (4, 12, 500.0, 7, 5.0)),
   bars AS MATERIALIZED (SELECT b0.symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, n, inv, tp, greatest(1, round_even(hours / h, 0))::BIGINT AS ev, greatest(1, round_even(days * 24 / h, 0))::BIGINT AS hd FROM b0 JOIN sp USING (symbol), g),
   st(symbol, rn, pos, held, av, act, q) AS (SELECT symbol, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0, 0::DOUBLE FROM bars WHERE rn = 1 UNION ALL
   SELECT symbol, rn, CASE WHEN sell THEN 0 ELSE pos + 1 END, CASE WHEN sell THEN 0 ELSE h2 END, CASE WHEN sell THEN 0 ELSE a2 END, CASE WHEN sell THEN 2 WHEN bq > 0 THEN 1 ELSE 0 END, CASE WHEN sell THEN h2 ELSE bq END FROM
    (SELECT *, h2 > 0 AND ((close - a2) / a2 * 100 >= tp OR pos >= hd OR rn = n) AS sell FROM (SELECT *, held + bq AS h2, CASE WHEN held + bq > 0 THEN (av * held + close * bq) / (held + bq) ELSE 0 END AS a2 FROM
      (SELECT s.symbol, s.rn, s.n, s.close, s.hd, s.tp, e.pos, e.held, e.av, CASE WHEN e.pos < s.hd AND e.pos % s.ev = 0 THEN s.inv / s.close ELSE 0 END AS bq FROM st e JOIN bars s ON s.symbol = e.symbol AND s.rn = e.rn + 1)))),
   x AS MATERIALIZED (SELECT b.symbol, b.ts, CASE act WHEN 1 THEN 'BUY' WHEN 2 THEN 'SELL' ELSE 'HOLD' END AS signal, q AS quantity FROM bars b JOIN st USING (symbol, rn)){LEDGER} {job_rows({5: 'DCA needs positive times'})}""")
def _(s, d):
    return swept(s, d, DCA_SETS).select("symbol", "param_id", *OUT)


# ------------------------------------------------------------------ PLA

L1, A1, L2, A2 = (0.0, -1.0, -2.5, -4.0), (200.0, 200.0, 400.0, 600.0), (0.0, -2.0, -6.0), (500.0, 500.0, 1000.0)
PLA_SETS = [J.job("PLA", "crossover", L1, A1, fast=9, slow=21), J.job("PLA", "take_profit", L1, A1, fast=5, slow=12, target=5), J.job("PLA", "take_profit", L2, A2, fast=9, slow=21, target=10),
            J.job("PLA", "stop_loss", L2, A2, fast=5, slow=12, target=8), J.job("PLA", "crossover", L1, A1, fast=21, slow=9), J.job("PLA", "crossover", L1, A2, fast=9, slow=21)]


def _pla() -> str:
    q = Sql("b0")
    e = {n: (q.ema("b0", "close", n), "y") for n in (5, 9, 12, 21)}
    j = q.join({f"e{n}": t for n, t in e.items()}, keep="b.ts, b.open, b.high, b.low, b.close, b.volume, b.n, ")
    vals = ", ".join([f"(1, 9, 'crossover', 5.0::DOUBLE, {list(L1)}::DOUBLE[], {list(A1)}::DOUBLE[])", f"(2, 5, 'take_profit', 5.0, {list(L1)}, {list(A1)})",
                      f"(3, 9, 'take_profit', 10.0, {[*L2, -1e9]}, {[*A2, 0.0]})", f"(4, 5, 'stop_loss', 8.0, {[*L2, -1e9]}, {[*A2, 0.0]})"])
    lv = lambda k: f"CASE WHEN inside AND NOT d{k} AND close <= first * (1 + lv[{k + 1}] / 100) THEN am[{k + 1}] / close ELSE 0 END"
    cond = "CASE ext WHEN 'crossover' THEN prv >= 0 AND cur < 0 WHEN 'take_profit' THEN (close - a2) / a2 * 100 >= tp ELSE (a2 - close) / a2 * 100 >= tp END"
    return f"""WITH RECURSIVE {bars_cte('hour', 'b0')}, {', '.join(q.ctes)}, g(pid, f, ext, tp, lv, am) AS (VALUES {vals}),
   jb AS (SELECT {j}.symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, n, ext, tp, lv, am, CASE f WHEN 9 THEN e9 - e21 ELSE e5 - e12 END AS cur FROM {j}, g),
   bars AS MATERIALIZED (SELECT *, {lag('cur')} AS prv FROM jb),
   st(symbol, rn, inside, first, av, held, d1, d2, d3, act, q) AS (SELECT symbol, 0::BIGINT, false, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, false, false, false, 0, 0::DOUBLE FROM bars WHERE rn = 1 UNION ALL
    SELECT symbol, rn, CASE WHEN sell THEN false ELSE inside OR fresh END, CASE WHEN sell THEN 0 WHEN fresh THEN close ELSE first END, CASE WHEN sell THEN 0 WHEN fresh THEN close ELSE a2 END, CASE WHEN sell THEN 0 WHEN fresh THEN am[1] / close ELSE h2 END,
      NOT sell AND (d1 OR b1 > 0), NOT sell AND (d2 OR b2 > 0), NOT sell AND (d3 OR b3 > 0), CASE WHEN sell THEN 2 WHEN fresh OR b1 + b2 + b3 > 0 THEN 1 ELSE 0 END,
      CASE WHEN sell THEN h2 WHEN fresh THEN am[1] / close ELSE b1 + b2 + b3 END FROM
     (SELECT *, inside AND coalesce({cond}, false) AS sell FROM (SELECT *, held + b1 + b2 + b3 AS h2, CASE WHEN inside THEN (av * held + close * (b1 + b2 + b3)) / (held + b1 + b2 + b3) ELSE 0 END AS a2 FROM
       (SELECT *, {lv(1)} AS b1, {lv(2)} AS b2, {lv(3)} AS b3 FROM
        (SELECT s.symbol, s.rn, s.close, s.prv, s.cur, s.ext, s.tp, s.lv, s.am, e.inside, e.first, e.av, e.held, e.d1, e.d2, e.d3, NOT e.inside AND coalesce(s.prv <= 0 AND s.cur > 0, false) AS fresh FROM st e JOIN bars s ON s.symbol = e.symbol AND s.rn = e.rn + 1))))),
   x AS MATERIALIZED (SELECT b.symbol, b.ts, CASE act WHEN 1 THEN 'BUY' WHEN 2 THEN 'SELL' ELSE 'HOLD' END AS signal, q AS quantity FROM bars b JOIN st USING (symbol, rn)){LEDGER}
   {job_rows({5: 'fast average is not shorter than the slow one', 6: 'levels and amounts differ in number'})}"""


@query("sweep_pla", _pla())
def _(s, d):
    return swept(s, d, PLA_SETS).select("symbol", "param_id", *OUT)


# ------------------------------------------------------------------ presets

PRESET_SETS = [("SMA_CROSS", dict(fast=3, slow=10)), ("SMA_CROSS", dict(fast=5, slow=20)), ("RSI", dict(oversold=45.0, overbought=55.0)), ("RSI", dict(oversold=1.0, overbought=99.0)), ("DONCHIAN", {})]
MISSING = ("NO_SUCH_PRESET", {})


def preset_series(src: str, sets, sql_src: str = "b0") -> tuple[str, str]:
    """Flags of every set on ``src`` as one table of series ``symbol|param_id``."""
    from ..operators.presets import PRESETS
    q, rows = Sql(src), []
    for i, (n, o) in enumerate(sets, 1):
        f = flags_sql(n, {**PRESETS[n].params, **o}, q)
        rows.append(f"SELECT symbol || '|{i}' AS symbol, rn, ts, close, entry, \"exit\" FROM {f}")
    return ", ".join(q.ctes), " UNION ALL ".join(rows)


def preset_sql(head: str, sets, src: str = "b0") -> str:
    """``head`` gives ``src``; the rest runs every set on it as one series ``symbol|param_id``."""
    ctes, rows = preset_series(src, sets)
    bars = f"bars AS MATERIALIZED (SELECT {src}.symbol || '|' || pid AS symbol, {src}.* EXCLUDE (symbol) FROM {src}, (SELECT unnest(range(1, {len(sets) + 1})) AS pid))"
    return f"{head}, {ctes}, flg AS MATERIALIZED ({rows}), {bars}, {', '.join(latch_tail('flg')[0])}{TRADES[len(SMA_SIGNALS):]}{PERF[len(SMA_SIGNALS):]}, ts AS ({TS})"


@query("sweep_preset", f"WITH RECURSIVE {preset_sql(bars_cte('hour', 'b0'), PRESET_SETS)} {job_rows({6: 'unknown strategy NO_SUCH_PRESET'})}")
def _(s, d):
    return swept(s, d, [J.job(n, **o) for n, o in [*PRESET_SETS, MISSING]]).select("symbol", "param_id", *OUT)


# ------------------------------------------------------------------ walk-forward and hold-out of any strategy

WF_SETS = [(3, 10), (3, 20), (5, 10), (5, 20)]


@query("walk_forward_preset", walk_sql(500, 250) + "SELECT *, 'SMA_CROSS' AS strategy, CASE WHEN num_trades = 0 THEN 'no trades' END AS error FROM walk")
def _(s, d):
    b = stage(order_bars(s, d))
    sets = [J.job("SMA_CROSS", fast=f, slow=w) for f, w in WF_SETS] + [J.job("SMA_CROSS", "odd", fast=3, slow=10)]
    return J.walk_forward_jobs(b, J.jobs_for(b.select("symbol").distinct(), sets), K, 500, 250)


def _walk_grid() -> str:
    base = walk_sql(500, 250)
    segs = base[:base.index("bars AS MATERIALIZED (SELECT symbol || '|' || pid")]
    tail = base[base.index(" m AS MATERIALIZED"):]
    return f"""{segs} tr AS (SELECT split_part(symbol, '|', 1) AS sym, split_part(symbol, '|', 2) AS fold, {ENDS} FROM segs WHERE split_part(symbol, '|', 3) = 'train' GROUP BY 1, 2),
   bars AS MATERIALIZED (SELECT symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, nl, ex, inv, dlo AS lo, dhi AS hi FROM segs JOIN tr ON sym = split_part(symbol, '|', 1) AND tr.fold = split_part(symbol, '|', 2), (VALUES (1, 4, false, 500.0::DOUBLE), (2, 8, false, 500.0), (3, 6, true, 500.0)) g(pid, nl, ex, inv)),
   {grid_x('bars')}{LEDGER}, {tail} SELECT *, 'GRID' AS strategy, CASE WHEN num_trades = 0 THEN 'no trades' END AS error FROM walk"""


@query("walk_forward_grid", _walk_grid())
def _(s, d):
    b = stage(order_bars(s, d))
    sets = [J.job("GRID", "linear", num_levels=4, invest=500), J.job("GRID", "linear", num_levels=8, invest=500), J.job("GRID", "exponential", num_levels=6, invest=500)]
    return J.walk_forward_jobs(b, J.jobs_for(b.select("symbol").distinct(), sets), K, 500, 250)


HOLD = f"""{bars_cte('hour', 'a0')}, a1 AS (SELECT *, greatest(1, least(n - 1, floor(n * 0.7::DOUBLE)))::BIGINT AS cut FROM a0),
   b0 AS MATERIALIZED (SELECT symbol || '|' || CASE WHEN rn <= cut THEN 'in' ELSE 'out' END AS symbol, ts, open, high, low, close, volume, CASE WHEN rn <= cut THEN rn ELSE rn - cut END AS rn FROM a1)"""


@query("holdout_jobs", f"""WITH RECURSIVE {preset_sql(HOLD, PRESET_SETS)}, m AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS part, {part(3)} AS param_id, sharpe_ratio AS s, total_return_pct AS t, coalesce(num_trades, 0) AS k FROM perf LEFT JOIN ts USING (symbol))
   SELECT a.symbol, a.param_id, a.s AS in_sharpe, a.t AS in_return_pct, b.s AS out_sharpe, b.t AS out_return_pct, CASE WHEN b.t < 0 THEN 'failed' WHEN a.s > 0.1 AND b.s < a.s * 0.5 THEN 'degraded' ELSE 'stable' END AS verdict, a.k AS in_trades, b.k AS out_trades
   FROM m a JOIN m b ON b.symbol = a.symbol AND b.param_id = a.param_id AND a.part = 'in' AND b.part = 'out'""")
def _(s, d):
    b = stage(event_bars(s, d))
    return J.holdout_jobs(b, J.jobs_for(b.select("symbol").distinct(), [J.job(n, **o) for n, o in PRESET_SETS]), K)


# ------------------------------------------------------------------ strategies on stressed paths

STRESS = ["gfc_2008", "covid_crash", "luna_collapse", "pump_dump", "slow_bleed", "trend_reversal", "liquidity_drought"]
STRESS_SETS = [("SMA_CROSS", dict(fast=5, slow=20))]


def fine(name: str) -> str:
    """A scenario query's SQL with prices to eight digits."""
    return ORACLE[name].replace(", 6) + 0.0 AS", ", 8) + 0.0 AS")


def _stress() -> str:
    """Series ``symbol#scenario#run#slippage`` of closing prices, then the single-strategy SQL with that slippage."""
    head = f"""sx AS MATERIALIZED (SELECT symbol, scenario, run_id, ts, close FROM ({fine('scenario_drift')}) UNION ALL SELECT symbol, scenario, run_id, ts, close FROM ({fine('scenario_noise')}) WHERE scenario = 'liquidity_drought'),
   sl AS MATERIALIZED ({ORACLE['stressed_slippage'].replace('0.001', '0.001::DOUBLE').replace(', 9) + 0.0 AS slippage', ', 15) AS slippage').replace(_runs(3), _runs(2))}),
   b0 AS MATERIALIZED (SELECT sx.symbol || '#' || scenario || '#' || run_id || '#' || slippage AS symbol, ts, close, row_number() OVER (PARTITION BY sx.symbol, scenario, run_id ORDER BY ts) AS rn FROM sx JOIN sl USING (symbol, scenario, run_id))"""
    slip = "split_part(symbol, '#', 4)"
    slip = f"split_part({slip}, '|', 1)::DOUBLE"
    body = preset_sql("", STRESS_SETS).lstrip(", ")
    body = body.replace("1.001", f"(1 + {slip})").replace("0.999", f"(1 - {slip})").replace(str(CAP), "10000.0")
    return f"""{head}, {body}, stress AS MATERIALIZED (SELECT split_part(symbol, '#', 1) AS symbol, split_part(symbol, '#', 2) AS scenario, split_part(symbol, '#', 3)::INTEGER AS run_id, {part(2)} AS param_id, total_return_pct AS return_pct, max_drawdown_pct AS max_dd_pct, sharpe_ratio AS sharpe,
     coalesce(win_rate, 0.0) AS win_rate, coalesce(num_trades, 0) AS num_trades, final_equity, CASE WHEN num_trades IS NULL THEN 'no trades' END AS error FROM perf LEFT JOIN ts USING (symbol))"""


def _runs(n: int) -> str:
    return f"unnest(range(1, {n + 1}))"


STRESSED = _stress()
S_COLS = ["symbol", "scenario", "run_id", "param_id", "return_pct", "max_dd_pct", "sharpe", "win_rate", "num_trades", "final_equity", "error"]


def stress_sets():
    return [J.job(n, **o) for n, o in STRESS_SETS]


def stressed(s, d):
    return stage(J.stressed_runs(event_bars(s, d), s, stress_sets(), 2, names=STRESS).select(*S_COLS))


@query("stressed_runs", f"WITH RECURSIVE {STRESSED} SELECT {', '.join(S_COLS)} FROM stress")
def _(s, d):
    return stressed(s, d)


# The run reports on real runs: a symbol's runs over all scenarios, numbered by scenario and run.
REAL = "runs AS MATERIALIZED (SELECT symbol, scenario || '-' || run_id AS run_id, return_pct, max_dd_pct, sharpe, win_rate, final_equity, num_trades FROM stress)"


def on_stress(sql: str) -> str:
    return sql.replace(f"WITH {RUNS}", f"WITH RECURSIVE {STRESSED}, {REAL}")


def real_runs(s, d):
    return stressed(s, d).withColumn("run_id", F.concat_ws("-", "scenario", F.col("run_id").cast("string")))


@query("stressed_percentiles", on_stress(ORACLE["run_percentiles"]))
def _(s, d):
    return C.run_percentiles(real_runs(s, d), K, ["return_pct", "max_dd_pct", "sharpe", "win_rate"])


@query("stressed_cvar_ruin", on_stress(ORACLE["cvar_ruin"]))
def _(s, d):
    return C.cvar_ruin(real_runs(s, d), K)


@query("stressed_representative", on_stress(ORACLE["representative_run"]))
def _(s, d):
    return C.representative_run(real_runs(s, d), K)


@query("stressed_robustness", on_stress(robust_sql(False)))
def _(s, d):
    return C.robustness(real_runs(s, d), K).select("symbol", "runs", "score", "grade", "provisional", "survival", "stability", "tail_safety")


BASE = f"base AS MATERIALIZED (SELECT split_part(symbol, '|', 1) AS symbol, total_return_pct AS bp FROM (WITH RECURSIVE {preset_sql(bars_cte('hour', 'b0'), STRESS_SETS)} SELECT * FROM perf))".replace(str(CAP), "10000.0")


@query("stressed_verdict", f"""WITH RECURSIVE {STRESSED}, {BASE}, z AS (SELECT symbol, scenario, param_id, count(*) AS runs, median(return_pct) AS m, min(return_pct) AS w FROM stress GROUP BY 1, 2, 3)
   SELECT symbol, param_id, scenario, runs, round(bp, 2) AS baseline_pct, round(m, 2) AS median_pct, round(w, 2) AS worst_pct, round(m - bp, 2) AS delta_pct, CASE WHEN m - bp > -5 THEN 'SURVIVED' WHEN m - bp > -20 THEN 'DEGRADED' ELSE 'SEVERE' END AS verdict FROM z JOIN base USING (symbol)""")
def _(s, d):
    return J.stress_report(stressed(s, d), stage(event_bars(s, d)), stress_sets())


# ------------------------------------------------------------------ strategies on resampled paths

PATH_SERIES = f"""(WITH {BOOT}, h AS (SELECT symbol, least(max(n), 64)::BIGINT AS h FROM bars GROUP BY symbol), w AS (SELECT symbol, path_id, step::BIGINT AS step, close FROM paths
     UNION ALL SELECT b.symbol, p.path_id, b.rn - b.n, b.close FROM bars b JOIN (SELECT DISTINCT symbol, path_id FROM paths) p USING (symbol) WHERE b.rn > b.n - 64)
   SELECT w.symbol || '#' || path_id AS symbol, step + h AS rn, make_timestamp((step + h) * 86400000000) AS ts, round(close, 8) AS close, count(*) OVER (PARTITION BY w.symbol, path_id) AS n FROM w JOIN h USING (symbol))"""
PATH_SETS = [("SMA_CROSS", dict(fast=5, slow=20)), ("SMA_CROSS", dict(fast=3, slow=8))]
PATHED = (preset_sql(f"b0 AS MATERIALIZED {PATH_SERIES}", PATH_SETS) + f""", pr AS MATERIALIZED (SELECT split_part(symbol, '#', 1) AS symbol, split_part(split_part(symbol, '#', 2), '|', 1)::INTEGER AS path_id, {part(2)} AS param_id, total_return_pct AS return_pct, max_drawdown_pct AS max_dd_pct, sharpe_ratio AS sharpe,
     coalesce(win_rate, 0.0) AS win_rate, coalesce(num_trades, 0) AS num_trades, final_equity, CASE WHEN num_trades IS NULL THEN 'no trades' END AS error FROM perf LEFT JOIN ts USING (symbol))""").replace(str(CAP), "10000.0")
DOMINANT = f"""dm AS MATERIALIZED (SELECT split_part(symbol, '#', 1) AS symbol, split_part(symbol, '#', 2)::INTEGER AS path_id, regime, share_pct FROM (SELECT *, round(100.0 * c / sum(c) OVER (PARTITION BY symbol), 2) AS share_pct, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, regime DESC) AS k
     FROM (SELECT symbol, regime, count(*) AS c FROM (WITH {regime_sql(f"bars AS MATERIALIZED {PATH_SERIES}")} SELECT * FROM labels) GROUP BY 1, 2)) WHERE k = 1)"""
R_COLS = ["symbol", "path_id", "param_id", "return_pct", "max_dd_pct", "sharpe", "win_rate", "num_trades", "final_equity", "error"]


def path_inputs(s, d):
    from .whatif_queries import boot
    return stage(event_bars(s, d)), stage(boot(s, d))


def path_strategy_runs(hist, paths):
    return stage(J.path_runs(hist, paths, [J.job(n, **o) for n, o in PATH_SETS]).select(*R_COLS))


@query("path_strategy_runs", f"WITH RECURSIVE {PATHED} SELECT {', '.join(R_COLS)} FROM pr")
def _(s, d):
    return path_strategy_runs(*path_inputs(s, d))


@query("path_regimes", f"WITH {DOMINANT} SELECT symbol, path_id, regime, share_pct FROM dm")
def _(s, d):
    return J.path_regimes(stage(J.path_bars(*path_inputs(s, d))))


@query("path_regime_report", f"""WITH RECURSIVE {PATHED}, {DOMINANT} SELECT symbol, param_id, count(*) AS paths, {', '.join(f"round(100.0 * count(*) FILTER (regime = '{g}') / count(*), 2) AS {g}_pct" for g in ("bull", "bear", "sideways"))}, round(100.0 * avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END), 2) AS survival_pct
   FROM pr JOIN dm USING (symbol, path_id) GROUP BY 1, 2""")
def _(s, d):
    hist, paths = path_inputs(s, d)
    return J.path_report(path_strategy_runs(hist, paths), J.path_regimes(stage(J.path_bars(hist, paths))))


# ------------------------------------------------------------------ leaderboards fed by real sweeps

BOARD_SETS = [("SMA_CROSS", dict(fast=3, slow=10)), ("SMA_CROSS", dict(fast=5, slow=20)), ("RSI", dict(oversold=45.0, overbought=55.0)), ("DONCHIAN", {})]
CLASS = "CASE WHEN symbol IN ('click', 'view') THEN 'browse' ELSE 'act' END"


def _board() -> str:
    v = {m: f"abs({m})" if m == "max_drawdown_pct" else m for m in W.BATCH_WEIGHTS}
    one = lambda u, i: (f"SELECT symbol, '{i}' AS interval, param_id, error, {', '.join([*W.BATCH_WEIGHTS, 'num_trades'])} FROM (WITH RECURSIVE {preset_sql(bars_cte(u, 'b0'), BOARD_SETS)} "  # noqa: E731
                        f"SELECT split_part(symbol, '|', 1) AS symbol, {part(2)} AS param_id, CASE WHEN num_trades IS NULL THEN 'no trades' END AS error, coalesce(num_trades, 0) AS num_trades, total_return_pct, max_drawdown_pct, {', '.join(f'least(greatest({c}, -20.0), 20.0) AS {c}' for c in ('sharpe_ratio', 'sortino_ratio', 'calmar_ratio'))} FROM perf LEFT JOIN ts USING (symbol))")
    rng = ", ".join(f"min({e}) AS lo_{m}, max({e}) AS hi_{m}" for m, e in v.items())
    t = " + ".join(f"{W.BATCH_WEIGHTS[m]} * {'(1 - ' if m == 'max_drawdown_pct' else '('}({e} - lo_{m}) / CASE WHEN hi_{m} - lo_{m} > 1e-10 THEN hi_{m} - lo_{m} ELSE 1 END)" for m, e in v.items())
    return f"""WITH pr AS MATERIALIZED ({one('hour', '1h')} UNION ALL {one('4h', '4h')}), rg AS (SELECT {rng} FROM pr WHERE error IS NULL),
   cs AS (SELECT {CLASS} AS class, pr.*, CASE WHEN error IS NULL THEN round({t}, 4) ELSE 0.0 END AS composite_score FROM pr, rg)
   SELECT class, symbol, interval, param_id, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY class, symbol, interval ORDER BY composite_score DESC, param_id) AS k FROM cs) WHERE k = 1"""


@query("best_per_class_interval", _board())
def _(s, d):
    """Best parameter set of every (class, symbol, interval), scored over the runs of all of them."""
    b = None
    for ivl in ("1h", "4h"):
        one = event_bars(s, d, ivl).withColumn("interval", F.lit(ivl))
        b = one if b is None else b.unionByName(one)
    b = stage(b)
    k = ["symbol", "interval"]
    m = stage(J.sweep_jobs(b, J.jobs_for(b.select(*k).distinct(), [J.job(n, **o) for n, o in BOARD_SETS]), k, CAP))
    m = W.composite_score(m, F.col("error").isNull()).withColumn("class", F.expr(CLASS))
    return W.best_per(m, ["class", *k], ties=["param_id"]).select("class", *k, "param_id", "composite_score")
