"""Scenarios, resampling, robustness, sweeps and rankings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.draws import normal, uniform
from ..operators import metrics as M
from ..operators import montecarlo as C
from ..operators import positions as P
from ..operators import regimes as R
from ..operators import scenarios as X
from ..operators import signals as G
from ..operators import sweep as W
from ..operators.blocks import BLOCK
from ..session import stage
from ..sources.bars import with_warmup
from ..sources.tables import event_bars, event_ticks, order_bars, raw_bars, table
from .oracle import latch_tail, roll
from .position_queries import EQUITY, TRADES, TS, VOLS, labels, signals
from .registry import OVER, bars_cte, daily_cte, fin, query, r, rx, u01
from .signal_queries import K, SMA_SIGNALS

# ------------------------------------------------------------------ draws

NORM = lambda seed, *i: f"(sqrt(-2 * ln(greatest({u01(seed + 'a', *i)}, 1e-300))) * cos(2 * pi() * {u01(seed + 'b', *i)}))"


@query("draws", f"SELECT event_id, {rx(u01('7', 'event_id', 'user_id'), 'u', 9)}, {rx(NORM('7', 'event_id'), 'z', 9)} FROM events")
def _(s, d):
    return fin(event_ticks(s, d).select("event_id", uniform(7, "event_id", "user_id").alias("u"), normal(7, "event_id").alias("z")), digits=9)


# ------------------------------------------------------------------ scenarios

def dim_values() -> str:
    base = {**dict.fromkeys(X.FIELDS, 0.0), "wick": 1.0, "slip_mult": 1.0, "spread_mult": 1.0, "direction": "down"}
    rows = []
    for n, g in X.PRESETS.items():
        v = {**base, **g}
        rows.append(f"('{n}', " + ", ".join(f"'{v[f]}'" if f == "direction" else f"{float(v[f])!r}::DOUBLE" for f in X.FIELDS) + ")")
    return f"dim(scenario, {', '.join(X.FIELDS)}) AS (VALUES {', '.join(rows)})"


SHAPE = "shape AS (SELECT symbol, sum(c)::BIGINT AS n, greatest(1.0, sum(c) / count(*)) AS bpd FROM (SELECT symbol, ts::DATE AS dd, count(*) AS c FROM bars GROUP BY 1, 2) GROUP BY symbol)"


def runs_cte(runs: int, sev: str = "1.0", key: tuple[str, ...] = ("symbol",), jitter: bool | None = None) -> str:
    ids = (*key, "scenario", "run_id")
    jit = f"{sev} * (0.75 + 0.5 * {u01('7sev', *ids)})" if (runs > 1 if jitter is None else jitter) else sev
    shape = SHAPE.replace("symbol", ", ".join(key)).replace("GROUP BY 1, 2", "GROUP BY ALL")
    return f"""{shape}, {dim_values()}, r0 AS (SELECT *, {jit} AS severity FROM shape, dim, (SELECT unnest(range(1, {runs + 1}))::INTEGER AS run_id)),
   r1 AS (SELECT *, floor(n * 0.05::DOUBLE)::BIGINT AS lo5, greatest(floor(n * 0.05::DOUBLE) + 1, floor(n * 0.60::DOUBLE))::BIGINT AS hi60, greatest(1, round_even(days * bpd, 0))::BIGINT AS dur FROM r0),
   r2 AS (SELECT *, lo5 + floor({u01('7start', *ids)} * (hi60 - lo5))::BIGINT AS start FROM r1),
   runs AS MATERIALIZED (SELECT *, least(start + dur, n) AS fin, CASE WHEN scenario IN ('luna_collapse', 'yes_bank_2020') THEN least(depth * severity, 99) ELSE depth * severity END AS shock, 1 + (wick - 1) * severity AS vm, greatest(1, round_even(up_days * bpd, 0))::BIGINT AS ud FROM r2)"""


@query("scenario_plan", f"WITH {bars_cte()}, {runs_cte(3)} SELECT symbol, scenario, run_id, {rx('severity', 'severity')}, CAST(start AS BIGINT) AS start, CAST(fin AS BIGINT) AS \"end\", {rx('shock', 'shock')} FROM runs")
def _(s, d):
    return fin(X.plan_runs(raw_bars(s, d), s, 3), "symbol", "scenario", "run_id", "severity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "shock")


@query("stressed_slippage", f"WITH {bars_cte()}, {runs_cte(3)} SELECT symbol, scenario, run_id, {rx('CASE WHEN slip_mult > 1 THEN 0.001 * slip_mult * severity ELSE 0.001 END', 'slippage', 9)} FROM runs")
def _(s, d):
    p = X.plan_runs(raw_bars(s, d), s, 3).select("symbol", "scenario", "run_id", "severity").join(F.broadcast(X.scenarios(s).select("scenario", "slip_mult")), "scenario")
    return fin(p.select("symbol", "scenario", "run_id", X.stressed_slippage(0.001, F.col("slip_mult"), F.col("severity")).alias("slippage")), digits=9)


def regime_runs(s, d):
    base = raw_bars(s, d).select("symbol").distinct().withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(40))))
    return base


# one regime per run, drawn by the share of bars
@query("regime_severity", f"""WITH {VOLS}, q AS (SELECT symbol, regime, round(vs, 4) AS vs, fraction, sum(fraction) OVER (PARTITION BY symbol ORDER BY regime) AS hi, sum(fraction) OVER (PARTITION BY symbol) AS top FROM sc),
   u AS (SELECT symbol, run_id::INTEGER AS run_id, {u01('7reg', 'symbol', 'run_id')} AS u FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(1, 41)) AS run_id))
   SELECT u.symbol, run_id, regime AS drawn_regime, {rx("1.0 * vs * (0.85 + 0.3 * " + u01('7sev', 'u.symbol', 'run_id') + ")", 'severity')} FROM u JOIN q ON q.symbol = u.symbol AND u * top >= hi - fraction AND u * top < hi""")
def _(s, d):
    sc = R.regime_vol_scales(labels(s, d), K)
    return fin(X.regime_severity(regime_runs(s, d), sc, 1.0, 7, ["symbol", "run_id"]), "symbol", "run_id", "drawn_regime", "severity")


def drift_sql(i: str) -> str:
    def seg(a, e, m, persist):
        e = f"least({e}, n)"
        return (f"(CASE WHEN {m} = 1 OR {e} <= {a} THEN 1.0 WHEN {i} >= {a} AND {i} < {e} THEN pow({m}, ({i} - {a} + 1)::DOUBLE / ({e} - {a})) "
                + (f"WHEN {i} >= {e} THEN {m} " if persist else "") + "ELSE 1.0 END)")
    dn, upm = "(1 - shock / 100)", "(1 + up * severity / 100)"
    bm, bd = "(1 + bounce_pct * severity / 100)", "greatest(1, dur // 8)"
    b = lambda k: f"(start + dur * {k} // 3)"
    pe = "least(start + ud, n)"
    return f"""CASE WHEN scenario = 'gfc_2008' THEN {seg('start', 'fin', dn, True)} * {seg(b(1), f'least({b(1)} + {bd}, fin)', bm, False)} * {seg(b(2), f'least({b(2)} + {bd}, fin)', bm, False)}
      WHEN scenario IN ('covid_crash', 'covid_nifty_mar2020') THEN {seg('start', 'fin', dn, True)} * {seg('fin', '(fin + ud)', upm, True)}
      WHEN scenario IN ('luna_collapse', 'slow_bleed', 'yes_bank_2020') THEN {seg('start', 'fin', dn, True)}
      WHEN scenario IN ('pump_dump', 'trend_reversal') THEN {seg('start', pe, upm, False)} * {seg(pe, f'({pe} + dur)', dn, True)}
      WHEN scenario = 'demonetization_2016' THEN {seg('start', 'fin', dn, False)} * {seg('fin', '(fin + ud)', upm, False)} ELSE 1.0 END"""


# scenarios without random positions or noise can be stated in full in SQL
PLAIN = ("gfc_2008", "covid_crash", "luna_collapse", "pump_dump", "slow_bleed", "trend_reversal")
PL = ", ".join(f"'{x}'" for x in PLAIN)


@query("scenario_drift", f"""WITH {bars_cte()}, {runs_cte(2)}, f AS (SELECT b.symbol, scenario, run_id, b.ts, b.rn, open, high, low, close, {drift_sql('(rn - 1)')} AS f,
     CASE WHEN scenario = 'trend_reversal' THEN least(least(start + ud, n) + dur, n) ELSE fin END AS we, CASE WHEN scenario IN ('pump_dump', 'slow_bleed') THEN 1.0 ELSE vm END AS wm, start FROM (SELECT symbol, ts, rn, open, high, low, close FROM bars) b JOIN runs USING (symbol) WHERE scenario IN ({PL})),
   g AS (SELECT symbol, scenario, run_id, ts, open * f AS o, high * f AS h, low * f AS l, close * f AS c, rn - 1 >= start AND rn - 1 < we AND wm > 1 AS w, wm FROM f),
   k AS (SELECT symbol, scenario, run_id, ts, greatest(o, 1e-6) AS o, greatest(CASE WHEN w THEN c + greatest(0, h - c) * wm ELSE h END, 1e-6) AS h, greatest(CASE WHEN w THEN c - greatest(0, c - l) * wm ELSE l END, 1e-6) AS l, greatest(c, 1e-6) AS c FROM g)
   SELECT symbol, scenario, run_id, ts, {rx('o', 'open')}, {rx('greatest(o, h, c)', 'high')}, {rx('least(o, l, c)', 'low')}, {rx('c', 'close')} FROM k""")
def _(s, d):
    b = event_bars(s, d)
    return fin(X.apply_scenario(b, X.plan_runs(b, s, 2, names=PLAIN)), "symbol", "scenario", "run_id", "ts", "open", "high", "low", "close")


@query("scenario_noise", f"""WITH {bars_cte()}, {runs_cte(2)}, f AS (SELECT b.symbol, scenario, run_id, b.ts, close, rn - 1 >= start AND rn - 1 < fin AS inside,
     exp(CASE WHEN rn - 1 >= start AND rn - 1 < fin THEN {NORM('7chop', 'symbol', 'scenario', 'run_id', 'rn')} * CASE scenario WHEN 'vol_spike' THEN (vm - 1) * 1.5 * severity ELSE (greatest(1.0, spread_mult * severity) - 1) * 0.4 * severity END / 100 ELSE 0 END) AS m FROM bars b JOIN runs USING (symbol) WHERE scenario IN ('vol_spike', 'liquidity_drought'))
   SELECT symbol, scenario, run_id, ts, {rx('greatest(close * m, 1e-6)', 'close')} FROM f""")
def _(s, d):
    b = event_bars(s, d)
    return fin(X.apply_scenario(b, X.plan_runs(b, s, 2, names=["vol_spike", "liquidity_drought"])), "symbol", "scenario", "run_id", "ts", "close")


@query("scenario_mean_reverting", f"""WITH RECURSIVE {bars_cte()}, {runs_cte(2)}, z AS MATERIALIZED (SELECT b.symbol, scenario, run_id, rn, shock, start, {NORM('7chop', 'symbol', 'scenario', 'run_id', 'rn')} * shock / 100 AS z FROM (SELECT symbol, rn FROM bars) b JOIN runs USING (symbol)
     WHERE scenario IN ('whipsaw_chop', 'range_bound') AND rn - 1 >= start AND rn - 1 < fin),
   a(symbol, scenario, run_id, rn, r) AS (SELECT symbol, scenario, run_id, rn, z FROM z WHERE rn - 1 = start UNION ALL SELECT z.symbol, z.scenario, z.run_id, z.rn, z.z - 0.5 * a.r FROM a JOIN z ON z.symbol = a.symbol AND z.scenario = a.scenario AND z.run_id = a.run_id AND z.rn = a.rn + 1),
   sd AS (SELECT symbol, scenario, run_id, stddev_pop(r) AS sd FROM a GROUP BY 1, 2, 3),
   f AS (SELECT a.symbol, a.scenario, a.run_id, a.rn, exp(CASE WHEN sd > 1e-12 THEN r * (shock / 100) / sd ELSE r END) AS m FROM a JOIN sd USING (symbol, scenario, run_id) JOIN z USING (symbol, scenario, run_id, rn))
   SELECT b.symbol, q.scenario, q.run_id, b.ts, {rx('greatest(b.close * coalesce(m, 1.0), 1e-6)', 'close')} FROM bars b JOIN runs q ON q.symbol = b.symbol AND q.scenario IN ('whipsaw_chop', 'range_bound') LEFT JOIN f ON f.symbol = b.symbol AND f.scenario = q.scenario AND f.run_id = q.run_id AND f.rn = b.rn""")
def _(s, d):
    b = event_bars(s, d)
    return fin(X.apply_scenario(b, X.plan_runs(b, s, 2, names=["whipsaw_chop", "range_bound"])), "symbol", "scenario", "run_id", "ts", "close")


IDS = ("symbol", "scenario", "run_id")


def positions_sql(name: str, seed: str, count: str, size: str) -> str:
    """CTEs with the list ``<name>.places`` of distinct positions, drawn one after the other."""
    step = f"floor({u01(seed + 'd', *IDS, 'j + 1')} * (size - j))::BIGINT"
    return f"""{name}_n AS (SELECT symbol, scenario, run_id, CASE WHEN {count} > 0 THEN greatest(1, round_even({count} * severity, 0)) ELSE 0 END::BIGINT AS k, ({size})::BIGINT AS size FROM runs),
   {name}_r(symbol, scenario, run_id, k, size, j, taken) AS (SELECT *, 0::BIGINT, []::BIGINT[] FROM {name}_n UNION ALL
     SELECT symbol, scenario, run_id, k, size, j + 1, list_append(taken, list_reduce(list_prepend({step}, list_sort(taken)), lambda p, t: CASE WHEN t <= p THEN p + 1 ELSE p END)) FROM {name}_r WHERE j < least(k, size)),
   {name} AS MATERIALIZED (SELECT symbol, scenario, run_id, arg_max(taken, j) AS places FROM {name}_r GROUP BY 1, 2, 3)"""


def scenario_sql(noise: str) -> str:
    """CTEs (recursive) up to ``shocked``: bars of every scenario, ``noise(symbol, scenario, run_id, rn, m)`` being the mean-reverting factors."""
    draw = lambda seed: u01(seed, *IDS, "rn")
    sign = lambda way, u: f"CASE WHEN {way} = 'down' OR ({way} = 'both' AND {u} < 0.5) THEN -1.0 ELSE 1.0 END"
    spread = "greatest(1.0, spread_mult * severity)"
    wick = lambda on: (f"CASE WHEN inside AND wm > 1 AND {on} THEN c + greatest(0, h - c) * wm ELSE h END AS h, CASE WHEN inside AND wm > 1 AND {on} THEN c - greatest(0, c - l) * wm ELSE l END AS l")
    return f"""{positions_sql('gap', '7gap', 'gaps', "greatest(1, CASE WHEN scenario IN ('gap_risk', 'expiry_gamma_squeeze') THEN n - 1 ELSE fin - start END)")}, {positions_sql('hit', '7out', 'outliers', 'n')}, {noise},
   f0 AS (SELECT b.symbol, q.scenario, q.run_id, b.ts, b.rn, b.open, b.high, b.low, b.close, b.pc, q.* EXCLUDE (symbol, scenario, run_id), gap.places AS gap_at, hit.places AS out_at, {drift_sql('(b.rn - 1)')} AS f, {drift_sql('(b.rn - 2)')} AS fp
     FROM (SELECT symbol, ts, rn, open, high, low, close, lag(close) OVER ({OVER}) AS pc FROM bars) b JOIN runs q USING (symbol) JOIN gap USING (symbol, scenario, run_id) JOIN hit USING (symbol, scenario, run_id)),
   f1 AS (SELECT *, open * f AS o, high * f AS h, low * f AS l, close * f AS c, pc * fp AS prev, scenario IN ('covid_nifty_mar2020', 'yes_bank_2020') AS gap_first,
     rn - 1 >= CASE WHEN scenario = 'expiry_gamma_squeeze' THEN 0 ELSE start END AND rn - 1 < CASE WHEN scenario = 'flash_crash_2010' THEN least(start + 3, n) WHEN scenario = 'trend_reversal' THEN least(least(start + ud, n) + dur, n) WHEN scenario = 'expiry_gamma_squeeze' THEN n ELSE fin END AS inside,
     CASE WHEN scenario = 'liquidity_drought' THEN {spread} WHEN scenario IN ('pump_dump', 'slow_bleed', 'gap_risk', 'outlier_injection') THEN 1.0 ELSE vm END AS wm FROM f0),
   f2 AS (SELECT * REPLACE ({wick('NOT gap_first')}) FROM f1),
   f3 AS (SELECT *, CASE WHEN rn > 1 AND list_contains(gap_at, rn - 1 - CASE WHEN scenario IN ('gap_risk', 'expiry_gamma_squeeze') THEN 0 ELSE start END) THEN
     greatest(1e-6, prev * (1 + {sign("CASE WHEN scenario IN ('gap_risk', 'expiry_gamma_squeeze') THEN 'both' ELSE 'down' END", draw('7gs'))} * (gap_lo + {draw('7gp')} * (gap_hi - gap_lo)) / 100)) END AS jump FROM f2),
   f4 AS (SELECT * REPLACE (coalesce(jump, o) AS o, CASE WHEN jump IS NULL THEN h ELSE greatest(jump, h * jump / o) END AS h, CASE WHEN jump IS NULL THEN l ELSE least(jump, l * jump / o) END AS l) FROM f3),
   f5 AS (SELECT * REPLACE ({wick('gap_first')}) FROM f4),
   f6 AS (SELECT f5.*, coalesce(noise.m, 1.0)
     * CASE WHEN scenario IN ('liquidity_drought', 'vol_spike') AND rn - 1 >= start AND rn - 1 < fin OR scenario = 'gap_risk' THEN exp({NORM('7chop', *IDS, 'rn')} * CASE scenario WHEN 'gap_risk' THEN (gap_lo + gap_hi) / 2 * 0.25 * severity WHEN 'vol_spike' THEN (vm - 1) * 1.5 * severity ELSE ({spread} - 1) * 0.4 * severity END / 100) ELSE 1.0 END
     * CASE WHEN list_contains(out_at, rn - 1) THEN greatest(0.001, 1 + {sign('direction', draw('7os'))} * (out_lo + {draw('7op')} * (out_hi - out_lo)) / 100) ELSE 1.0 END
     * CASE WHEN scenario = 'flash_crash_2010' AND rn - 1 = start THEN greatest(0.001, 1 - shock / 100) ELSE 1.0 END AS mm FROM f5 LEFT JOIN noise USING (symbol, scenario, run_id, rn)),
   f7 AS (SELECT symbol, scenario, run_id, ts, rn, greatest(o * mm, 1e-6) AS o, greatest(h * mm, 1e-6) AS h, greatest(l * mm, 1e-6) AS l, greatest(c * mm, 1e-6) AS c FROM f6),
   shocked AS (SELECT symbol, scenario, run_id, ts, rn, o AS open, greatest(o, h, c) AS high, least(o, l, c) AS low, c AS close FROM f7)"""


REVERTING = f"""z AS MATERIALIZED (SELECT b.symbol, scenario, run_id, rn, shock, start, {NORM('7chop', *IDS, 'rn')} * shock / 100 AS z FROM (SELECT symbol, rn FROM bars) b JOIN runs USING (symbol) WHERE scenario IN ('whipsaw_chop', 'range_bound') AND rn - 1 >= start AND rn - 1 < fin),
   a(symbol, scenario, run_id, rn, r) AS (SELECT symbol, scenario, run_id, rn, z FROM z WHERE rn - 1 = start UNION ALL SELECT z.symbol, z.scenario, z.run_id, z.rn, z.z - 0.5 * a.r FROM a JOIN z ON z.symbol = a.symbol AND z.scenario = a.scenario AND z.run_id = a.run_id AND z.rn = a.rn + 1),
   sd AS (SELECT symbol, scenario, run_id, stddev_pop(r) AS sd FROM a GROUP BY 1, 2, 3),
   noise AS MATERIALIZED (SELECT symbol, scenario, run_id, rn, exp(CASE WHEN sd > 1e-12 THEN r * (shock / 100) / sd ELSE r END) AS m FROM a JOIN sd USING (symbol, scenario, run_id) JOIN z USING (symbol, scenario, run_id, rn))"""
SHOCKED = f"WITH RECURSIVE {bars_cte()}, {runs_cte(2)}, {scenario_sql(REVERTING)}"
DRAWN = ["gap_risk", "outlier_injection", "flash_crash_2010", "expiry_gamma_squeeze", "demonetization_2016", "yes_bank_2020", "covid_nifty_mar2020"]


@query("scenario_gaps_outliers", f"{SHOCKED} SELECT symbol, scenario, run_id, rn, ts, {r('open', 'high', 'low', 'close')} FROM shocked WHERE scenario IN ({', '.join(repr(n) for n in DRAWN)})")
def _(s, d):
    b = event_bars(s, d)
    return fin(X.apply_scenario(b, X.plan_runs(b, s, 2, names=DRAWN)), "symbol", "scenario", "run_id", "rn", "ts", "open", "high", "low", "close")


@query("scenario_envelope", f"{SHOCKED} SELECT scenario, count(*) AS rows, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR low < 1e-6) AS broken, {', '.join(rx(e, n, 4) for e, n in (('avg(open)', 'mean_open'), ('avg(close)', 'mean_close'), ('avg(high - low)', 'mean_range'), ('max(high)', 'top'), ('min(low)', 'bottom')))} FROM shocked GROUP BY scenario")
def _(s, d):
    """All 17 scenarios keep every bar and a valid high/low envelope."""
    b = event_bars(s, d)
    x = X.apply_scenario(b, X.plan_runs(b, s, 2))
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") < 1e-6)
    return fin(x.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("broken"), F.avg("open").alias("mean_open"), F.avg("close").alias("mean_close"),
                                         F.avg(F.col("high") - F.col("low")).alias("mean_range"), F.max("high").alias("top"), F.min("low").alias("bottom")), digits=4)


@query("repair_ohlc", "SELECT event_id, greatest(value - 20, 1e-6) AS open, greatest(greatest(value - 20, 1e-6), greatest(value - 25, 1e-6), greatest(value - 22, 1e-6)) AS high, "
       "least(greatest(value - 20, 1e-6), greatest(value + 5, 1e-6), greatest(value - 22, 1e-6)) AS low, greatest(value - 22, 1e-6) AS close FROM events")
def _(s, d):
    v = F.col("value")
    return X.repair_ohlc(event_ticks(s, d).select("event_id", (v - 20).alias("open"), (v - 25).alias("high"), (v + 5).alias("low"), (v - 22).alias("close")))


# ------------------------------------------------------------------ resampling

def boot_cte(n_paths: int, horizon: int) -> str:
    return f"""{bars_cte()}, rat AS MATERIALIZED (SELECT symbol, rn - 2 AS idx, close / lag(close) OVER ({OVER}) AS rr, high / close AS rh, low / close AS rl, open / lag(close) OVER ({OVER}) AS ro, volume AS v, rn FROM bars),
   base AS (SELECT symbol, max(rn) - 1 AS m, last(close ORDER BY rn) AS last FROM bars GROUP BY symbol),
   ids AS (SELECT symbol, m, last, path_id::INTEGER AS path_id, b, k, floor({u01('7bb', 'symbol', 'path_id', 'b')} * m)::BIGINT AS st FROM base, (SELECT unnest(range(1, {n_paths + 1})) AS path_id), (SELECT unnest(range(0, {-(-horizon // 20)})) AS b), (SELECT unnest(range(0, 20)) AS k)),
   j AS (SELECT i.symbol, path_id, last, (b * 20 + k + 1)::INTEGER AS step, rr, rh, rl, ro, v FROM ids i JOIN rat r ON r.symbol = i.symbol AND r.idx = (st + k) % m AND r.rn > 1 WHERE b * 20 + k + 1 <= {horizon}),
   c AS (SELECT *, greatest(last * exp(sum(ln(rr)) OVER (PARTITION BY symbol, path_id ORDER BY step)), 1e-10) AS close FROM j),
   o AS (SELECT *, greatest(coalesce(lag(close) OVER (PARTITION BY symbol, path_id ORDER BY step), last) * ro, 1e-10) AS open FROM c),
   paths AS MATERIALIZED (SELECT symbol, path_id, step, open, greatest(close * rh, open, close) AS high, greatest(least(close * rl, open, close), 1e-10) AS low, close, v AS volume FROM o)"""


BOOT = boot_cte(20, 50)


def boot(s, d, paths=20, horizon=50):
    return X.block_bootstrap(event_bars(s, d), paths, horizon)


@query("block_bootstrap", f"WITH {BOOT} SELECT symbol, path_id, step, {r('open', 'high', 'low', 'close', 'volume', digits=4)} FROM paths")
def _(s, d):
    return fin(boot(s, d), digits=4)


@query("with_warmup", f"WITH {BOOT} SELECT symbol, path_id, CAST(step AS BIGINT) AS step, {r('close', digits=4)} FROM paths UNION ALL SELECT b.symbol, p.path_id, b.rn - b.n, round(b.close, 4) + 0.0 FROM bars b, (SELECT DISTINCT symbol, path_id FROM paths) p WHERE p.symbol = b.symbol AND b.rn > b.n - 64")
def _(s, d):
    return fin(with_warmup(event_bars(s, d), boot(s, d).withColumn("step", F.col("step").cast("long"))), "symbol", "path_id", "step", "close", digits=4)


PATHRUNS = BOOT + f""", pr0 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, path_id ORDER BY step) - 1 AS rt, close / max(close) OVER (PARTITION BY symbol, path_id ORDER BY step) - 1 AS dw FROM paths),
   pruns AS MATERIALIZED (SELECT symbol, path_id, round(last(close ORDER BY step) / first(open ORDER BY step) * 100 - 100, 4) AS return_pct, round(min(dw) * 100, 4) AS max_dd_pct, round(avg(rt) / stddev_pop(rt) * sqrt(252), 4) AS sharpe FROM pr0 GROUP BY 1, 2)"""


@query("path_performance", f"WITH {PATHRUNS} SELECT symbol, path_id, {r('return_pct', 'max_dd_pct', 'sharpe')} FROM pruns")
def _(s, d):
    return fin(C.path_performance(boot(s, d), K), "symbol", "path_id", "return_pct", "max_dd_pct", "sharpe")


SUMMARY = "count(*) AS n_paths, round(quantile_cont(return_pct, 0.05), 2) AS return_p5, round(quantile_cont(return_pct, 0.5), 2) AS return_p50, round(quantile_cont(return_pct, 0.95), 2) AS return_p95, round(avg(return_pct), 2) AS mean_return, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) * 100, 1) AS prob_profit_pct, round(avg(sharpe), 3) AS mean_sharpe, round(avg(max_dd_pct), 2) AS mean_max_dd"


@query("path_summary", f"WITH {PATHRUNS} SELECT symbol, {SUMMARY} FROM pruns GROUP BY symbol")
def _(s, d):
    return C.path_summary(C.path_performance(boot(s, d), K), K)


@query("sample_paths", f"""WITH {BOOT}, pi AS (SELECT DISTINCT round_even(i * 19.0 / 4, 0)::INTEGER + 1 AS path_id FROM (SELECT unnest(range(0, 5)) AS i)), si AS (SELECT DISTINCT round_even(i * 49.0 / 9, 0)::INTEGER + 1 AS step FROM (SELECT unnest(range(0, 10)) AS i))
   SELECT p.symbol, p.path_id, p.step, round((p.close / f.close - 1) * 100, 3) AS pct FROM paths p JOIN pi USING (path_id) JOIN si USING (step) JOIN paths f ON f.symbol = p.symbol AND f.path_id = p.path_id AND f.step = 1""")
def _(s, d):
    return C.sample_paths(boot(s, d), K, 5, 10)


@query("equity_fan", f"WITH {BOOT} SELECT symbol, CAST(step AS BIGINT) AS rn, count(*) AS runs, round(quantile_cont(close, 0.05), 4) AS p5, round(quantile_cont(close, 0.5), 4) AS p50, round(quantile_cont(close, 0.95), 4) AS p95 FROM paths GROUP BY symbol, step")
def _(s, d):
    e = boot(s, d).select("symbol", F.col("path_id").alias("run_id"), F.col("step").cast("long").alias("rn"), F.col("close").alias("equity"))
    return C.equity_fan(stage(e), K)


@query("path_delta", f"WITH {BOOT} SELECT p.symbol, p.path_id, CAST(p.step AS BIGINT) AS rn, round((p.close - q.close) / q.close * 100, 4) AS delta_pct FROM paths p JOIN paths q ON q.symbol = p.symbol AND q.path_id = 1 AND q.step = p.step")
def _(s, d):
    e = stage(boot(s, d).select("symbol", "path_id", F.col("step").cast("long").alias("rn"), F.col("close").alias("equity")))
    return C.path_delta(e, e.filter("path_id = 1"), K).select("symbol", "path_id", "rn", "delta_pct")


@query("regime_distribution", f"""WITH {PATHRUNS}, q AS (SELECT *, CASE WHEN return_pct > 10 THEN 'bull' WHEN return_pct < -10 THEN 'bear' ELSE 'sideways' END AS regime FROM pruns)
   SELECT symbol, count(*) AS paths, {', '.join(f"round(100.0 * count(*) FILTER (regime = '{g}') / count(*), 2) AS {g}_pct" for g in R.REGIMES)}, round(100.0 * count(*) FILTER (return_pct > 0) / count(*), 2) AS survival_pct FROM q GROUP BY symbol""")
def _(s, d):
    p = C.path_performance(boot(s, d), K).withColumn("regime", F.when(F.col("return_pct") > 10, "bull").when(F.col("return_pct") < -10, "bear").otherwise("sideways"))
    return R.regime_distribution(p, K)


CRISES = ["gfc_2008", "covid_crash", "luna_collapse"]


@query("crisis_overlay", f"""WITH {re.sub(r'\bbars\b', 'hist', boot_cte(10, 60))}, bars AS MATERIALIZED (SELECT symbol, path_id, TIMESTAMP '1970-01-01' + to_days(step) AS ts, step::BIGINT AS rn, 60::BIGINT AS n, open, high, low, close FROM paths), {runs_cte(1, key=('symbol', 'path_id'), jitter=True)},
   x AS (SELECT symbol, path_id, scenario, rn, greatest(open * f, 1e-6) AS open, greatest(close * f, 1e-6) AS close FROM (SELECT b.*, scenario, {drift_sql('(rn - 1)')} AS f FROM (SELECT symbol, path_id, rn, open, close FROM bars) b JOIN runs USING (symbol, path_id) WHERE scenario IN ({', '.join(repr(n) for n in CRISES)})) b),
   y AS (SELECT *, close / lag(close) OVER w - 1 AS rt, close / max(close) OVER w - 1 AS dw FROM x WINDOW w AS (PARTITION BY symbol, path_id, scenario ORDER BY rn)),
   pruns AS (SELECT symbol, path_id, scenario, round(last(close ORDER BY rn) / first(open ORDER BY rn) * 100 - 100, 4) AS return_pct, round(min(dw) * 100, 4) AS max_dd_pct, round(avg(rt) / stddev_pop(rt) * sqrt(252), 4) AS sharpe FROM y GROUP BY symbol, path_id, scenario)
   SELECT symbol, scenario, {SUMMARY} FROM pruns GROUP BY symbol, scenario""")
def _(s, d):
    k = ["symbol", "scenario"]
    return C.path_summary(C.path_performance(X.crisis_overlay(boot(s, d, 10, 60), s, CRISES), k), k)


# ------------------------------------------------------------------ trade resampling

RES = TRADES + f""", nn AS (SELECT symbol, count(*) AS n, greatest(1, round_even(count(*) * 0.9::DOUBLE, 0))::BIGINT AS keep, greatest(1.0, count(*) / greatest((epoch_us(max(exit_time)) - epoch_us(min(entry_time))) / 86400e6, 1.0) * 365.0) AS py FROM trades GROUP BY symbol HAVING count(*) >= 3),
   x AS (SELECT t.symbol, run_id::INTEGER AS run_id, trade_no, pnl, keep, py, {u01('7drop', 't.symbol', 'run_id', 'trade_no')} AS u, {u01('7mix', 't.symbol', 'run_id', 'trade_no')} AS v FROM trades t JOIN nn USING (symbol), (SELECT unnest(range(1, 31)) AS run_id)),
   y AS (SELECT *, row_number() OVER (PARTITION BY symbol, run_id ORDER BY u, trade_no) AS pick FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY symbol, run_id ORDER BY v, trade_no) AS rn FROM y WHERE pick <= keep),
   e(symbol, run_id, rn, eq, pk, dd) AS (SELECT DISTINCT symbol, run_id, 0::BIGINT, 10000.0::DOUBLE, 10000.0::DOUBLE, 0.0::DOUBLE FROM z UNION ALL
      SELECT z.symbol, z.run_id, z.rn, greatest(0, e.eq + z.pnl), greatest(e.pk, e.eq + z.pnl), least(e.dd, (greatest(0, e.eq + z.pnl) - greatest(e.pk, e.eq + z.pnl)) / greatest(e.pk, e.eq + z.pnl)) FROM e JOIN z ON z.symbol = e.symbol AND z.run_id = e.run_id AND z.rn = e.rn + 1),
   a AS (SELECT symbol, run_id, avg(pnl / 10000) / stddev_pop(pnl / 10000) * sqrt(any_value(py)) AS sh, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS w, count(*) AS num_trades FROM z GROUP BY 1, 2),
   mc AS MATERIALIZED (SELECT a.symbol, a.run_id, round((last(eq ORDER BY rn) - 10000) / 10000 * 100, 4) AS return_pct, round(min(dd) * 100, 4) AS max_dd_pct, round(any_value(w) * 100, 4) AS win_rate, round(any_value(sh), 4) AS sharpe, round(last(eq ORDER BY rn), 2) AS final_equity, any_value(num_trades) AS num_trades FROM a JOIN e ON e.symbol = a.symbol AND e.run_id = a.run_id GROUP BY 1, 2)"""
MC = ["return_pct", "max_dd_pct", "win_rate", "sharpe", "final_equity", "num_trades"]


def mc(s, d):
    return stage(C.resample_trades(stage(P.round_trips(signals(s, d), K)), K, 30))


@query("resample_trades", f"WITH RECURSIVE {RES} SELECT symbol, run_id, {', '.join(MC)} FROM mc")
def _(s, d):
    return C.resample_trades(stage(P.round_trips(signals(s, d), K)), K, 30)


@query("resample_report", f"""WITH RECURSIVE {RES}, k AS (SELECT symbol, count(*) AS trades FROM trades GROUP BY 1), m AS (SELECT symbol, count(*) AS runs FROM mc GROUP BY 1)
   SELECT symbol, coalesce(trades, 0) AS trades, coalesce(runs, 0) AS runs, CASE WHEN trades IS NULL THEN 'no trades' WHEN trades < 3 THEN 'fewer than 3 trades' END AS note FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN k USING (symbol) LEFT JOIN m USING (symbol)""")
def _(s, d):
    t = stage(P.round_trips(signals(s, d), K))
    return C.resample_report(raw_bars(s, d), t, C.resample_trades(t, K, 30), K)


@query("compare_methods", f"""WITH RECURSIVE {RES}, {PATHRUNS[len(bars_cte()) + 2:]}, q AS (SELECT 'bootstrap' AS method, symbol, path_id, return_pct, max_dd_pct, sharpe FROM pruns UNION ALL SELECT 'trades' AS method, symbol, run_id, return_pct, max_dd_pct, sharpe FROM mc)
   SELECT symbol, method, {SUMMARY} FROM q GROUP BY symbol, method""")
def _(s, d):
    cols = ["symbol", "path_id", "return_pct", "max_dd_pct", "sharpe"]
    return C.compare_methods({"bootstrap": stage(C.path_performance(boot(s, d), K).select(*cols)), "trades": mc(s, d).withColumnRenamed("run_id", "path_id").select(*cols)}, K)


# The reports below work on run rows derived from the order lines, many runs per account.
RUNS = """runs AS MATERIALIZED (SELECT 'S' || (l_suppkey % 7) AS symbol, l_orderkey AS run_id, round(avg(l_discount) * 2000 - 90 + 0.0001 * (l_orderkey % 97), 4) AS return_pct, round(-max(l_quantity) * 1.37, 4) AS max_dd_pct, round(avg(l_tax) * 61 - 2, 3) AS sharpe,
   round(100.0 * avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 3) AS win_rate, round(10000 + 100 * (avg(l_discount) * 2000 - 90), 2) AS final_equity, count(*) AS num_trades FROM lineitem GROUP BY 1, 2)"""


def run_rows(s, d):
    li = table(s, d, "lineitem")
    g = li.groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("symbol"), F.col("l_orderkey").alias("run_id"))
    a = g.agg(F.avg("l_discount").alias("_d"), F.max("l_quantity").alias("_q"), F.avg("l_tax").alias("_t"), F.avg(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_w"), F.count(F.lit(1)).alias("num_trades"))
    return a.select("symbol", "run_id", F.round(F.col("_d") * 2000 - 90 + 0.0001 * (F.col("run_id") % 97), 4).alias("return_pct"), F.round(-F.col("_q") * 1.37, 4).alias("max_dd_pct"), F.round(F.col("_t") * 61 - 2, 3).alias("sharpe"),
                    F.round(100.0 * F.col("_w"), 3).alias("win_rate"), F.round(10000 + 100 * (F.col("_d") * 2000 - 90), 2).alias("final_equity"), "num_trades")


PM = ["return_pct", "max_dd_pct", "sharpe", "win_rate"]


@query("run_percentiles", f"WITH {RUNS} " + " UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, count(*) AS runs, round(quantile_cont({m}, 0.05), 4) AS p5, round(quantile_cont({m}, 0.5), 4) AS p50, round(quantile_cont({m}, 0.95), 4) AS p95, min({m}) AS worst, max({m}) AS best FROM runs GROUP BY symbol" for m in PM))
def _(s, d):
    return C.run_percentiles(run_rows(s, d), K, PM)


CV = "cv AS (SELECT r.symbol, avg(return_pct) FILTER (return_pct <= q) AS c, avg(CASE WHEN final_equity < 5000 THEN 1.0 ELSE 0 END) AS ruin FROM runs r JOIN (SELECT symbol, quantile_cont(return_pct, 0.05) AS q FROM runs GROUP BY symbol) USING (symbol) GROUP BY r.symbol)"


@query("cvar_ruin", f"WITH {RUNS}, {CV} SELECT symbol, round(c, 4) AS cvar_5, round(ruin, 4) AS prob_ruin FROM cv")
def _(s, d):
    return C.cvar_ruin(run_rows(s, d), K)


@query("representative_run", f"WITH {RUNS}, m AS (SELECT symbol, median(return_pct) AS p50 FROM runs GROUP BY symbol) SELECT r.symbol, first(run_id ORDER BY round(abs(return_pct - p50), 9), run_id) AS run_id, any_value(p50) AS p50 FROM runs r JOIN m USING (symbol) GROUP BY r.symbol")
def _(s, d):
    return C.representative_run(run_rows(s, d), K)


def robust_sql(wfe: bool) -> str:
    w = "1.0 * (ascii(substr(symbol, 2)) - 45) / 10" if wfe else "NULL::DOUBLE"
    full = "(0.30 * sv + 0.25 * sb + 0.20 * tl + 0.25 * least(greatest(w * 100, 0), 100))" if wfe else "(0.30 * sv + 0.25 * sb + 0.20 * tl) / 0.75"
    return f"""WITH {RUNS}, {CV}, a AS (SELECT symbol, count(*) AS runs, quantile_cont(return_pct, 0.05) AS p5, quantile_cont(return_pct, 0.5) AS p50, quantile_cont(return_pct, 0.95) AS p95, avg(CASE WHEN return_pct > -20 THEN 1.0 ELSE 0 END) AS al, {w} AS w FROM runs GROUP BY symbol),
     b AS (SELECT a.*, 60 * al + 0.4 * least(greatest((p50 + 100) / 150 * 100, 0), 100) AS sv, 0.5 * CASE WHEN p5 > 0 THEN 100 ELSE greatest(0, (p5 + 50) / 50 * 50) END + 0.5 * greatest(0, 100 - abs(p95 - p5)) AS sb, 0.5 * least(greatest(round(c, 4) + 100, 0), 100) + 0.5 * greatest(0, (1 - round(ruin, 4)) * 100) AS tl FROM a JOIN cv USING (symbol)),
     e AS (SELECT *, round(least(greatest({full}, 0), 100), 1) AS score FROM b)
     SELECT symbol, runs, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade, w IS NULL AS provisional, round(sv, 1) AS survival, round(sb, 1) AS stability, round(tl, 1) AS tail_safety FROM e"""


RB = ["symbol", "runs", "score", "grade", "provisional", "survival", "stability", "tail_safety"]


@query("robustness", robust_sql(False))
def _(s, d):
    return C.robustness(run_rows(s, d), K).select(*RB)


@query("robustness_wfe", robust_sql(True))
def _(s, d):
    rr = run_rows(s, d)
    w = rr.select("symbol").distinct().withColumn("wfe", (F.ascii(F.substring("symbol", 2, 1)) - 45) / 10.0)
    return C.robustness(rr, K, wfe=w).select(*RB)


@query("scenario_verdict", f"""WITH {RUNS}, q AS (SELECT symbol, CASE run_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS scenario, return_pct - 12 * (run_id % 3) AS rp, return_pct FROM runs), b AS (SELECT symbol, avg(return_pct) AS bp FROM q GROUP BY symbol),
   z AS (SELECT symbol, scenario, count(*) AS runs, median(rp) AS m, min(rp) AS w FROM q GROUP BY 1, 2)
   SELECT symbol, scenario, runs, round(bp, 2) AS baseline_pct, round(m, 2) AS median_pct, round(w, 2) AS worst_pct, round(m - bp, 2) AS delta_pct, CASE WHEN m - bp > -5 THEN 'SURVIVED' WHEN m - bp > -20 THEN 'DEGRADED' ELSE 'SEVERE' END AS verdict FROM z JOIN b USING (symbol)""")
def _(s, d):
    rr = run_rows(s, d)
    base = rr.groupBy("symbol").agg(F.avg("return_pct").alias("return_pct"))
    q = rr.select("symbol", F.expr("CASE run_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END").alias("scenario"), (F.col("return_pct") - 12 * (F.col("run_id") % 3)).alias("return_pct"))
    return C.scenario_verdict(q, base, K)


@query("run_log", f"WITH {RUNS} SELECT symbol, run_id, return_pct FROM runs WHERE return_pct > 0 ORDER BY return_pct DESC, run_id")
def _(s, d):
    return C.run_log(run_rows(s, d), "profitable").select("symbol", "run_id", "return_pct")


@query("run_log_totals", f"WITH {RUNS} SELECT symbol, count(*) AS runs, count(*) FILTER (return_pct > 0) AS profitable, round(sum(return_pct), 4) AS total_return, CAST(sum(num_trades) AS BIGINT) AS total_trades FROM runs GROUP BY symbol")
def _(s, d):
    return C.run_log_totals(run_rows(s, d), K)


# ------------------------------------------------------------------ sweeps

def sweep_sql() -> str:
    """Every symbol x parameter set as one series, then the single-strategy SQL."""
    grid = [(1, 3, 10), (2, 3, 20), (3, 5, 10), (4, 5, 20)]
    base = bars_cte("hour", "b0")
    allb = f"bars AS MATERIALIZED (SELECT symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, n, f, s FROM b0, (VALUES {', '.join(map(str, grid))}) g(pid, f, s))"
    ma = lambda n: f"({roll('avg', 'close', n)})"
    sm = f"sm AS MATERIALIZED (SELECT symbol, rn, ts, close, CASE f WHEN 3 THEN {ma(3)} ELSE {ma(5)} END - CASE s WHEN 10 THEN {ma(10)} ELSE {ma(20)} END AS dd FROM bars)"
    fl = f'flg AS MATERIALIZED (SELECT symbol, rn, ts, close, coalesce(lag(dd) OVER ({OVER}) <= 0 AND dd > 0, false) AS entry, coalesce(lag(dd) OVER ({OVER}) >= 0 AND dd < 0, false) AS "exit" FROM sm)'
    from .position_queries import PERF
    return (f"WITH RECURSIVE {base}, {allb}, {sm}, {fl}, {', '.join(latch_tail('flg')[0])}" + TRADES[len(SMA_SIGNALS):] + PERF[len(SMA_SIGNALS):]
            + f", ts AS ({TS}) SELECT split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS BIGINT) AS param_id, total_return_pct, sharpe_ratio, sortino_ratio, max_drawdown_pct, num_trades, win_rate, profit_factor FROM perf JOIN ts USING (symbol)")


@query("sweep", sweep_sql())
def _(s, d):
    w = W.sweep(event_bars(s, d), W.param_grid(s, fast=[3, 5], slow=[10, 20]), K)
    return w.select("symbol", "param_id", "total_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "num_trades", "win_rate", "profit_factor")


@query("param_grid", "WITH k AS (SELECT DISTINCT event_type AS symbol FROM events), a AS (SELECT unnest([3, 5, 8]) AS fast), b AS (SELECT unnest([10, 20, 40, 80]) AS slow) SELECT symbol, CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow FROM k, a, b")
def _(s, d):
    g = W.param_grid(s, fast=[3, 5, 8], slow=[10, 20, 40, 80])
    sets = F.array(*[F.struct(F.lit(r.fast).alias("fast"), F.lit(r.slow).alias("slow")) for r in g.collect()])
    return event_ticks(s, d).select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.explode(sets).alias("p")).select("symbol", F.col("p.fast").cast("long").alias("fast"), F.col("p.slow").cast("long").alias("slow"))


@query("preset_grids", "SELECT event_type AS symbol, strategy, count(*) AS events, k AS combos FROM events, (VALUES ('GRID', 24), ('DCA', 108), ('PLA', 81)) v(strategy, k) GROUP BY 1, 2, k")
def _(s, d):
    g = W.preset_grids(s).groupBy("strategy").agg(F.countDistinct("param_id").cast("int").alias("combos"))
    return event_ticks(s, d).groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("events")).select("symbol", "events", F.explode(F.array(*[F.struct(F.lit(r.strategy).alias("strategy"), F.lit(r.combos).alias("combos")) for r in g.collect()])).alias("g")).select("symbol", "g.strategy", "events", "g.combos")


PRUNS = """pr AS MATERIALIZED (SELECT l_partkey AS run_id, 'S' || (l_partkey % 7) AS symbol, CASE l_partkey % 3 WHEN 0 THEN 'GRID' WHEN 1 THEN 'DCA' ELSE 'PLA' END AS strategy, avg(l_discount) * 60 - 2 AS sharpe_ratio, avg(l_extendedprice) / 997 - 40 AS total_return_pct, avg(l_tax) * 40 - 1 AS sortino_ratio,
   min(l_quantity) / 21 AS calmar_ratio, -max(l_extendedprice) / 1013 AS max_drawdown_pct, CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE count(*) END AS num_trades, 100.0 * avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS win_rate FROM lineitem GROUP BY l_partkey)"""


def sweep_rows(s, d):
    li = table(s, d, "lineitem")
    p = F.col("l_partkey")
    a = li.groupBy("l_partkey").agg((F.avg("l_discount") * 60 - 2).alias("sharpe_ratio"), (F.avg("l_extendedprice") / 997 - 40).alias("total_return_pct"), (F.avg("l_tax") * 40 - 1).alias("sortino_ratio"), (F.min("l_quantity") / 21).alias("calmar_ratio"),
                                    (-F.max("l_extendedprice") / 1013).alias("max_drawdown_pct"), F.count(F.lit(1)).alias("_n"), (100.0 * F.avg(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))).alias("win_rate"))
    return a.select(p.alias("run_id"), F.concat(F.lit("S"), (p % 7).cast("string")).alias("symbol"), F.expr("CASE l_partkey % 3 WHEN 0 THEN 'GRID' WHEN 1 THEN 'DCA' ELSE 'PLA' END").alias("strategy"),
                    "sharpe_ratio", "total_return_pct", "sortino_ratio", "calmar_ratio", "max_drawdown_pct", F.when(p % 11 == 0, 0).otherwise(F.col("_n")).alias("num_trades"), "win_rate")


def comp_sql() -> str:
    v = {m: f"abs({m})" if m == "max_drawdown_pct" else m for m in W.BATCH_WEIGHTS}
    rng = ", ".join(f"min({e}) AS lo_{m}, max({e}) AS hi_{m}" for m, e in v.items())
    t = " + ".join(f"{W.BATCH_WEIGHTS[m]} * {'(1 - ' if m == 'max_drawdown_pct' else '('}({e} - lo_{m}) / (hi_{m} - lo_{m}))" for m, e in v.items())
    return f"{PRUNS}, rg AS (SELECT {rng} FROM pr WHERE num_trades > 0), cs AS MATERIALIZED (SELECT pr.*, CASE WHEN num_trades > 0 THEN round({t}, 4) ELSE 0.0 END AS composite_score FROM pr, rg)"


@query("composite_score", f"WITH {comp_sql()} SELECT run_id, symbol, strategy, composite_score FROM cs")
def _(s, d):
    return W.composite_score(sweep_rows(s, d)).select("run_id", "symbol", "strategy", "composite_score")


@query("leaderboard", f"WITH {comp_sql()} SELECT run_id, symbol, composite_score, CAST(row_number() OVER (ORDER BY composite_score DESC, run_id) AS INTEGER) AS rank FROM cs ORDER BY composite_score DESC, run_id LIMIT 10")
def _(s, d):
    return W.leaderboard(W.composite_score(sweep_rows(s, d)), 10, ties=["run_id"]).select("run_id", "symbol", "composite_score", "rank")


@query("best_per_strategy", f"WITH {comp_sql()} SELECT strategy, symbol AS best_symbol, run_id, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY composite_score DESC, run_id) AS k FROM cs) WHERE k = 1")
def _(s, d):
    return W.best_per(W.composite_score(sweep_rows(s, d)), ["strategy"], ties=["run_id"]).select("strategy", F.col("symbol").alias("best_symbol"), "run_id", "composite_score")


@query("best_per_symbol", f"WITH {comp_sql()} SELECT symbol, strategy, run_id, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY composite_score DESC, run_id) AS k FROM cs) WHERE k = 1")
def _(s, d):
    return W.best_per(W.composite_score(sweep_rows(s, d)), ["symbol"], ties=["run_id"]).select("symbol", "strategy", "run_id", "composite_score")


@query("compare_runs", f"WITH {PRUNS}, q AS (SELECT pr.run_id, p_name AS job, num_trades, max_drawdown_pct FROM pr JOIN part ON p_partkey = run_id WHERE p_size > 45) SELECT run_id, job, num_trades, num_trades = max(num_trades) OVER () AS best_num_trades, max_drawdown_pct = max(max_drawdown_pct) OVER () AS best_max_drawdown_pct FROM q")
def _(s, d):
    p = table(s, d, "part")
    jobs = p.select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("job"))
    ids = p.filter("p_size > 45").select(F.col("p_partkey").alias("run_id"))
    return W.compare_runs(sweep_rows(s, d), jobs, ids, ["num_trades", "max_drawdown_pct"]).select("run_id", "job", "num_trades", "best_num_trades", "best_max_drawdown_pct")


RC = ["total_return_pct", "sharpe_ratio", "win_rate"]


@query("column_ranges", f"WITH {PRUNS} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {rx(f'min({c})', 'lo')}, {rx(f'max({c})', 'hi')} FROM pr" for c in RC))
def _(s, d):
    return fin(W.column_ranges(sweep_rows(s, d), RC))


@query("outcome_summary", f"WITH {PRUNS} SELECT strategy, symbol AS category, count(*) AS runs, round(avg(total_return_pct), 4) AS avg_return, round(avg(sharpe_ratio), 4) AS avg_sharpe, round(avg(win_rate), 4) AS avg_win_rate FROM pr GROUP BY 1, 2")
def _(s, d):
    return W.outcome_summary(sweep_rows(s, d).withColumnRenamed("symbol", "category"))


CK = "substr(sha256('{\"params\": {\"n\": ' || (o_custkey % 400) || '}, \"strategy\": \"RSI\", \"symbol\": \"' || o_orderpriority || '\", \"timeframe\": \"1h\"}'), 1, 32)"


@query("cached_outcomes", f"""WITH l AS (SELECT {CK} AS k, o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), h AS (SELECT k, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS hit FROM l GROUP BY k)
   SELECT o.o_orderkey AS new_id, CAST(h.hit AS DOUBLE) AS hit_id FROM (SELECT *, {CK} AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') o LEFT JOIN h ON h.k = o.k""")
def _(s, d):
    from ..functions.scalar import cache_key
    o = table(s, d, "orders").withColumn("cache_key", cache_key(F.lit("rsi"), {"n": F.col("o_custkey") % 400}, "o_orderpriority", F.lit("1h")))
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    log = o.filter(F.col("o_orderdate") < cut).select("cache_key", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    new = o.filter(F.col("o_orderdate") >= cut).select("cache_key", F.col("o_orderkey").alias("new_id"))
    return W.cached_outcomes(new, log).select("new_id", F.col("hit.o_orderkey").cast("double").alias("hit_id"))


@query("plateau", """WITH h AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS round, l_discount * 7 AS score FROM lineitem), g AS (SELECT *, score - lag(score) OVER (PARTITION BY k ORDER BY round) AS gain FROM h),
   st AS (SELECT k, min(round) FILTER (round >= 2 AND gain < 0.02) AS p FROM g GROUP BY k)
   SELECT g.k, CAST(first(round ORDER BY score DESC, round) AS BIGINT) AS best_round, round(max(score), 6) + 0.0 AS best_score, CAST(any_value(p) AS DOUBLE) AS plateau_round, max(round) AS rounds_run FROM g JOIN st USING (k) WHERE round <= coalesce(p, round) GROUP BY g.k""")
def _(s, d):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    h = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).cast("long").alias("round"), (F.col("l_discount") * 7).alias("score"))
    return fin(W.plateau(h, ["k"]), "k", "best_round", "best_score", F.col("plateau_round").cast("double").alias("plateau_round"), "rounds_run")


@query("fetch_runs", "SELECT o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS result, coalesce(c, 0) AS n_trades FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(s, d):
    o = table(s, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    res = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("result"))
    return W.fetch_runs(jobs, res, table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id")), "run_id")
