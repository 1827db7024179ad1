"""Rules, signal tables and the ready-made strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import signals as G
from ..operators.presets import PRESETS, preset_flags, preset_flags_many
from ..operators.indicators import catalog
from ..session import stage
from ..sources.tables import event_bars
from .oracle import Sql, lag, latch_tail
from .registry import OVER, bars_cte, fin, query, r, rx

K = ["symbol"]


# ------------------------------------------------------------------ SQL of the presets

def b(x: str) -> str:
    return f"coalesce(({x}), false)"


def up(x: str, y: str = "0") -> str:
    return b(f"{lag(x)} <= {lag(y) if y.strip('-.0123456789') else y} AND {x} > {y}")


def down(x: str, y: str = "0") -> str:
    return b(f"{lag(x)} >= {lag(y) if y.strip('-.0123456789') else y} AND {x} < {y}")


def prev(x: str, missing: str = "false") -> str:
    return f"lag({b(x)}, 1, {missing}) OVER ({OVER})"


def edge_on(x: str) -> str:
    return f"({b(x)} AND NOT {prev(x)})"


def edge_off(x: str) -> str:
    return f"(NOT {b(x)} AND {prev(x)})"


def zone(c):
    return lambda o: (up(c, str(o["oversold"])), down(c, str(o["overbought"])))


def cross(x, y="0"):
    return lambda o: (up(x, y), down(x, y))


def gt(c, v):
    return b(f"{c} > {v}")


MU, MD = up("macd - macd_signal"), down("macd - macd_signal")
ST = "supertrend_dir = 1"

LOGIC = {
    "RSI": zone("rsi"), "MACD": lambda o: (MU, MD),
    "BOLLINGER": lambda o: (b(f"{lag('close')} < {lag('bb_lower')} AND close >= bb_lower"), b(f"{lag('close')} < {lag('bb_mid')} AND close >= bb_mid")),
    "SUPERTREND": lambda o: (b(f"{lag('supertrend_dir')} < 0 AND supertrend_dir > 0"), b(f"{lag('supertrend_dir')} > 0 AND supertrend_dir < 0")),
    "DONCHIAN": lambda o: (b("close > dc_upper_in"), b("close < dc_lower_out")),
    "MACROSS": cross("ema_f - ema_s"), "SMA_CROSS": cross("sma_f - sma_s"), "WMA_CROSS": cross("wma_f - wma_s"), "HMA_CROSS": cross("hma_f - hma_s"), "GOLDEN_CROSS": cross("sma_f - sma_s"),
    "STOCH_CROSS": cross("stoch_k - stoch_d"), "STOCH_OBOS": zone("stoch_k"), "CCI_REV": zone("cci"), "CCI_TREND": cross("cci"), "WILLIAMS": zone("willr"),
    "ROC": cross("roc"), "MOMENTUM": cross("mom"), "TSI": cross("tsi"),
    "ADX_TREND": lambda o: (f"({gt('adx', o['adx_threshold'])} AND {edge_on('plus_di > minus_di')})", b(f"plus_di < minus_di AND {lag('plus_di')} >= {lag('minus_di')}")),
    "DI_CROSS": cross("plus_di - minus_di"), "PSAR": lambda o: (edge_on("close > psar"), edge_off("close > psar")),
    "AROON_CROSS": cross("aroon_up - aroon_down"),
    "AROON_OBOS": lambda o: (edge_on(f"aroon_up > {o['threshold']} AND aroon_down < {100 - o['threshold']}"), edge_off(f"aroon_up > {o['threshold']} AND aroon_down < {100 - o['threshold']}")),
    "TRIPLE_EMA": lambda o: (edge_on("ema_f > ema_m AND ema_m > ema_s"), b(f"ema_f < ema_s AND {lag('ema_f')} >= {lag('ema_s')}")),
    "VWAP_CROSS": cross("close - vwap"), "OBV_TREND": cross("obv - obv_ema"), "MFI_OBOS": zone("mfi"), "CMF_ZERO": cross("cmf"),
    "KC_BREAK": lambda o: (b("close > kc_upper"), b("close < kc_lower")),
    "ATR_BREAK": lambda o: (b(f"close > {lag('top')} + {o['atr_multiplier']} * atr"), b(f"close < {lag('top')}")),
    "BB_SQUEEZE": lambda o: tuple(f"({prev('bb_lower > kc_lower AND bb_upper < kc_upper')} AND {b('bb_upper - bb_lower > kc_upper - kc_lower')} AND {b(f'close {c} bb_mid')})" for c in "><"),
    "RSI_MACD": lambda o: (f"({b('rsi < ' + str(o['rsi_oversold']))} AND {MU})", f"({gt('rsi', o['rsi_overbought'])} OR {MD})"),
    "RSI_BB": lambda o: (b(f"rsi < {o['rsi_oversold']} AND close <= bb_lower"), f"({gt('rsi', o['rsi_overbought'])} OR {b('close >= bb_upper')})"),
    "RSI_STOCH": lambda o: (b(f"rsi < {o['rsi_oversold']} AND stoch_k < {o['stoch_oversold']}"), f"({gt('rsi', o['rsi_overbought'])} OR {gt('stoch_k', o['stoch_overbought'])})"),
    "RSI_VOLUME": lambda o: (b(f"rsi < {o['rsi_oversold']} AND obv > obv_ema"), f"({gt('rsi', o['rsi_overbought'])} OR NOT {b('obv > obv_ema')})"),
    "MACD_ADX": lambda o: (f"({MU} AND {gt('adx', o['adx_threshold'])})", MD), "MACD_STOCH": lambda o: (f"({MU} AND {b('stoch_k < ' + str(o['stoch_oversold']))})", MD),
    "MACD_VOLUME": lambda o: (f"({MU} AND {gt('cmf', 0)})", MD), "MACD_PSAR": lambda o: (f"({MU} AND {b('close > psar')})", f"({MD} OR {edge_off('close > psar')})"),
    "ST_MACD": lambda o: (f"(({b(ST)} AND NOT {prev(ST)} AND {gt('macd_hist', 0)}) OR ({b(ST)} AND {b(lag('macd_hist') + ' <= 0')} AND {gt('macd_hist', 0)}))", edge_off(ST)),
    "ST_RSI": lambda o: (f"({b(ST)} AND {b('rsi < ' + str(o['rsi_overbought']))} AND NOT ({prev(ST)} AND {prev('rsi < ' + str(o['rsi_overbought']), 'true')}))", edge_off(ST)),
    "ST_VOLUME": lambda o: (f"({b(ST)} AND {gt('cmf', 0)} AND NOT ({prev(ST)} AND {prev('cmf > 0', 'true')}))", edge_off(ST)),
    "DC_ADX": lambda o: (b(f"close >= dc_upper AND adx > {o['adx_threshold']}"), b("close <= dc_lower")),
    "VWAP_RSI": lambda o: (f"({edge_on('close > vwap')} AND {b('rsi < ' + str(o['rsi_overbought']))})", edge_off("close > vwap")),
    "VWAP_MACD": lambda o: (f"({MU} AND {b('close > vwap')})", MD),
    "ADX_STOCH": lambda o: (f"({gt('adx', o['adx_threshold'])} AND {b('plus_di > minus_di')} AND {up('stoch_k', str(o['stoch_oversold']))})", edge_off("plus_di > minus_di")),
    "KC_RSI": lambda o: (b(f"close > kc_upper AND rsi > {o['rsi_min']}"), b("close < kc_lower")),
    "AROON_ADX": lambda o: tuple(f(f"aroon_up > {o['aroon_thresh']} AND aroon_down < {100 - o['aroon_thresh']} AND adx > {o['adx_threshold']}") for f in (edge_on, edge_off)),
    "MFI_CMF": lambda o: (f"({up('mfi', str(o['mfi_oversold']))} AND {gt('cmf', 0)})", f"({b('cmf < 0')} AND coalesce({lag('cmf')}, 0) >= 0)"),
}
LOGIC["BB_RSI"] = LOGIC["RSI_BB"]


def flags_sql(name: str, o: dict, q: Sql) -> str:
    """CTEs for the flags of a preset -> name of table (symbol, rn, ts, close, entry, exit)."""
    parts = {}
    for u in PRESETS[name].uses(o):
        t, outs = q.indicator(u.key, u.clean, u.suffix)
        parts.update({x: (t, x) for x in outs})
    for n in PRESETS[name].scans(o):
        parts["obv_ema"] = (q.ema(parts["obv"][0], "obv", n), "y")
    if name == "ATR_BREAK":
        from .oracle import roll
        parts["top"] = (q.table({"top": roll("max", "high", o["lookback"])}), "top")
    j = q.join(parts, keep="b.ts, b.close, ")
    e, x = LOGIC[name](o)
    return q.add(f'SELECT symbol, rn, ts, close, {e} AS entry, {x} AS "exit" FROM {j}')


# Thresholds that these noisy bars actually reach, so that every preset trades.
TUNED = {"RSI": dict(oversold=45.0, overbought=55.0), "MFI_OBOS": dict(oversold=40.0, overbought=60.0), "ADX_TREND": dict(adx_threshold=12.0),
         "RSI_MACD": dict(rsi_oversold=52.0, rsi_overbought=60.0), "RSI_BB": dict(rsi_oversold=50.0, rsi_overbought=55.0, bb_std=0.5),
         "RSI_STOCH": dict(rsi_oversold=50.0, rsi_overbought=55.0, stoch_oversold=40.0, stoch_overbought=60.0), "RSI_VOLUME": dict(rsi_oversold=50.0, rsi_overbought=55.0),
         "MACD_ADX": dict(adx_threshold=8.0), "MACD_STOCH": dict(stoch_oversold=60.0), "ST_RSI": dict(rsi_overbought=55.0), "DC_ADX": dict(adx_threshold=8.0),
         "BB_RSI": dict(rsi_oversold=50.0, rsi_overbought=55.0, bb_std=0.5), "VWAP_RSI": dict(rsi_overbought=55.0), "ADX_STOCH": dict(adx_threshold=8.0, stoch_oversold=40.0),
         "AROON_ADX": dict(adx_threshold=8.0), "MFI_CMF": dict(mfi_oversold=45.0), "BB_SQUEEZE": dict(bb_std=1.0, kc_mult=1.0), "KC_BREAK": dict(multiplier=0.5), "KC_RSI": dict(kc_mult=0.5, rsi_min=48.0),
         "ATR_BREAK": dict(lookback=3, atr_multiplier=0.1), "SUPERTREND": dict(length=7, multiplier=1.0), "ST_MACD": dict(st_length=7, st_mult=1.0), "GOLDEN_CROSS": dict(fast=20, slow=80),
         "AROON_OBOS": dict(threshold=60.0)}
TUNED["ST_RSI"].update(st_length=7, st_mult=1.0)
TUNED["ST_VOLUME"] = dict(st_length=7, st_mult=1.0)
COARSE = {"CMF_ZERO", "MACD_VOLUME", "ST_VOLUME", "MFI_CMF"}


def params_of(name: str) -> dict:
    return {**PRESETS[name].params, **TUNED.get(name, {})}


def _register(name: str) -> None:
    o, unit, ivl = params_of(name), "4h" if name in COARSE else "hour", "4h" if name in COARSE else "1h"
    q = Sql()
    src = flags_sql(name, o, q)
    tail, _ = latch_tail(src)
    sql = f"WITH RECURSIVE {bars_cte(unit)}, {', '.join(q.ctes)}, {', '.join(tail)} SELECT symbol, ts, signal, {rx('quantity', 'quantity')} FROM signals"

    @query(f"preset_{name.lower()}", sql)
    def run(s, d):
        flags = preset_flags(event_bars(s, d, ivl), K, name, **o)
        return fin(G.signals_from_masks(flags, K), "symbol", "ts", "signal", "quantity")


for _name in PRESETS:
    _register(_name)


# ------------------------------------------------------------------ predicates and rules

PRED = f"WITH {bars_cte()}, p AS (SELECT symbol, ts, rn, open, close, high, low FROM bars)"


@query("compare_ops", PRED + " SELECT symbol, ts, close > open AS gt, close >= open AS ge, close < open AS lt, close <= open AS le FROM p")
def _(s, d):
    c, o = F.col("close"), F.col("open")
    return event_bars(s, d).select("symbol", "ts", *[G.compare(c, op, o).alias(n) for op, n in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"))])


@query("crossings", PRED + f" SELECT symbol, ts, {up('close', 'open')} AS above, {down('close', 'open')} AS below, {up('close', '150.0')} AS left_low, {edge_on('close > open')} AS edge_up, {edge_off('close > open')} AS edge_down FROM p")
def _(s, d):
    p = I.Panel(event_bars(s, d), K, 2, I.BLOCK)
    c, o = F.col("close"), F.col("open")
    p.put("above", G.cross_above(p, c, o))
    p.put("below", G.cross_below(p, c, o))
    p.put("left_low", G.threshold_exit_up(p, c, 150.0))
    p.put("edge_up", G.edge(p, c > o))
    p.put("edge_down", G.edge_off(p, c > o))
    return p.close().select("symbol", "ts", "above", "below", "left_low", "edge_up", "edge_down")


ENTRY = [{"left": {"indicator": "rsi", "params": {"length": 7}}, "operator": "<", "right": {"value": 45}},
         {"left": {"price": "close"}, "operator": "cross_above", "right": {"indicator": "sma", "params": {"length": 5}}}]
EXIT = [{"left": {"indicator": "bbands", "params": {"length": 20, "std": 1}, "output": "bb_upper"}, "operator": "<", "right": {"price": "high"}},
        {"left": {"indicator": "rsi", "params": {"length": 7}}, "operator": "cross_below", "right": {"value": 55}}]


def rules_sql(logic: str = "OR"):
    q = Sql()
    a, _ = q.indicator("rsi", {"length": 7})
    c, _ = q.indicator("sma", {"length": 5})
    e, _ = q.indicator("bbands", {"length": 20, "std": 1.0})
    j = q.join({"rsi": (a, "rsi"), "sma": (c, "sma"), "bb_upper": (e, "bb_upper")}, keep="b.ts, b.open, b.high, b.low, b.close, ")
    en = f"({b('rsi < 45')} AND {up('close', 'sma')})" if logic == "AND" else f"({b('rsi < 45')} OR {up('close', 'sma')})"
    f = q.add(f"SELECT symbol, rn, ts, open, high, low, close, {en} AS entry, ({b('bb_upper < high')} {logic} {down('rsi', '55')}) AS \"exit\" FROM {j}")
    return q, f


_q, _f = rules_sql("OR")


@query("rule_flags", f"WITH RECURSIVE {bars_cte()}, {', '.join(_q.ctes)} SELECT symbol, ts, entry, \"exit\" FROM {_f}")
def _(s, d):
    return G.rule_flags(event_bars(s, d), K, ENTRY, EXIT, "OR").select("symbol", "ts", "entry", "exit")


_qa, _fa = rules_sql("AND")


@query("rule_flags_and", f"WITH RECURSIVE {bars_cte()}, {', '.join(_qa.ctes)} SELECT symbol, ts, entry, \"exit\" FROM {_fa}")
def _(s, d):
    return G.rule_flags(event_bars(s, d), K, ENTRY, EXIT, "AND").select("symbol", "ts", "entry", "exit")


@query("custom_signals", f"WITH RECURSIVE {bars_cte()}, {', '.join(_q.ctes)}, {', '.join(latch_tail(_f)[0])} SELECT symbol, ts, signal, {rx('quantity', 'quantity')} FROM signals")
def _(s, d):
    return fin(G.signals_from_masks(G.rule_flags(event_bars(s, d), K, ENTRY, EXIT, "OR"), K), "symbol", "ts", "signal", "quantity")


@query("signals_sl_tp", f"""WITH RECURSIVE {bars_cte()}, {', '.join(_q.ctes)},
   st(symbol, rn, px, act, epx, xpx) AS (SELECT symbol, 0::BIGINT, NULL::DOUBLE, 0, NULL::DOUBLE, NULL::DOUBLE FROM {_f} WHERE rn = 1 UNION ALL
     SELECT symbol, rn, CASE WHEN act = 1 THEN close WHEN act >= 2 THEN NULL ELSE px END, act, CASE WHEN act = 1 THEN close WHEN act >= 2 THEN px END,
       CASE act WHEN 2 THEN px * (1 - 10.0 / 100) WHEN 3 THEN px * (1 + 15.0 / 100) WHEN 4 THEN close END FROM
     (SELECT s.symbol, s.rn, s.close, e.px, CASE WHEN e.px IS NULL THEN CASE WHEN s.entry THEN 1 ELSE 0 END WHEN s.low <= e.px * (1 - 10.0 / 100) THEN 2 WHEN s.high >= e.px * (1 + 15.0 / 100) THEN 3 WHEN s."exit" THEN 4 ELSE 0 END AS act
      FROM st e JOIN {_f} s ON s.symbol = e.symbol AND s.rn = e.rn + 1))
   SELECT b.symbol, b.ts, CASE WHEN act = 1 THEN 'BUY' WHEN act >= 2 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE act WHEN 2 THEN 'stop_loss' WHEN 3 THEN 'take_profit' WHEN 4 THEN 'rule' END AS exit_reason,
     {rx('CASE WHEN act > 0 THEN 1000.0 / epx ELSE 0 END', 'quantity')}, {rx('xpx', 'exit_price')} FROM bars b JOIN st USING (symbol, rn)""")
def _(s, d):
    f = G.rule_flags(event_bars(s, d), K, ENTRY, EXIT, "OR")
    return fin(G.signals_sl_tp(f, K, 10.0, 15.0), "symbol", "ts", "signal", "exit_reason", "quantity", "exit_price")


@query("check_rules", """SELECT rule_id, grp, ord, side, problem FROM (
   SELECT event_id AS rule_id, 'entry' AS grp, 1 AS ord, 'left' AS side, CASE event_id % 8 WHEN 0 THEN 'unknown operator' WHEN 1 THEN 'unknown indicator' WHEN 2 THEN 'unknown output' WHEN 3 THEN 'unknown parameter' END AS problem FROM events WHERE event_id % 8 <> 7
   UNION ALL SELECT event_id, 'entry', 1, 'right', CASE event_id % 8 WHEN 4 THEN 'unknown price column' WHEN 5 THEN 'operand needs exactly one of indicator, price, value' END FROM events WHERE event_id % 8 <> 7
   UNION ALL SELECT event_id, 'entry', NULL, NULL, 'an entry rule is required' FROM events WHERE event_id % 8 = 7) WHERE problem IS NOT NULL""")
def _(s, d):
    e = "event_id % 8"
    side = "named_struct('indicator', {i}, 'params', {p}, 'output', {o}, 'price', {pr}, 'value', {v})"
    nul = "cast(null as string)"
    left = side.format(i=f"CASE WHEN {e} = 1 THEN 'nosuch' ELSE 'rsi' END", p=f"map(CASE WHEN {e} = 3 THEN 'speed' ELSE 'length' END, 14D)",
                       o=f"CASE WHEN {e} = 2 THEN 'macd' WHEN {e} = 1 THEN {nul} ELSE 'rsi' END", pr=nul, v="cast(null as double)")
    right = side.format(i=nul, p="cast(null as map<string,double>)", o=nul, pr=f"CASE WHEN {e} = 4 THEN 'typical' END", v=f"CASE WHEN {e} IN (4, 5) THEN cast(null as double) ELSE value END")
    rules = s.read.parquet(f"{d}/events.parquet").selectExpr(
        "event_id as rule_id", f"CASE WHEN {e} = 7 THEN 'exit' ELSE 'entry' END as grp", "1 as ord", f"CASE WHEN {e} = 0 THEN 'touches' ELSE '>' END as operator", f"{left} as left", f"{right} as right")
    return G.check_rules(rules, catalog(s))


# ------------------------------------------------------------------ the classic strategies

@query("grid_signals", f"""WITH {bars_cte()}, l AS (SELECT symbol, rn, ts, close, {lag('close')} AS p FROM bars), k AS (SELECT unnest(range(0, 7)) AS i),
   c AS (SELECT l.symbol, l.ts, any_value(close) AS close, any_value(p) AS p, count(*) FILTER (p < 105 + i * (240.0 - 105) / 6 AND 105 + i * (240.0 - 105) / 6 <= close) AS u, count(*) FILTER (p > 105 + i * (240.0 - 105) / 6 AND 105 + i * (240.0 - 105) / 6 >= close) AS v FROM l, k GROUP BY l.symbol, l.ts)
   SELECT symbol, ts, CASE WHEN u > 0 THEN 'SELL' WHEN v > 0 THEN 'BUY' ELSE 'HOLD' END AS signal, {rx('CASE WHEN u > 0 THEN 100.0 / close * u ELSE 100.0 / close * v END', 'quantity')} FROM c""")
def _(s, d):
    return fin(G.grid_signals(event_bars(s, d), K, F.lit(105.0), F.lit(240.0), 7), "symbol", "ts", "signal", "quantity")


def dca_sql(body: str) -> str:
    return f"""WITH RECURSIVE {bars_cte()}, g AS (SELECT symbol, (epoch_us(ts) - epoch_us({lag('ts')})) / 3.6e9 AS gap FROM bars), m AS (SELECT symbol, median(gap) AS h FROM g GROUP BY symbol),
      q AS (SELECT b.*, greatest(1, round_even(6 / h, 0))::BIGINT AS ev, greatest(1, round_even(48 / h, 0))::BIGINT AS hd FROM bars b JOIN m USING (symbol)), {body}"""


@query("dca_signals", dca_sql(f"""c AS (SELECT *, (rn - 1) // (hd + 1) AS cyc, (rn - 1) % (hd + 1) AS pos FROM q), e AS (SELECT *, CASE WHEN pos < hd AND pos % ev = 0 THEN 100.0 / close ELSE 0 END AS bq FROM c),
   t AS (SELECT *, sum(bq) OVER (PARTITION BY symbol, cyc) AS tot, (pos = hd OR rn = n) AS sell FROM e)
   SELECT symbol, ts, CASE WHEN sell AND tot > 0 THEN 'SELL' WHEN bq > 0 THEN 'BUY' ELSE 'HOLD' END AS signal, {rx('CASE WHEN sell AND tot > 0 THEN tot ELSE bq END', 'quantity')} FROM t"""))
def _(s, d):
    return fin(G.dca_signals(event_bars(s, d), K, 6, 100.0, 2), "symbol", "ts", "signal", "quantity")


@query("dca_profit_signals", dca_sql(f"""st(symbol, rn, pos, held, av, act, q) AS (SELECT symbol, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0, 0::DOUBLE FROM q WHERE rn = 1 UNION ALL
   SELECT symbol, rn, CASE WHEN sell THEN 0 ELSE pos + 1 END, CASE WHEN sell THEN 0 ELSE h2 END, CASE WHEN sell THEN 0 ELSE a2 END, CASE WHEN sell THEN 2 WHEN bq > 0 THEN 1 ELSE 0 END, CASE WHEN sell THEN h2 ELSE bq END FROM
    (SELECT *, h2 > 0 AND ((close - a2) / a2 * 100 >= 12 OR pos >= hd OR rn = n) AS sell FROM (SELECT *, held + bq AS h2, CASE WHEN held + bq > 0 THEN (av * held + close * bq) / (held + bq) ELSE 0 END AS a2 FROM
      (SELECT s.symbol, s.rn, s.n, s.close, s.hd, e.pos, e.held, e.av, CASE WHEN e.pos < s.hd AND e.pos % s.ev = 0 THEN 100.0 / s.close ELSE 0 END AS bq FROM st e JOIN q s ON s.symbol = e.symbol AND s.rn = e.rn + 1))))
   SELECT b.symbol, b.ts, CASE act WHEN 1 THEN 'BUY' WHEN 2 THEN 'SELL' ELSE 'HOLD' END AS signal, {rx('q', 'quantity')} FROM bars b JOIN st USING (symbol, rn)"""))
def _(s, d):
    return fin(G.dca_profit_signals(event_bars(s, d), K, 6, 100.0, 2, 12.0), "symbol", "ts", "signal", "quantity")


_p = Sql()
_j = _p.join({"f": (_p.ema("bars", "close", 9), "y"), "s": (_p.ema("bars", "close", 21), "y")}, keep="b.ts, b.close, ")
_d = _p.add(f"SELECT symbol, rn, ts, close, f - s AS cur, {lag('f - s')} AS prv FROM {_j}")


def pla_sql(exit_cond: str) -> str:
    lv = lambda k, pct, usd: f"CASE WHEN inside AND NOT d{k} AND close <= first * (1 + {pct} / 100) THEN {usd} / close ELSE 0 END"
    return f"""WITH RECURSIVE {bars_cte()}, {', '.join(_p.ctes)},
   st(symbol, rn, inside, first, av, held, d1, d2, d3, act, q) AS (SELECT symbol, 0::BIGINT, false, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, false, false, false, 0, 0::DOUBLE FROM {_d} WHERE rn = 1 UNION ALL
    SELECT symbol, rn, CASE WHEN sell THEN false ELSE inside OR fresh END, CASE WHEN sell THEN 0 WHEN fresh THEN close ELSE first END, CASE WHEN sell THEN 0 WHEN fresh THEN close ELSE a2 END, CASE WHEN sell THEN 0 WHEN fresh THEN 300.0 / close ELSE h2 END,
      NOT sell AND (d1 OR b1 > 0), NOT sell AND (d2 OR b2 > 0), NOT sell AND (d3 OR b3 > 0), CASE WHEN sell THEN 2 WHEN fresh OR b1 + b2 + b3 > 0 THEN 1 ELSE 0 END,
      CASE WHEN sell THEN h2 WHEN fresh THEN 300.0 / close ELSE b1 + b2 + b3 END FROM
     (SELECT *, inside AND coalesce({exit_cond}, false) AS sell FROM (SELECT *, held + b1 + b2 + b3 AS h2, CASE WHEN inside THEN (av * held + close * (b1 + b2 + b3)) / (held + b1 + b2 + b3) ELSE 0 END AS a2 FROM
       (SELECT *, {lv(1, -1.0, 300.0)} AS b1, {lv(2, -2.5, 600.0)} AS b2, {lv(3, -4.0, 900.0)} AS b3 FROM
        (SELECT s.symbol, s.rn, s.close, s.prv, s.cur, e.inside, e.first, e.av, e.held, e.d1, e.d2, e.d3, NOT e.inside AND coalesce(s.prv <= 0 AND s.cur > 0, false) AS fresh FROM st e JOIN {_d} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)))))
   SELECT b.symbol, b.ts, CASE act WHEN 1 THEN 'BUY' WHEN 2 THEN 'SELL' ELSE 'HOLD' END AS signal, {rx('q', 'quantity')} FROM bars b JOIN st USING (symbol, rn)"""


@query("pla_signals", pla_sql("prv >= 0 AND cur < 0"))
def _(s, d):
    return fin(G.pla_signals(event_bars(s, d), K, 9, 21), "symbol", "ts", "signal", "quantity")


@query("pla_take_profit", pla_sql("(close - a2) / a2 * 100 >= 5.0"))
def _(s, d):
    return fin(G.pla_signals(event_bars(s, d), K, 9, 21, exit_type="take_profit"), "symbol", "ts", "signal", "quantity")


@query("pla_stop_loss", pla_sql("(a2 - close) / a2 * 100 >= 3.0"))
def _(s, d):
    return fin(G.pla_signals(event_bars(s, d), K, 9, 21, exit_type="stop_loss"), "symbol", "ts", "signal", "quantity")


_s = Sql()
_sf = flags_sql("SMA_CROSS", params_of("SMA_CROSS"), _s)
SMA_SIGNALS = f"{bars_cte()}, {', '.join(_s.ctes)}, {', '.join(latch_tail(_sf)[0])}"


@query("signal_summary", f"""WITH RECURSIVE {SMA_SIGNALS} SELECT symbol, count(*) AS bars, count(*) FILTER (signal = 'BUY') AS buys, count(*) FILTER (signal = 'SELL') AS sells,
   CASE WHEN count(*) FILTER (signal = 'BUY') = 0 THEN 'no_entry' WHEN count(*) FILTER (signal = 'SELL') = 0 THEN 'never_closed' ELSE 'traded' END AS cause FROM signals GROUP BY symbol""")
def _(s, d):
    return G.signal_summary(G.signals_from_masks(preset_flags(event_bars(s, d), K, "SMA_CROSS"), K), K)


MANY = ["SMA_CROSS", "MACD", "STOCH_CROSS", "ROC", "VWAP_CROSS", "CCI_TREND", "DONCHIAN", "TSI"]


def _many():
    q, rows = Sql(), []
    for n in MANY:
        f = flags_sql(n, dict(PRESETS[n].params), q)
        rows.append(f"SELECT symbol, '{n}' AS strategy, count(*) AS bars, count(*) FILTER (entry) AS entries, count(*) FILTER (\"exit\") AS exits FROM {f} GROUP BY symbol")
    return f"WITH RECURSIVE {bars_cte()}, {', '.join(q.ctes)} {' UNION ALL '.join(rows)}"


@query("preset_flags_many", _many())
def _(s, d):
    f = preset_flags_many(event_bars(s, d), K, MANY)
    return f.groupBy("symbol", "strategy").agg(F.count(F.lit(1)).alias("bars"), F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"))
