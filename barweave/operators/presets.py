"""The 50 ready-made strategies as entry/exit predicates over indicators.

Each preset names its indicator uses and returns two boolean columns; everything else
(block layout, latch, sizing) is shared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK
from .indicators import Panel, Use, ema_decay, ema_halo, open_panel, prepare_all, use
from .signals import (cross_above, cross_below, edge, edge_off, flags_from, prev_flag,
                      signals_from_masks, yes)

C = F.col


@dataclass(frozen=True)
class Preset:
    name: str
    params: dict
    uses: Callable[[dict], list[Use]]
    logic: Callable[[Panel, dict], tuple[Column, Column]]
    scans: Callable[[dict], list[int]] = lambda p: []    # extra EMA lengths used by the logic


PRESETS: dict[str, Preset] = {}


def preset(name, uses, logic, scans=lambda p: [], **params):
    PRESETS[name] = Preset(name, params, uses, logic, scans)


def crossing(a, b=0.0):
    """Enter when ``a`` crosses above ``b``, leave when it crosses below."""
    def logic(p, o):
        x = p.tmp(a(o) if callable(a) else C(a))
        y = b if isinstance(b, (int, float)) else p.tmp(C(b))
        return cross_above(p, x, y), cross_below(p, x, y)
    return logic


def zones(col):
    """Enter on leaving the oversold zone, leave on leaving the overbought zone."""
    def logic(p, o):
        return cross_above(p, C(col), o["oversold"]), cross_below(p, C(col), o["overbought"])
    return logic


def macd_cross(p):
    return cross_above(p, C("macd"), C("macd_signal")), cross_below(p, C("macd"), C("macd_signal"))


def macd_use(o):
    return use("macd", fast=o["macd_fast"], slow=o["macd_slow"], signal=o["macd_signal"])


# Default parameters of the presets.
MACD_P = dict(macd_fast=12, macd_slow=26, macd_signal=9)
RSI_P = dict(rsi_length=14, rsi_oversold=35.0, rsi_overbought=65.0)
ST_P = dict(st_length=10, st_mult=3.0)

preset("RSI", lambda o: [use("rsi", length=o["length"])], zones("rsi"), length=14, oversold=30.0, overbought=70.0)
preset("MACD", lambda o: [use("macd", fast=o["fast"], slow=o["slow"], signal=o["signal"])],
       lambda p, o: macd_cross(p), fast=12, slow=26, signal=9)


def _bollinger(p, o):
    band = C("bb_upper") if o["exit_at"] == "upper" else C("bb_mid")
    pc = p.lag(C("close"))
    return ((pc < p.lag(C("bb_lower"))) & (C("close") >= C("bb_lower")),
            (pc < p.lag(band)) & (C("close") >= band))


preset("BOLLINGER", lambda o: [use("bbands", length=o["length"], std=o["std"])], _bollinger,
       length=20, std=2.0, exit_at="mid")
preset("SUPERTREND", lambda o: [use("supertrend", length=o["length"], multiplier=o["multiplier"])],
       lambda p, o: ((p.lag(C("supertrend_dir")) < 0) & (C("supertrend_dir") > 0),
                     (p.lag(C("supertrend_dir")) > 0) & (C("supertrend_dir") < 0)), length=10, multiplier=3.0)
preset("DONCHIAN", lambda o: [use("donchian", "_in", length=o["entry_length"]),
                              use("donchian", "_out", length=o["exit_length"])],
       lambda p, o: (C("close") > C("dc_upper_in"), C("close") < C("dc_lower_out")), entry_length=20, exit_length=10)


def ma_cross(name, kind, fast, slow):
    preset(name, lambda o: [use(o.get("ma_type", kind), "_f", length=o["fast"]),
                            use(o.get("ma_type", kind), "_s", length=o["slow"])],
           lambda p, o: crossing(lambda q: C(q.get("ma_type", kind) + "_f") - C(q.get("ma_type", kind) + "_s"))(p, o),
           fast=fast, slow=slow, **({"ma_type": "ema"} if name == "MACROSS" else {}))


ma_cross("MACROSS", "ema", 20, 50)
STOCH = dict(k=14, d=3, smooth_k=3)


def stoch_use(o):
    return use("stoch", k=o["k"], d=o["d"], smooth_k=o["smooth_k"])


preset("STOCH_CROSS", lambda o: [stoch_use(o)], crossing(lambda o: C("stoch_k") - C("stoch_d")), **STOCH)
preset("STOCH_OBOS", lambda o: [stoch_use(o)], zones("stoch_k"), oversold=20.0, overbought=80.0, **STOCH)
preset("CCI_REV", lambda o: [use("cci", length=o["length"])], zones("cci"), length=20, oversold=-100.0, overbought=100.0)
preset("CCI_TREND", lambda o: [use("cci", length=o["length"])], crossing("cci"), length=20)
preset("WILLIAMS", lambda o: [use("willr", length=o["length"])], zones("willr"), length=14, oversold=-80.0, overbought=-20.0)
preset("ROC", lambda o: [use("roc", length=o["length"])], crossing("roc"), length=12)
preset("MOMENTUM", lambda o: [use("mom", length=o["length"])], crossing("mom"), length=10)
preset("TSI", lambda o: [use("tsi", fast=o["fast"], slow=o["slow"])], crossing("tsi"), fast=13, slow=25)


def _adx_trend(p, o):
    up = p.tmp(yes(C("plus_di") > C("minus_di")))
    return ((C("adx") > o["adx_threshold"]) & up & ~prev_flag(p, up),
            (C("plus_di") < C("minus_di")) & (p.lag(C("plus_di")) >= p.lag(C("minus_di"))))


preset("ADX_TREND", lambda o: [use("adx", length=o["length"])], _adx_trend, length=14, adx_threshold=25.0)
preset("DI_CROSS", lambda o: [use("adx", length=o["length"])], crossing(lambda o: C("plus_di") - C("minus_di")), length=14)


def both_edges(cond):
    def logic(p, o):
        c = cond(o)
        return edge(p, c), edge_off(p, c)
    return logic


preset("PSAR", lambda o: [use("psar", step=o["step"], max_step=o["max_step"])],
       both_edges(lambda o: C("close") > C("psar")), step=0.02, max_step=0.2)
preset("AROON_CROSS", lambda o: [use("aroon", length=o["length"])],
       crossing(lambda o: C("aroon_up") - C("aroon_down")), length=25)
preset("AROON_OBOS", lambda o: [use("aroon", length=o["length"])],
       both_edges(lambda o: (C("aroon_up") > o["threshold"]) & (C("aroon_down") < 100 - o["threshold"])),
       length=25, threshold=70.0)
ma_cross("SMA_CROSS", "sma", 10, 30)
ma_cross("WMA_CROSS", "wma", 10, 30)
ma_cross("HMA_CROSS", "hma", 9, 25)
ma_cross("GOLDEN_CROSS", "sma", 50, 200)


def _triple(p, o):
    bull = (C("ema_f") > C("ema_m")) & (C("ema_m") > C("ema_s"))
    return edge(p, bull), (C("ema_f") < C("ema_s")) & (p.lag(C("ema_f")) >= p.lag(C("ema_s")))


preset("TRIPLE_EMA", lambda o: [use("ema", "_f", length=o["fast"]), use("ema", "_m", length=o["mid"]),
                                use("ema", "_s", length=o["slow"])], _triple, fast=5, mid=13, slow=34)
preset("VWAP_CROSS", lambda o: [use("vwap", length=o["length"])], crossing(lambda o: C("close") - C("vwap")), length=14)


def _obv_trend(p, o):
    diff = p.tmp(C("obv") - p.ema(C("obv"), o["ema_length"]))
    return cross_above(p, diff, 0.0), cross_below(p, diff, 0.0)


preset("OBV_TREND", lambda o: [use("obv")], _obv_trend, lambda o: [o["ema_length"]], ema_length=20)
preset("MFI_OBOS", lambda o: [use("mfi", length=o["length"])], zones("mfi"), length=14, oversold=20.0, overbought=80.0)
preset("CMF_ZERO", lambda o: [use("cmf", length=o["length"])], crossing("cmf"), length=20)
preset("KC_BREAK", lambda o: [use("keltner", length=o["length"], multiplier=o["multiplier"])],
       lambda p, o: (C("close") > C("kc_upper"), C("close") < C("kc_lower")), length=20, multiplier=2.0)


def _atr_break(p, o):
    top = p.tmp(p.roll(F.max, C("high"), o["lookback"]))
    before = p.tmp(p.lag(top))
    return C("close") > before + o["atr_multiplier"] * C("atr"), C("close") < before


preset("ATR_BREAK", lambda o: [use("atr", length=o["atr_length"])], _atr_break,
       atr_length=14, lookback=20, atr_multiplier=1.5)


def _squeeze(p, o):
    tight = p.tmp(yes((C("bb_lower") > C("kc_lower")) & (C("bb_upper") < C("kc_upper"))))
    free = prev_flag(p, tight) & (C("bb_upper") - C("bb_lower") > C("kc_upper") - C("kc_lower"))
    return free & (C("close") > C("bb_mid")), free & (C("close") < C("bb_mid"))


preset("BB_SQUEEZE", lambda o: [use("bbands", length=o["length"], std=o["bb_std"]),
                                use("keltner", length=o["length"], multiplier=o["kc_mult"])], _squeeze,
       length=20, bb_std=2.0, kc_mult=1.5)


def rsi_use(o):
    return use("rsi", length=o["rsi_length"])


def _rsi_macd(p, o):
    up, down = macd_cross(p)
    return (C("rsi") < o["rsi_oversold"]) & up, yes(C("rsi") > o["rsi_overbought"]) | down


preset("RSI_MACD", lambda o: [rsi_use(o), macd_use(o)], _rsi_macd, **RSI_P, **MACD_P)


def _rsi_bb(p, o):
    return ((C("rsi") < o["rsi_oversold"]) & (C("close") <= C("bb_lower")),
            yes(C("rsi") > o["rsi_overbought"]) | yes(C("close") >= C("bb_upper")))


BB_RSI_USES = lambda o: [rsi_use(o), use("bbands", length=o["bb_length"], std=o["bb_std"])]
preset("RSI_BB", BB_RSI_USES, _rsi_bb, bb_length=20, bb_std=2.0, **RSI_P)


def _rsi_stoch(p, o):
    return ((C("rsi") < o["rsi_oversold"]) & (C("stoch_k") < o["stoch_oversold"]),
            yes(C("rsi") > o["rsi_overbought"]) | yes(C("stoch_k") > o["stoch_overbought"]))


preset("RSI_STOCH", lambda o: [rsi_use(o), use("stoch", k=o["stoch_k"], d=o["stoch_d"], smooth_k=3)], _rsi_stoch,
       stoch_k=14, stoch_d=3, stoch_oversold=20.0, stoch_overbought=80.0, **RSI_P)


def _rsi_volume(p, o):
    bull = p.tmp(yes(C("obv") > p.ema(C("obv"), o["obv_ema_length"])))
    return (C("rsi") < o["rsi_oversold"]) & bull, yes(C("rsi") > o["rsi_overbought"]) | ~bull


preset("RSI_VOLUME", lambda o: [rsi_use(o), use("obv")], _rsi_volume, lambda o: [o["obv_ema_length"]],
       obv_ema_length=20, **RSI_P)


def macd_and(cond):
    def logic(p, o):
        up, down = macd_cross(p)
        return up & cond(o), down
    return logic


preset("MACD_ADX", lambda o: [macd_use(o), use("adx", length=o["adx_length"])],
       macd_and(lambda o: C("adx") > o["adx_threshold"]), adx_length=14, adx_threshold=20.0, **MACD_P)
preset("MACD_STOCH", lambda o: [macd_use(o), use("stoch", k=o["stoch_k"], d=3, smooth_k=3)],
       macd_and(lambda o: C("stoch_k") < o["stoch_oversold"]), stoch_k=14, stoch_oversold=30.0, **MACD_P)
preset("MACD_VOLUME", lambda o: [macd_use(o), use("cmf", length=o["cmf_length"])],
       macd_and(lambda o: C("cmf") > 0), cmf_length=20, **MACD_P)


def _macd_psar(p, o):
    up, down = macd_cross(p)
    return up & (C("close") > C("psar")), down | edge_off(p, C("close") > C("psar"))


preset("MACD_PSAR", lambda o: [macd_use(o), use("psar", step=o["psar_step"], max_step=o["psar_max"])], _macd_psar,
       psar_step=0.02, psar_max=0.2, **MACD_P)


def st_use(o):
    return use("supertrend", length=o["st_length"], multiplier=o["st_mult"])


def _st_macd(p, o):
    bull = p.tmp(yes(C("supertrend_dir") == 1))
    pos = yes(C("macd_hist") > 0)
    fresh = bull & ~prev_flag(p, bull) & pos
    later = bull & yes(p.lag(C("macd_hist")) <= 0) & pos
    return fresh | later, ~bull & prev_flag(p, bull)


preset("ST_MACD", lambda o: [st_use(o), macd_use(o)], _st_macd, **ST_P, **MACD_P)


def st_confirmed(cond):
    """Trend up and confirmed, not both one bar before (an unknown earlier confirmation counts)."""
    def logic(p, o):
        bull, ok = p.tmp(yes(C("supertrend_dir") == 1)), p.tmp(yes(cond(o)))
        return bull & ok & ~(prev_flag(p, bull) & prev_flag(p, ok, True)), ~bull & prev_flag(p, bull)
    return logic


preset("ST_RSI", lambda o: [st_use(o), rsi_use(o)], st_confirmed(lambda o: C("rsi") < o["rsi_overbought"]),
       rsi_length=14, rsi_overbought=70.0, **ST_P)
preset("ST_VOLUME", lambda o: [st_use(o), use("cmf", length=o["cmf_length"])], st_confirmed(lambda o: C("cmf") > 0),
       cmf_length=20, **ST_P)
preset("DC_ADX", lambda o: [use("donchian", length=o["dc_length"]), use("adx", length=o["adx_length"])],
       lambda p, o: ((C("close") >= C("dc_upper")) & (C("adx") > o["adx_threshold"]), C("close") <= C("dc_lower")),
       dc_length=20, adx_length=14, adx_threshold=25.0)
preset("BB_RSI", BB_RSI_USES, _rsi_bb, bb_length=20, bb_std=2.0, **RSI_P)


def _vwap_rsi(p, o):
    above = C("close") > C("vwap")
    return edge(p, above) & (C("rsi") < o["rsi_overbought"]), edge_off(p, above)


preset("VWAP_RSI", lambda o: [use("vwap", length=o["vwap_length"]), rsi_use(o)], _vwap_rsi,
       vwap_length=14, rsi_length=14, rsi_overbought=70.0)
preset("VWAP_MACD", lambda o: [use("vwap", length=o["vwap_length"]), macd_use(o)],
       macd_and(lambda o: C("close") > C("vwap")), vwap_length=14, **MACD_P)


def _adx_stoch(p, o):
    di = C("plus_di") > C("minus_di")
    return ((C("adx") > o["adx_threshold"]) & yes(di) & cross_above(p, C("stoch_k"), o["stoch_oversold"]),
            edge_off(p, di))


preset("ADX_STOCH", lambda o: [use("adx", length=o["adx_length"]), use("stoch", k=o["stoch_k"], d=3, smooth_k=3)],
       _adx_stoch, adx_length=14, adx_threshold=25.0, stoch_k=14, stoch_oversold=25.0)
preset("KC_RSI", lambda o: [use("keltner", length=o["kc_length"], multiplier=o["kc_mult"]), rsi_use(o)],
       lambda p, o: ((C("close") > C("kc_upper")) & (C("rsi") > o["rsi_min"]), C("close") < C("kc_lower")),
       kc_length=20, kc_mult=2.0, rsi_length=14, rsi_min=50.0)
preset("AROON_ADX", lambda o: [use("aroon", length=o["aroon_length"]), use("adx", length=o["adx_length"])],
       both_edges(lambda o: (C("aroon_up") > o["aroon_thresh"]) & (C("aroon_down") < 100 - o["aroon_thresh"])
                  & (C("adx") > o["adx_threshold"])),
       aroon_length=25, aroon_thresh=70.0, adx_length=14, adx_threshold=20.0)
preset("MFI_CMF", lambda o: [use("mfi", length=o["mfi_length"]), use("cmf", length=o["cmf_length"])],
       lambda p, o: (cross_above(p, C("mfi"), o["mfi_oversold"]) & (C("cmf") > 0),
                     (C("cmf") < 0) & (F.coalesce(p.lag(C("cmf")), F.lit(0.0)) >= 0)),
       mfi_length=14, mfi_oversold=25.0, cmf_length=20)


def preset_flags(bars: DataFrame, key: Sequence[str], name: str, size: int = BLOCK, **params) -> DataFrame:
    """Entry/exit flags of one preset.  Unknown parameters are ignored."""
    pr = PRESETS[name]
    o = {**pr.params, **{k: v for k, v in params.items() if k in pr.params}}
    uses = pr.uses(o)
    bars = prepare_all(bars, key, uses, size)
    lengths = pr.scans(o)
    extra = 3 + max([ema_halo(n) for n in lengths], default=0) + int(o.get("lookback", 0))
    p = open_panel(bars, key, uses, extra=extra, size=size, decays=[ema_decay(n) for n in lengths])
    entry, exit_ = pr.logic(p, o)
    return flags_from(p, entry, exit_)


def preset_signals(bars: DataFrame, key: Sequence[str], name: str, invest: float = 1000.0, qty: float = 0.01,
                   size: int = BLOCK, **params) -> DataFrame:
    return signals_from_masks(preset_flags(bars, key, name, size, **params), key, invest, qty, size)


def _batches(names: Sequence[str]) -> list[list[str]]:
    """Group presets so that one output column never needs two parameter sets."""
    groups: list[tuple[dict, list[str]]] = []
    for n in names:
        need = {u.key + u.suffix: tuple(sorted(u.clean.items())) for u in PRESETS[n].uses(PRESETS[n].params)}
        for have, members in groups:
            if all(have.get(k, v) == v for k, v in need.items()):
                have.update(need)
                members.append(n)
                break
        else:
            groups.append((dict(need), [n]))
    return [m for _, m in groups]


def preset_flags_many(bars: DataFrame, key: Sequence[str], names: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Flags of several presets, long form (``strategy``); shared indicators are built once."""
    out = None
    for batch in _batches(names):
        uses = list({u.key + u.suffix: u for n in batch for u in PRESETS[n].uses(PRESETS[n].params)}.values())
        d = prepare_all(bars, key, uses, size)
        lengths = [x for n in batch for x in PRESETS[n].scans(PRESETS[n].params)]
        extra = 25 + max([ema_halo(x) for x in lengths], default=0)
        p = open_panel(d, key, uses, extra=extra, size=size, decays=[ema_decay(x) for x in lengths])
        pairs = []
        for n in batch:
            e, x = PRESETS[n].logic(p, dict(PRESETS[n].params))
            p.put(f"e_{n}", yes(e))
            p.put(f"x_{n}", yes(x))
            pairs.append(f"'{n}', `e_{n}`, `x_{n}`")
        part = p.close(keep_temps=True).selectExpr(
            *key, "rn", "ts", "close", f"stack({len(batch)}, {', '.join(pairs)}) as (strategy, entry, exit)")
        out = part if out is None else out.unionByName(part)
    return out
