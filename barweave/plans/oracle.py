"""SQL texts of the indicators, used by the expected results of indicator and signal queries.

Recursive averages are written as recursive queries over row numbers, which is independent of
how the Spark side computes them.
"""

from __future__ import annotations

from .registry import OVER


def frame(length: int) -> str:
    return f"({OVER} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"


def lag(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) OVER ({OVER})"


def roll(fn: str, c: str, length: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(length)} = {length} THEN {fn}({c}) OVER {frame(length)} END"


def wma(c: str, length: int) -> str:
    f = frame(length)
    return (f"CASE WHEN count({c}) OVER {f} = {length} THEN (sum(rn * {c}) OVER {f} - (rn - {length}) * sum({c}) OVER {f}) / {length * (length + 1) / 2} END")


TP = "((high + low + close) / 3.0)"


class Sql:
    """Collects common table expressions; ``src`` is a table with symbol, rn and the inputs."""

    def __init__(self, src: str = "bars"):
        self.src, self.ctes, self.n = src, [], 0

    def name(self) -> str:
        self.n += 1
        return f"c{self.n}"

    def add(self, body: str, name: str | None = None) -> str:
        name = name or self.name()
        self.ctes.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def table(self, cols: dict[str, str], src: str | None = None) -> str:
        """A table with symbol, rn and the given expressions."""
        return self.add(f"SELECT symbol, rn, {', '.join(f'{e} AS "{n}"' for n, e in cols.items())} FROM {src or self.src}")

    def ema(self, src: str, col: str, length: int, first: int = 1) -> str:
        """Exponential average as column ``y``; ``first`` is the row of the first value."""
        n, a = self.name(), 2.0 / (length + 1.0)
        self.ctes.append(f"{n}(symbol, rn, y) AS (SELECT symbol, rn, {col} FROM {src} WHERE rn = {first} UNION ALL SELECT s.symbol, s.rn, e.y + {a!r} * (s.{col} - e.y) FROM {n} e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)")
        return n

    def rma(self, src: str, col: str, length: int, first: int) -> str:
        n = self.name()
        self.ctes.append(f"{n}(symbol, rn, y) AS (SELECT symbol, {first + length - 1}::BIGINT, avg({col}) FROM {src} WHERE rn BETWEEN {first} AND {first + length - 1} GROUP BY symbol UNION ALL "
                         f"SELECT s.symbol, s.rn, (e.y * {length - 1} + coalesce(s.{col}, 0)) / {length} FROM {n} e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)")
        return n

    def join(self, parts: dict[str, tuple[str, str]], base: str | None = None, keep: str = "") -> str:
        """Left-join ``name -> (table, column)`` onto symbol, rn of the base."""
        b = base or self.src
        cols = ", ".join(f"t{i}.{c} AS {n}" for i, (n, (t, c)) in enumerate(parts.items()))
        js = " ".join(f"LEFT JOIN {t} t{i} ON t{i}.symbol = b.symbol AND t{i}.rn = b.rn" for i, (t, _) in enumerate(parts.values()))
        return self.add(f"SELECT b.symbol, b.rn, {keep}{cols} FROM {b} b {js}")

    # -------------------------------------------------------------- indicators: table + outputs

    def tr(self) -> str:
        return self.table({"tr": f"greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')}))"})

    def indicator(self, key: str, o: dict, sfx: str = "") -> tuple[str, list[str]]:
        t, outs = getattr(self, f"i_{key}")(**o)
        if sfx:
            t = self.add(f"SELECT symbol, rn, {', '.join(f'"{x}" AS "{x}{sfx}"' for x in outs)} FROM {t}")
            outs = [x + sfx for x in outs]
        return t, outs

    def i_sma(self, length):
        return self.table({"sma": roll("avg", "close", length)}), ["sma"]

    def i_ema(self, length):
        return self.join({"ema": (self.ema(self.src, "close", length), "y")}), ["ema"]

    def i_wma(self, length):
        return self.table({"wma": wma("close", length)}), ["wma"]

    def i_hma(self, length):
        root = max(1, int(round(length ** 0.5)))
        t = self.table({"raw": f"2 * {wma('close', max(1, length // 2))} - {wma('close', length)}"})
        return self.table({"hma": wma("raw", root)}, t), ["hma"]

    def i_vwap(self, length):
        f = frame(length)
        return self.table({"vwap": f"sum({TP} * volume) OVER {f} / nullif(sum(volume) OVER {f}, 0)"}), ["vwap"]

    def i_rsi(self, length):
        d = f"(close - {lag('close')})"
        t = self.table({"up": f"CASE WHEN {d} IS NOT NULL THEN greatest({d}, 0) END", "dn": f"CASE WHEN {d} IS NOT NULL THEN greatest(-{d}, 0) END"})
        j = self.join({"g": (self.rma(t, "up", length, 2), "y"), "l": (self.rma(t, "dn", length, 2), "y")})
        return self.table({"rsi": "CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END"}, j), ["rsi"]

    def i_macd(self, fast, slow, signal):
        j = self.join({"f": (self.ema(self.src, "close", fast), "y"), "s": (self.ema(self.src, "close", slow), "y")})
        m = self.table({"m": "f - s"}, j)
        k = self.join({"m": (m, "m"), "sg": (self.ema(m, "m", signal), "y")})
        return self.table({"macd": "m", "macd_signal": "sg", "macd_hist": "m - sg"}, k), ["macd", "macd_signal", "macd_hist"]

    def i_stoch(self, k, d, smooth_k):
        ll, hh = roll("min", "low", k), roll("max", "high", k)
        t = self.table({"raw": f"100 * (close - ({ll})) / nullif(({hh}) - ({ll}), 0)"})
        t = self.table({"stoch_k": roll("avg", "raw", smooth_k)}, t)
        return self.table({"stoch_k": "stoch_k", "stoch_d": roll("avg", "stoch_k", d)}, t), ["stoch_k", "stoch_d"]

    def i_cci(self, length):
        t = self.table({"tp": TP})
        t = self.table({"tp": "tp", "ma": roll("avg", "tp", length)}, t)
        t = self.table({"tp": "tp", "ma": "ma", "dev": "abs(tp - ma)"}, t)
        return self.table({"cci": f"(tp - ma) / (0.015 * nullif({roll('avg', 'dev', length)}, 0))"}, t), ["cci"]

    def i_roc(self, length):
        return self.table({"roc": f"100 * (close - {lag('close', length)}) / {lag('close', length)}"}), ["roc"]

    def i_mom(self, length):
        return self.table({"mom": f"close - {lag('close', length)}"}), ["mom"]

    def i_willr(self, length):
        hh, ll = roll("max", "high", length), roll("min", "low", length)
        return self.table({"willr": f"-100 * (({hh}) - close) / nullif(({hh}) - ({ll}), 0)"}), ["willr"]

    def i_tsi(self, fast, slow):
        t = self.table({"m": f"close - {lag('close')}", "am": f"abs(close - {lag('close')})"})
        a = self.ema(self.ema(t, "m", slow, 2), "y", fast, 2)
        b = self.ema(self.ema(t, "am", slow, 2), "y", fast, 2)
        return self.table({"tsi": "100 * a / nullif(b, 0)"}, self.join({"a": (a, "y"), "b": (b, "y")})), ["tsi"]

    def i_adx(self, length):
        up, dn = f"(high - {lag('high')})", f"({lag('low')} - low)"
        t = self.table({"p": f"CASE WHEN {up} IS NULL THEN NULL WHEN {up} > {dn} AND {up} > 0 THEN {up} ELSE 0 END", "m": f"CASE WHEN {dn} IS NULL THEN NULL WHEN {dn} > {up} AND {dn} > 0 THEN {dn} ELSE 0 END"})
        j = self.join({"a": (self.rma(self.tr(), "tr", length, 1), "y"), "p": (self.rma(t, "p", length, 2), "y"), "m": (self.rma(t, "m", length, 2), "y")})
        j = self.table({"pdi": "100 * p / nullif(a, 0)", "mdi": "100 * m / nullif(a, 0)"}, j)
        j = self.table({"pdi": "pdi", "mdi": "mdi", "dx": "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)"}, j)
        k = self.join({"adx": (self.rma(j, "dx", length, length + 1), "y"), "plus_di": (j, "pdi"), "minus_di": (j, "mdi")})
        return k, ["adx", "plus_di", "minus_di"]

    def i_aroon(self, length):
        f = frame(length + 1)
        def at(col, fn):
            return (f"CASE WHEN count({col}) OVER {f} = {length + 1} THEN 100.0 * (list_position(list({col}) OVER {f}, {fn}({col}) OVER {f}) - 1) / {length} END")
        t = self.table({"u": at("high", "max"), "d": at("low", "min")})
        return self.table({"aroon_up": "u", "aroon_down": "d", "aroon_osc": "u - d"}, t), ["aroon_up", "aroon_down", "aroon_osc"]

    def i_supertrend(self, length, multiplier):
        a = self.rma(self.tr(), "tr", length, 1)
        j = self.join({"atr": (a, "y")}, keep="b.close, (b.high + b.low) / 2.0 AS mid, ")
        t = self.table({"close": "close", "u": f"mid + {multiplier} * atr", "l": f"mid - {multiplier} * atr"}, j)
        n = self.name()
        fu = "CASE WHEN e.fu IS NULL OR s.u < e.fu OR e.c > e.fu THEN s.u ELSE e.fu END"
        fl = "CASE WHEN e.fl IS NULL OR s.l > e.fl OR e.c < e.fl THEN s.l ELSE e.fl END"
        way = f"CASE WHEN e.st IS NULL THEN 1.0 WHEN s.close > ({fu}) THEN 1.0 WHEN s.close < ({fl}) THEN -1.0 ELSE e.way END"
        self.ctes.append(f"{n}(symbol, rn, fu, fl, st, way, c) AS (SELECT symbol, rn, u, l, NULL::DOUBLE, 1.0::DOUBLE, close FROM {t} WHERE rn = 1 UNION ALL SELECT symbol, rn, fu, fl, CASE WHEN way = 1.0 THEN fl ELSE fu END, way, c FROM "
                         f"(SELECT s.symbol, s.rn, {fu} AS fu, {fl} AS fl, ({way})::DOUBLE AS way, s.close AS c FROM {n} e JOIN {t} s ON s.symbol = e.symbol AND s.rn = e.rn + 1))")
        return self.join({"supertrend": (n, "st"), "supertrend_dir": (n, "way")}), ["supertrend", "supertrend_dir"]

    def i_psar(self, step, max_step):
        n = self.name()
        raw = "e.sar + e.af * (e.ep - e.sar)"
        self.ctes.append(f"""{n}(symbol, rn, bull, af, ep, sar, h1, h2, l1, l2) AS (SELECT symbol, rn, true, {step}::DOUBLE, high, low, high, high, low, low FROM {self.src} WHERE rn = 1 UNION ALL
          SELECT symbol, rn, CASE WHEN flip THEN NOT bull ELSE bull END, CASE WHEN flip THEN {step} ELSE af2 END, CASE WHEN flip THEN (CASE WHEN bull THEN low ELSE high END) ELSE ep2 END, CASE WHEN flip THEN ep2 ELSE v END, high, h1, low, l1 FROM
          (SELECT *, CASE WHEN bull THEN low < v ELSE high > v END AS flip FROM (SELECT s.symbol, s.rn, s.high, s.low, e.bull, e.h1, e.l1,
             CASE WHEN e.bull THEN least({raw}, e.l1, e.l2) ELSE greatest({raw}, e.h1, e.h2) END AS v,
             CASE WHEN e.bull THEN greatest(e.ep, s.high) ELSE least(e.ep, s.low) END AS ep2,
             CASE WHEN (e.bull AND s.high > e.ep) OR (NOT e.bull AND s.low < e.ep) THEN least(e.af + {step}, {max_step}) ELSE e.af END AS af2
             FROM {n} e JOIN {self.src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)))""")
        return self.join({"psar": (n, "sar")}), ["psar"]

    def i_atr(self, length):
        return self.join({"atr": (self.rma(self.tr(), "tr", length, 1), "y")}), ["atr"]

    def i_bbands(self, length, std):
        t = self.table({"m": roll("avg", "close", length), "sd": roll("stddev_pop", "close", length)})
        return self.table({"bb_lower": f"m - {std} * sd", "bb_mid": "m", "bb_upper": f"m + {std} * sd", "bb_width": f"(2 * {std} * sd) / nullif(m, 0)"}, t), ["bb_lower", "bb_mid", "bb_upper", "bb_width"]

    def i_keltner(self, length, multiplier):
        j = self.join({"m": (self.ema(self.src, "close", length), "y"), "a": (self.rma(self.tr(), "tr", length, 1), "y")})
        return self.table({"kc_lower": f"m - {multiplier} * a", "kc_mid": "m", "kc_upper": f"m + {multiplier} * a"}, j), ["kc_lower", "kc_mid", "kc_upper"]

    def prev(self, length):
        f = f"({OVER} ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
        full = f"count(high) OVER {f} = {length}"
        return f"CASE WHEN {full} THEN max(high) OVER {f} END", f"CASE WHEN {full} THEN min(low) OVER {f} END"

    def i_donchian(self, length):
        hi, lo = self.prev(length)
        t = self.table({"h": hi, "l": lo})
        return self.table({"dc_lower": "l", "dc_mid": "(h + l) / 2.0", "dc_upper": "h"}, t), ["dc_lower", "dc_mid", "dc_upper"]

    def i_stdev(self, length):
        return self.table({"stdev": roll("stddev_pop", "close", length)}), ["stdev"]

    def i_obv(self):
        t = self.table({"f": f"sign(coalesce(close - {lag('close')}, 0)) * volume"})
        return self.table({"obv": f"sum(f) OVER ({OVER})"}, t), ["obv"]

    def i_mfi(self, length):
        t = self.table({"tp": TP, "volume": "volume"})
        t = self.table({"p": f"CASE WHEN tp - {lag('tp')} > 0 THEN tp * volume ELSE 0 END", "m": f"CASE WHEN tp - {lag('tp')} < 0 THEN tp * volume ELSE 0 END"}, t)
        return self.table({"mfi": f"100 - 100 / (1 + ({roll('sum', 'p', length)}) / nullif({roll('sum', 'm', length)}, 0))"}, t), ["mfi"]

    def i_cmf(self, length):
        t = self.table({"v": "volume", "f": "((close - low) - (high - close)) / nullif(high - low, 0) * volume"})
        return self.table({"cmf": f"({roll('sum', 'f', length)}) / nullif({roll('sum', 'v', length)}, 0)"}, t), ["cmf"]

    def i_pivot(self, length):
        hi, lo = self.prev(length)
        t = self.table({"h": hi, "l": lo, "c": lag("close", length)})
        t = self.table({"h": "h", "l": "l", "p": "(h + l + c) / 3.0"}, t)
        return (self.table({"pivot": "p", "pivot_r1": "2 * p - l", "pivot_r2": "p + (h - l)", "pivot_s1": "2 * p - h", "pivot_s2": "p - (h - l)"}, t),
                ["pivot", "pivot_r1", "pivot_r2", "pivot_s1", "pivot_s2"])

    def i_orb(self, opening_candles):
        t = self.add(f"SELECT symbol, rn, high, low, ts::DATE AS day, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY rn) AS i FROM {self.src}")
        m = self.add(f"SELECT symbol, day, max(high) AS h, min(low) AS l FROM {t} WHERE i <= {opening_candles} GROUP BY symbol, day")
        return self.add(f"SELECT symbol, rn, CASE WHEN i > {opening_candles} THEN h END AS orb_high, CASE WHEN i > {opening_candles} THEN l END AS orb_low FROM {t} JOIN {m} USING (symbol, day)"), ["orb_high", "orb_low"]

    def i_ichimoku(self, tenkan, kijun, senkou_b):
        mid = lambda n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2.0"
        t = self.table({"t": mid(tenkan), "k": mid(kijun), "b": mid(senkou_b)})
        return (self.table({"tenkan_sen": "t", "kijun_sen": "k", "senkou_a": lag("(t + k) / 2.0", kijun), "senkou_b": lag("b", kijun)}, t),
                ["tenkan_sen", "kijun_sen", "senkou_a", "senkou_b"])


LATCH = """{n}(symbol, rn, state, px) AS (SELECT symbol, 0::BIGINT, 0, NULL::DOUBLE FROM {src} WHERE rn = 1 UNION ALL
  SELECT s.symbol, s.rn, CASE WHEN e.state = 0 AND s.entry THEN 1 WHEN e.state = 1 AND s."exit" THEN 0 ELSE e.state END, CASE WHEN e.state = 0 AND s.entry THEN s.close ELSE e.px END
  FROM {n} e JOIN {src} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


def latch_tail(src: str, invest: float = 1000.0) -> tuple[list[str], str]:
    """Recursive latch over ``src(symbol, rn, ts, close, entry, exit)`` -> table ``signals``."""
    sig = f"""signals AS MATERIALIZED (SELECT s.symbol, s.rn, s.ts, s.close, CASE WHEN e.state = 1 AND p.state = 0 THEN 'BUY' WHEN e.state = 0 AND p.state = 1 THEN 'SELL' ELSE 'HOLD' END AS signal,
      CASE WHEN e.state <> p.state THEN {invest} / e.px ELSE 0.0 END AS quantity FROM {src} s JOIN latch e ON e.symbol = s.symbol AND e.rn = s.rn JOIN latch p ON p.symbol = s.symbol AND p.rn = s.rn - 1)"""
    return [LATCH.format(n="latch", src=src), sig], "signals"
