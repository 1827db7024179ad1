"""Every indicator over the event bars, with its catalog and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..sources.tables import event_bars, event_ticks
from .oracle import Sql
from .registry import OVER, bars_cte, fin, query, r, rx

K = ["symbol"]
# 4-hour bars where hourly ones have too many single-tick bars to define the value
COARSE = {"cmf"}
# a length whose division never ends keeps values away from rounding ties
CHOSEN = {"supertrend": {"length": 7}}


def _register(key: str) -> None:
    params = I.clamp(key, CHOSEN.get(key, {}))
    unit = "4h" if key in COARSE else "hour"
    q = Sql()
    t, outs = q.indicator(key, params)
    sql = f"WITH RECURSIVE {bars_cte(unit)}, {', '.join(q.ctes)} SELECT b.symbol, b.ts, {r(*outs)} FROM bars b JOIN {t} t USING (symbol, rn)"

    @query(f"ind_{key}", sql)
    def run(s, d):
        bars = event_bars(s, d, "4h" if key in COARSE else "1h")
        return fin(I.compute(bars, ["symbol"], key, **params), "symbol", "ts", *I.REGISTRY[key].outputs)


for _key in I.REGISTRY:
    _register(_key)


WINDOW_KEYS = [k for k, i in I.REGISTRY.items() if i.build]


def _null_cells(keys, unit="hour"):
    q = Sql()
    rows = []
    for k in keys:
        t, outs = q.indicator(k, I.clamp(k, {}))
        rows += [f"""SELECT symbol, count(*) AS rows, '{o}' AS output, round(avg(CASE WHEN "{o}" IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_fraction FROM {t} GROUP BY symbol""" for o in outs]
    return f"WITH RECURSIVE {bars_cte(unit)}, {', '.join(q.ctes)} {' UNION ALL '.join(rows)}"


@query("indicator_coverage", _null_cells(["sma", "wma", "hma", "vwap", "stoch", "cci", "roc", "willr", "bbands", "donchian", "mfi", "pivot", "ichimoku", "stdev"]))
def _(s, d):
    keys = ["sma", "wma", "hma", "vwap", "stoch", "cci", "roc", "willr", "bbands", "donchian", "mfi", "pivot", "ichimoku", "stdev"]
    b = I.compute_all(event_bars(s, d), ["symbol"], [I.use(k) for k in keys])
    return fin(I.coverage_report(b, [o for k in keys for o in I.REGISTRY[k].outputs]))


def _catalog_sql():
    q, parts = Sql(), []
    for k, i in I.REGISTRY.items():
        t, outs = q.indicator(k, I.clamp(k, {}))
        share = " + ".join(f"""avg(CASE WHEN "{o}" IS NULL THEN 1.0 ELSE 0.0 END)""" for o in outs)
        label, group = i.label.replace("'", "''"), i.group.replace("'", "''")
        parts.append(f"""SELECT b.symbol, count(*) AS rows, '{k}' AS key, '{label}' AS label, '{group}' AS grp, '{", ".join(outs)}' AS expected, '' AS missing, {rx(f"({share}) / {len(outs)}", "null_fraction")}, 'PASS' AS status FROM bars b LEFT JOIN {t} t USING (symbol, rn) GROUP BY b.symbol""")
    return f"WITH RECURSIVE {bars_cte('4h')}, {', '.join(q.ctes)} {' UNION ALL '.join(parts)}"


@query("catalog_report", _catalog_sql())
def _(s, d):
    b = I.compute_all(event_bars(s, d, "4h"), K, [I.use(k) for k in I.REGISTRY])
    return fin(I.catalog_report(b, K))


WINDOW_OUTPUTS = [o for k in WINDOW_KEYS for o in I.REGISTRY[k].outputs]


def _all_sql():
    q, parts = Sql(), {}
    for k in WINDOW_KEYS:
        t, outs = q.indicator(k, I.clamp(k, {}))
        parts.update({f'"{o}"': (t, f'"{o}"') for o in outs})
    j = q.join(parts, keep="b.ts, ")
    return f"WITH RECURSIVE {bars_cte()}, {', '.join(q.ctes)} SELECT symbol, ts, {r(*WINDOW_OUTPUTS)} FROM {j}"


@query("indicators_one_pass", _all_sql())
def _(s, d):
    """All window-class indicators in one shuffle and one sort."""
    return fin(I.compute_all(event_bars(s, d), ["symbol"], [I.use(k) for k in WINDOW_KEYS]), "symbol", "ts", *WINDOW_OUTPUTS)


@query("missing_outputs", "SELECT DISTINCT event_type AS symbol, key, output FROM events, (VALUES ('ema', 'ema'), ('rsi', 'rsi')) v(key, output)")
def _(s, d):
    have = I.compute_all(event_bars(s, d), ["symbol"], [I.use("sma"), I.use("macd")])
    cat = I.catalog(s).filter(F.col("key").isin("sma", "macd", "ema", "rsi"))
    # one row per series and missing output
    gaps = F.array(*[F.struct(F.lit(r.key).alias("key"), F.lit(r.output).alias("output")) for r in I.missing_outputs(have, cat).collect()])     # rows of the fixed catalog
    return event_ticks(s, d).select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.explode(gaps).alias("g")).select("symbol", "g.key", "g.output")


def _block(sql_cols, src="bars"):
    return f"WITH {bars_cte()} SELECT symbol, ts, {sql_cols} FROM {src}"


@query("true_range", _block(rx("greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))", "tr"), f"bars WINDOW w AS ({OVER})"))
def _(s, d):
    p = I.Panel(event_bars(s, d), ["symbol"], 1, I.BLOCK)
    p.put("tr", p.true_range())
    return fin(p.close(), "symbol", "ts", "tr")


_q = Sql()
_t = _q.rma("bars", "close", 14, 1)


@query("wilder_average", f"WITH RECURSIVE {bars_cte()}, {', '.join(_q.ctes)} SELECT b.symbol, b.ts, {rx('t.y', 'y')} FROM bars b LEFT JOIN {_t} t USING (symbol, rn)")
def _(s, d):
    p = I.Panel(event_bars(s, d), ["symbol"], I.rma_halo(14), 2000, decays=[I.rma_decay(14)])
    p.put("y", p.rma(F.col("close"), 14))
    return fin(p.close(), "symbol", "ts", "y")


# small blocks on the longer daily series: the carried state and the halo really matter here
def _small(key, params, size):
    from ..sources.tables import order_bars
    from .registry import daily_cte
    q = Sql()
    t, outs = q.indicator(key, params)

    @query(f"ind_{key}_blocks", f"WITH RECURSIVE {daily_cte()}, {', '.join(q.ctes)} SELECT b.symbol, b.ts, {r(*outs)} FROM bars b JOIN {t} t USING (symbol, rn)")
    def run(s, d):
        return fin(I.compute(order_bars(s, d), ["symbol"], key, size=size, **params), "symbol", "ts", *I.REGISTRY[key].outputs)


for _k, _p in (("ema", {"length": 20}), ("rsi", {"length": 7}), ("macd", {"fast": 5, "slow": 9, "signal": 4}), ("adx", {"length": 5}), ("supertrend", {"length": 7, "multiplier": 2.0}), ("psar", {"step": 0.02, "max_step": 0.2})):
    _small(_k, _p, 100)
