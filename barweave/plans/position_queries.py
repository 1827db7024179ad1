"""Round trips, ledgers, metrics, regimes and out-of-sample validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import positions as P
from ..operators import regimes as R
from ..operators import signals as G
from ..operators import sweep as W
from ..operators import validation as V
from ..operators.presets import preset_flags
from ..session import stage
from ..sources.bars import write_results
from ..sources.tables import event_bars, fills, order_bars, raw_bars
from .oracle import Sql, lag, latch_tail, roll
from .registry import ORACLE, OVER, bars_cte, daily_cte, fin, query, r, rx, secs
from .signal_queries import K, SMA_SIGNALS, flags_sql, params_of

CAP = 100_000.0


def signals(s, d):
    return stage(G.signals_from_masks(preset_flags(event_bars(s, d), K, "SMA_CROSS"), K))


# ------------------------------------------------------------------ trades

TRADES = SMA_SIGNALS + """, ev AS (SELECT *, lead(ts) OVER w AS xt, lead(close) OVER w AS xc, sum(CASE WHEN signal = 'BUY' THEN 1 ELSE 0 END) OVER w AS no FROM signals WHERE signal <> 'HOLD' WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
  lastbar AS (SELECT symbol, max(ts) AS lt, last(close ORDER BY rn) AS lc, max(rn) AS ln FROM bars GROUP BY symbol),
  t0 AS (SELECT symbol, CAST(no AS BIGINT) AS trade_no, ts AS entry_time, close * 1.001 AS entry_price, coalesce(xt, lt) AS exit_time, coalesce(xc, lc) * 0.999 AS exit_price, quantity AS q, xt IS NULL AS open_end FROM ev JOIN lastbar USING (symbol) WHERE signal = 'BUY'),
  t1 AS (SELECT *, round(entry_price * q * 0.001, 4) + round(exit_price * q * 0.001, 4) AS fees FROM t0),
  trades AS MATERIALIZED (SELECT symbol, trade_no, entry_time, entry_price, exit_time, exit_price, q AS quantity, (exit_price - entry_price) * q - fees AS pnl, ((exit_price - entry_price) * q - fees) / (entry_price * q) AS pnl_pct, fees, open_end FROM t1)"""
T_COLS = ["entry_price", "exit_price", "quantity", "pnl", "pnl_pct", "fees"]


@query("round_trips", f"WITH RECURSIVE {TRADES} SELECT symbol, trade_no, entry_time, exit_time, open_end, {r(*T_COLS)} FROM trades")
def _(s, d):
    return fin(P.round_trips(signals(s, d), K), "symbol", "trade_no", "entry_time", "exit_time", "open_end", *T_COLS)


def ledger_sql(sig: str) -> str:
    """Trades of signals in the CTE ``sig`` bar by bar: average cost, capped sales, entry fees by share."""
    return f""", sg AS MATERIALIZED (SELECT b.symbol, b.rn, b.ts, b.close, x.signal, x.quantity FROM bars b JOIN {sig} x ON x.symbol = b.symbol AND x.ts = b.ts),
  lg(symbol, rn, ts, close, held, cost, fees, opened, bought, sold, e, ef) AS (SELECT symbol, 0::BIGINT, ts, close, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::TIMESTAMP, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM sg WHERE rn = 1
    UNION ALL SELECT symbol, rn, ts, close, CASE WHEN h < 1e-10 THEN 0 ELSE h END, CASE WHEN h < 1e-10 THEN 0 WHEN sl > 0 THEN cost * (1 - sl / held) ELSE cost + bq * close * 1.001 END,
      CASE WHEN h < 1e-10 THEN 0 WHEN sl > 0 THEN fees * (1 - sl / held) ELSE fees + round(bq * close * 1.001 * 0.001, 4) END, CASE WHEN bq > 0 AND held = 0 THEN ts ELSE opened END, bq, sl, CASE WHEN sl > 0 THEN cost / held END, CASE WHEN sl > 0 THEN fees * sl / held END
    FROM (SELECT *, held + bq - sl AS h FROM (SELECT s.symbol, s.rn, s.ts, s.close, l.held, l.cost, l.fees, l.opened, CASE WHEN s.signal = 'BUY' THEN coalesce(s.quantity, 0) ELSE 0 END AS bq,
      CASE WHEN s.signal = 'SELL' THEN least(s.quantity, l.held) ELSE 0 END AS sl FROM lg l JOIN sg s ON s.symbol = l.symbol AND s.rn = l.rn + 1))),
  ls AS (SELECT symbol, rn, ts, close, opened, sold AS q, e, ef, false AS open_end FROM lg WHERE sold > 0 UNION ALL
    SELECT symbol, rn + 1, ts, close, opened, held, cost / held, fees, true FROM lg WHERE held > 0 AND rn = (SELECT max(rn) FROM sg WHERE sg.symbol = lg.symbol)),
  ltrades AS MATERIALIZED (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS trade_no, opened AS entry_time, e AS entry_price, ts AS exit_time, close * 0.999 AS exit_price, q AS quantity,
    (close * 0.999 - e) * q - ef - round(close * 0.999 * q * 0.001, 4) AS pnl, ((close * 0.999 - e) * q - ef - round(close * 0.999 * q * 0.001, 4)) / (e * q) AS pnl_pct, ef + round(close * 0.999 * q * 0.001, 4) AS fees, open_end FROM ls),
  leq AS MATERIALIZED (SELECT symbol, rn, ts, round({CAP} + sum(CASE WHEN bought > 0 THEN -(bought * close * 1.001 + round(bought * close * 1.001 * 0.001, 4)) WHEN sold > 0 THEN sold * close * 0.999 - round(sold * close * 0.999 * 0.001, 4) ELSE 0 END) OVER ({OVER})
      + CASE WHEN held <= 1e-9 THEN 0 WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN held * close * 0.999 - round(held * close * 0.999 * 0.001, 4) ELSE held * close END, 8) AS equity FROM lg WHERE rn > 0
    UNION ALL SELECT symbol, 0, min(ts), {CAP} FROM bars GROUP BY symbol)"""


def exact(name: str) -> str:
    """A signal query's SQL without its final rounding of quantities."""
    return ORACLE[name].replace(", 6) + 0.0 AS quantity", ", 15) AS quantity")


LEDGER_SIGNALS = {
    "grid": (f"WITH RECURSIVE {bars_cte()}, x AS ({exact('grid_signals')})", lambda s, d: G.grid_signals(event_bars(s, d), K, F.lit(105.0), F.lit(240.0), 7)),
    "dca": (f"WITH RECURSIVE {bars_cte()}, x AS ({exact('dca_signals')})", lambda s, d: G.dca_signals(event_bars(s, d), K, 6, 100.0, 2)),
    "pla": (f"WITH RECURSIVE {bars_cte()}, x AS ({exact('pla_take_profit')})", lambda s, d: G.pla_signals(event_bars(s, d), K, 9, 21, exit_type="take_profit")),
}


def _register_ledger(name: str) -> None:
    head, make = LEDGER_SIGNALS[name]
    sig = lambda s, d: stage(make(s, d))

    @query(f"trades_{name}", f"{head} {ledger_sql('x')} SELECT symbol, trade_no, entry_time, exit_time, open_end, {r(*T_COLS)} FROM ltrades")
    def _(s, d):
        return fin(P.round_trips(sig(s, d), K), "symbol", "trade_no", "entry_time", "exit_time", "open_end", *T_COLS)

    @query(f"equity_{name}", f"{head} {ledger_sql('x')} SELECT symbol, CAST(rn AS BIGINT) AS rn, ts, {rx('equity', 'equity')} FROM leq")
    def _(s, d):
        return fin(P.equity_curve(sig(s, d), K, CAP))


for _name in LEDGER_SIGNALS:
    _register_ledger(_name)


TS = """SELECT symbol, count(*) AS num_trades, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 2) AS win_rate, round(coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)), 4) AS profit_factor, round(avg(pnl), 4) AS avg_trade_pnl,
  round(max(pnl), 4) AS best_trade, round(min(pnl), 4) AS worst_trade, round(coalesce(sum(pnl) FILTER (pnl > 0), 0), 4) AS gross_profit, round(abs(coalesce(sum(pnl) FILTER (pnl < 0), 0)), 4) AS gross_loss,
  round(avg((epoch_us(exit_time) - epoch_us(entry_time)) / 3.6e9), 2) AS avg_trade_duration, round(count(*) / greatest(floor((epoch_us(max(exit_time)) - epoch_us(min(entry_time))) / 86400e6), 1), 4) AS trades_per_day FROM trades GROUP BY symbol"""


@query("trade_stats", f"WITH RECURSIVE {TRADES} {TS}")
def _(s, d):
    return M.trade_stats(P.round_trips(signals(s, d), K), K)


@query("trade_log_summary", f"WITH RECURSIVE {TRADES} SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS winners, {rx('sum(pnl)', 'total_pnl')}, {rx('max(pnl)', 'best')}, {rx('min(pnl)', 'worst')} FROM trades GROUP BY symbol")
def _(s, d):
    return fin(P.trade_log_summary(P.round_trips(signals(s, d), K), K))


@query("apply_lots", f"WITH RECURSIVE {SMA_SIGNALS} SELECT symbol, ts, CASE WHEN signal = 'BUY' AND floor(quantity / 6) * 6 <= 0 THEN 'HOLD' ELSE signal END AS signal, signal = 'BUY' AND floor(quantity / 6) * 6 <= 0 AS lot_skipped, "
       "CASE WHEN signal = 'BUY' AND floor(quantity / 6) * 6 <= 0 THEN 0.0 WHEN signal = 'SELL' AND floor(quantity / 6) * 6 <= 0 THEN 6.0 ELSE floor(quantity / 6) * 6 END AS lot_quantity FROM signals")
def _(s, d):
    return P.apply_lots(signals(s, d), 6).select("symbol", "ts", "signal", "lot_skipped", "lot_quantity")


@query("bar_timeline", f"""WITH RECURSIVE {TRADES}, c AS (SELECT symbol, exit_time AS ts, max(trade_no) AS c, last(pnl ORDER BY trade_no) AS p FROM trades GROUP BY 1, 2)
   SELECT b.symbol, b.ts, CAST(coalesce(c.c, o.trade_no) AS DOUBLE) AS trade_no, CASE WHEN c.c IS NOT NULL THEN 'closed' WHEN o.trade_no IS NOT NULL THEN 'opened' END AS event, {rx('c.p', 'closed_pnl')}
   FROM bars b LEFT JOIN trades o ON o.symbol = b.symbol AND o.entry_time = b.ts LEFT JOIN c ON c.symbol = b.symbol AND c.ts = b.ts""")
def _(s, d):
    t = P.bar_timeline(raw_bars(s, d), P.round_trips(signals(s, d), K), K)
    return fin(t, "symbol", "ts", F.col("trade_no").cast("double").alias("trade_no"), "event", "closed_pnl")


# ------------------------------------------------------------------ equity and metrics

EQUITY = SMA_SIGNALS + f""", fl AS (SELECT *, quantity * close * CASE WHEN signal = 'BUY' THEN 1.001 ELSE 0.999 END AS g FROM signals),
  f2 AS (SELECT *, CASE signal WHEN 'BUY' THEN -(g + round(g * 0.001, 4)) WHEN 'SELL' THEN g - round(g * 0.001, 4) ELSE 0 END AS flow, CASE signal WHEN 'BUY' THEN quantity WHEN 'SELL' THEN -quantity ELSE 0 END AS mv FROM fl),
  f3 AS (SELECT symbol, rn, ts, close, sum(flow) OVER ({OVER}) AS cash, sum(mv) OVER ({OVER}) AS pos, rn = max(rn) OVER (PARTITION BY symbol) AS fin FROM f2),
  eqs AS MATERIALIZED (SELECT symbol, rn, ts, round({CAP} + cash + CASE WHEN abs(pos) > 1e-9 THEN CASE WHEN fin THEN pos * close * 0.999 - round(pos * close * 0.999 * 0.001, 4) ELSE pos * close END ELSE 0 END, 8) AS equity FROM f3
     UNION ALL SELECT symbol, 0, min(ts), {CAP} FROM bars GROUP BY symbol),
  cpd AS (SELECT symbol, greatest(1.0 / 31, 86400 / median(g)) AS cpd FROM (SELECT symbol, {secs('ts')} - lag({secs('ts')}) OVER ({OVER}) AS g FROM bars WHERE rn <= 50) GROUP BY symbol)"""


def equity(s, d, sig=None):
    return stage(P.equity_curve(sig if sig is not None else signals(s, d), K, CAP))


@query("equity_curve", f"WITH RECURSIVE {EQUITY} SELECT symbol, CAST(rn AS BIGINT) AS rn, ts, {rx('equity', 'equity')} FROM eqs")
def _(s, d):
    return fin(P.equity_curve(signals(s, d), K, CAP))


@query("candles_per_day", f"WITH RECURSIVE {EQUITY} SELECT symbol, {rx('cpd', 'cpd')} FROM cpd")
def _(s, d):
    return fin(M.candles_per_day(event_bars(s, d), K))


DD = EQUITY + f""", dd AS (SELECT *, max(equity) OVER ({OVER}) AS peak, (equity - max(equity) OVER ({OVER})) / max(equity) OVER ({OVER}) AS drawdown, equity / lag(equity) OVER ({OVER}) - 1 AS ret FROM eqs)"""


@query("drawdowns", f"WITH RECURSIVE {DD} SELECT symbol, CAST(rn AS BIGINT) AS rn, {r('equity', 'peak', 'drawdown')} FROM dd")
def _(s, d):
    return fin(M.drawdowns(equity(s, d), K), "symbol", "rn", "equity", "peak", "drawdown")


@query("dd_duration", f"""WITH RECURSIVE {DD}, g AS (SELECT symbol, rn, drawdown, rn - row_number() OVER (PARTITION BY symbol, drawdown < 0 ORDER BY rn) AS isle FROM dd)
   SELECT symbol, max(c) AS max_dd_duration_candles FROM (SELECT symbol, isle, count(*) AS c FROM g WHERE drawdown < 0 GROUP BY 1, 2) GROUP BY symbol""")
def _(s, d):
    return M.dd_duration(M.drawdowns(equity(s, d), K), K)


PERF = DD + f""", pf AS (SELECT symbol, first(equity ORDER BY rn) AS e0, last(equity ORDER BY rn) AS e1, count(*) AS n, avg(ret) AS mr, stddev_pop(ret) AS sr, CASE WHEN count(*) FILTER (ret < 0) > 1 THEN stddev_pop(ret) FILTER (ret < 0) ELSE 1e-10 END AS ds, min(drawdown) AS mdd FROM dd GROUP BY symbol),
  pg AS (SELECT *, pow(e1 / e0, 252.0 / greatest(n / cpd, 1)) - 1 AS ann FROM pf JOIN cpd USING (symbol)),
  perf AS MATERIALIZED (SELECT symbol, round((e1 / e0 - 1) * 100, 4) AS total_return_pct, round(ann * 100, 4) AS annualised_return_pct, round(CASE WHEN sr > 1e-10 THEN mr / sr * sqrt(252 * cpd) ELSE 0 END, 4) AS sharpe_ratio,
    round(CASE WHEN ds > 1e-10 THEN mr / ds * sqrt(252 * cpd) ELSE 0 END, 4) AS sortino_ratio, round(CASE WHEN abs(mdd) > 1e-10 THEN ann / abs(mdd) ELSE 0 END, 4) AS calmar_ratio, round(sr * sqrt(252 * cpd) * 100, 4) AS volatility_pct, round(mdd * 100, 4) AS max_drawdown_pct, round(e1, 4) AS final_equity FROM pg)"""
P_COLS = ["total_return_pct", "annualised_return_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "volatility_pct", "max_drawdown_pct", "final_equity"]


@query("performance", f"WITH RECURSIVE {PERF} SELECT symbol, {', '.join(P_COLS)} FROM perf")
def _(s, d):
    return M.performance(equity(s, d), None, K).select("symbol", *P_COLS)


PLA_PERF = f"{LEDGER_SIGNALS['pla'][0]} {ledger_sql('x')}, eqs AS (SELECT * FROM leq), cpd AS (SELECT symbol, greatest(1.0 / 31, 86400 / median(g)) AS cpd FROM (SELECT symbol, {secs('ts')} - lag({secs('ts')}) OVER ({OVER}) AS g FROM bars WHERE rn <= 50) GROUP BY symbol)"


@query("performance_pla", f"{PLA_PERF}{PERF[len(EQUITY):]} SELECT symbol, {', '.join(P_COLS)} FROM perf")
def _(s, d):
    sig = stage(LEDGER_SIGNALS["pla"][1](s, d))
    return M.performance(equity(s, d, sig), P.round_trips(sig, K), K).select("symbol", *P_COLS)


def backtest(s, d):
    sig = signals(s, d)
    return M.performance(equity(s, d, sig), P.round_trips(sig, K), K)


SCORE = "0.35 * (least(greatest(sharpe_ratio, -3.0), 3.0) + 3) / 6 + 0.25 * (least(greatest(total_return_pct, -50.0), 100.0) + 50) / 150 + 0.20 * (least(greatest(sortino_ratio, -3.0), 3.0) + 3) / 6 + 0.10 * (least(greatest(calmar_ratio, -3.0), 3.0) + 3) / 6 + 0.10 * (1 - least(abs(max_drawdown_pct), 50.0) / 50)"


@query("score", f"WITH RECURSIVE {PERF} SELECT symbol, round({SCORE}, 4) AS score FROM perf")
def _(s, d):
    return M.score(M.performance(equity(s, d), None, K)).select("symbol", "score")


def _breakdown():
    rows = []
    for n, (w, lo, hi) in M.SCORE.items():
        v = f"abs({n})" if n == "max_drawdown_pct" else n
        x = f"(least(greatest({v}, {lo}), {hi}) - {lo}) / ({hi} - {lo})"
        x = f"(1 - {x})" if n == "max_drawdown_pct" else x
        rows.append(f"SELECT symbol, '{n}' AS metric, CAST({w} AS DOUBLE) AS weight, {n} AS value, round({x}, 4) AS normalized, round({w} * {x}, 4) AS contribution FROM perf")
    return f"WITH RECURSIVE {PERF} {' UNION ALL '.join(rows)}"


@query("score_breakdown", _breakdown())
def _(s, d):
    return M.score_breakdown(M.performance(equity(s, d), None, K), K)


@query("rolling_risk", f"""WITH RECURSIVE {DD}, w AS (SELECT *, stddev_pop(ret) OVER z AS sd, avg(ret) OVER z AS mu, count(ret) OVER z AS c FROM dd WINDOW z AS ({OVER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
   SELECT symbol, CAST(rn AS BIGINT) AS rn, {rx('CASE WHEN sd > 1e-10 THEN mu / sd * sqrt(252) WHEN c > 0 THEN 0 END', 'rolling_sharpe', 4)}, {rx('drawdown', 'drawdown', 4)} FROM w""")
def _(s, d):
    return fin(M.rolling_risk(equity(s, d), K), "symbol", "rn", "rolling_sharpe", "drawdown", digits=4)


DSMA = Sql()
_t = DSMA.table({"f": roll("avg", "close", 5), "s": roll("avg", "close", 15)})
_j = DSMA.join({"f": (_t, "f"), "s": (_t, "s")}, keep="b.ts, b.close, ")
_df = DSMA.add(f'SELECT symbol, rn, ts, close, coalesce({lag("f - s")} <= 0 AND f - s > 0, false) AS entry, coalesce({lag("f - s")} >= 0 AND f - s < 0, false) AS "exit" FROM {_j}')
DTRADES = f"{daily_cte()}, {', '.join(DSMA.ctes)}, {', '.join(latch_tail(_df)[0])}" + TRADES[len(SMA_SIGNALS):]


def daily_signals(s, d):
    return stage(G.signals_from_masks(preset_flags(order_bars(s, d), K, "SMA_CROSS", fast=5, slow=15), K))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query("monthly_pnl", f"WITH RECURSIVE {DTRADES} SELECT symbol, CAST(year(exit_time) AS INTEGER) AS year, {', '.join(rx(f'coalesce(sum(pnl) FILTER (month(exit_time) = {i}), 0)', m, 4) for i, m in enumerate(MONTHS, 1))} FROM trades GROUP BY 1, 2")
def _(s, d):
    return fin(M.monthly_pnl(P.round_trips(daily_signals(s, d), K), K), digits=4)


@query("monthly_equity_change", f"""WITH RECURSIVE {EQUITY}, m AS (SELECT symbol, year(ts) AS year, month(ts) AS month, last(equity ORDER BY rn) AS month_end, first(equity ORDER BY rn) AS f FROM eqs GROUP BY 1, 2, 3)
   SELECT symbol, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, {rx('month_end', 'month_end')}, {rx('month_end - coalesce(lag(month_end) OVER (PARTITION BY symbol ORDER BY year, month), f)', 'change')} FROM m""")
def _(s, d):
    return fin(M.monthly_equity_change(equity(s, d), K))


@query("downsample", f"WITH RECURSIVE {EQUITY}, m AS (SELECT symbol, max(rn) AS n FROM eqs GROUP BY symbol) SELECT symbol, CAST(rn AS BIGINT) AS rn, {rx('equity', 'equity')} FROM eqs JOIN m USING (symbol) WHERE rn % greatest(CAST(ceil((n + 1) / 200) AS BIGINT), 1) = 0 OR rn = n")
def _(s, d):
    return fin(M.downsample(equity(s, d), K, 200), "symbol", "rn", "equity")


# two parameter sets stand for the original and the improved strategy
def _tuned_perf(fast, slow):
    def run(s, d):
        sig = stage(G.signals_from_masks(preset_flags(event_bars(s, d), K, "SMA_CROSS", fast=fast, slow=slow), K))
        return M.performance(equity(s, d, sig), P.round_trips(sig, K), K)
    return run


def perf_sql(fast, slow, tables=True):
    q = Sql()
    f = flags_sql("SMA_CROSS", {**params_of("SMA_CROSS"), "fast": fast, "slow": slow}, q)
    head = f"{bars_cte()}, {', '.join(q.ctes)}, {', '.join(latch_tail(f)[0])}"
    return head + TRADES[len(SMA_SIGNALS):] + PERF[len(SMA_SIGNALS):] + f", ts AS ({TS}), dur AS (SELECT symbol, max(c) AS dd FROM (SELECT symbol, isle, count(*) AS c FROM (SELECT symbol, drawdown, rn - row_number() OVER (PARTITION BY symbol, drawdown < 0 ORDER BY rn) AS isle FROM dd) WHERE drawdown < 0 GROUP BY 1, 2) GROUP BY symbol)"


PERF_ROW = "SELECT p.symbol, total_return_pct, annualised_return_pct, sharpe_ratio, sortino_ratio, calmar_ratio, win_rate, profit_factor, avg_trade_pnl, volatility_pct, max_drawdown_pct, CAST(dd AS DOUBLE) AS max_dd_duration_candles FROM perf p JOIN ts USING (symbol) JOIN dur USING (symbol)"


def _diff_sql():
    names = list(M.DIRECTION)
    both = f"a AS MATERIALIZED (WITH RECURSIVE {perf_sql(10, 30)} {PERF_ROW}), b AS MATERIALIZED (WITH RECURSIVE {perf_sql(5, 20)} {PERF_ROW})"
    rows = [f"SELECT symbol, '{n}' AS metric, a.{n} AS o, b.{n} AS i, {M.DIRECTION[n]} AS dir FROM a JOIN b USING (symbol)" for n in names]
    return f"WITH {both}, m AS ({' UNION ALL '.join(rows)}) SELECT symbol, metric, o AS original, i AS improved, round(i - o, 4) AS delta, round((i - o) / nullif(abs(o), 0) * 100, 2) AS pct_change, (i - o) * dir > 0 AS better FROM m"


@query("metric_diff", _diff_sql())
def _(s, d):
    return M.metric_diff(_tuned_perf(10, 30)(s, d), _tuned_perf(5, 20)(s, d), K)


@query("buy_hold_verdict", f"""WITH RECURSIVE {perf_sql(10, 30)}, h AS (SELECT symbol, (last(close ORDER BY rn) / first(close ORDER BY rn) - 1) * 100 AS h FROM bars GROUP BY symbol)
   SELECT symbol, total_return_pct, round(h, 4) AS buy_hold_pct, total_return_pct > h AS beats_hold, CASE WHEN num_trades = 0 THEN 'no trades' WHEN total_return_pct > 0 AND sharpe_ratio >= 1 THEN 'promising' WHEN total_return_pct > 0 AND sharpe_ratio > 0 THEN 'modest' ELSE 'underperforms' END AS tier,
   abs(max_drawdown_pct) > 20 AS severe_drawdown FROM perf JOIN ts USING (symbol) JOIN h USING (symbol)""")
def _(s, d):
    return M.buy_hold_verdict(event_bars(s, d), backtest(s, d), K)


@query("metric_table", f"""WITH a AS MATERIALIZED (WITH RECURSIVE {perf_sql(10, 30)} {PERF_ROW}), b AS MATERIALIZED (WITH RECURSIVE {perf_sql(5, 20)} {PERF_ROW})
   {' UNION ALL '.join(f"SELECT symbol, '{n}' AS metric, a.{n} AS slow_cross, b.{n} AS fast_cross FROM a JOIN b USING (symbol)" for n in ('total_return_pct', 'sharpe_ratio', 'win_rate', 'max_drawdown_pct'))}""")
def _(s, d):
    u = _tuned_perf(10, 30)(s, d).withColumn("strategy", F.lit("slow_cross")).unionByName(_tuned_perf(5, 20)(s, d).withColumn("strategy", F.lit("fast_cross")))
    return M.metric_table(u, K, "strategy", ["slow_cross", "fast_cross"], ["total_return_pct", "sharpe_ratio", "win_rate", "max_drawdown_pct"])


# ------------------------------------------------------------------ weighted-average-cost ledger

# ------------------------------------------------------------------ stored results

KEPT = ["total_return_pct", "sharpe_ratio", "sortino_ratio", "profit_factor", "win_rate", "num_trades", "trades_per_day", "avg_trade_duration", "best_trade", "worst_trade"]


def stored(s, d, name):
    """Results and trades of one batch, written twice (a repeated job) and read back."""
    from ..session import stage_folder
    path = f"{stage_folder(s)}/stored-{uuid.uuid4().hex}"
    sig = signals(s, d)
    trades = stage(P.round_trips(sig, K))
    metrics = M.performance(equity(s, d, sig), trades, K)
    for _ in range(2):
        write_results(metrics, trades, K, path, "first")
    return s.read.parquet(f"{path}/{name}")


@query("write_results", f"""WITH RECURSIVE {TRADES}{PERF[len(SMA_SIGNALS):]}, ts AS ({TS}) SELECT symbol, 'first' AS batch, {rx('final_equity - 100000', 'total_return', 3)}, {', '.join(KEPT)}, max_drawdown_pct AS max_drawdown, final_equity AS json_equity FROM perf JOIN ts USING (symbol)""")
def _(s, d):
    back = stored(s, d, "results").withColumn("json_equity", F.get_json_object("results_json", "$.final_equity").cast("double"))
    return back.select("symbol", "batch", (F.round("total_return", 3) + F.lit(0.0)).alias("total_return"), *KEPT, "max_drawdown", "json_equity")


@query("write_trades", f"WITH RECURSIVE {TRADES} SELECT symbol, 'first' AS batch, trade_no, entry_time, exit_time, {r(*T_COLS)} FROM trades")
def _(s, d):
    return fin(stored(s, d, "trades"), "symbol", "batch", "trade_no", "entry_time", "exit_time", *T_COLS)


LEDGER = """WITH RECURSIVE f AS MATERIALIZED (SELECT CAST(l_suppkey AS VARCHAR) AS account, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
    l_extendedprice / l_quantity AS price, l_quantity AS qty FROM lineitem),
  st(account, rn, held, cost, fees, sold, pnl) AS (SELECT DISTINCT account, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE FROM f UNION ALL
   SELECT account, rn, held + CASE WHEN side = 'BUY' THEN qty ELSE -sl END, CASE WHEN side = 'BUY' THEN cost + price * qty WHEN held > 0 THEN cost * (1 - sl / held) ELSE 0 END, CASE WHEN side = 'BUY' THEN fees + price * qty * 0.001 WHEN held > 0 THEN fees * (1 - sl / held) ELSE 0 END,
     CASE WHEN side = 'BUY' THEN 0 ELSE sl END, CASE WHEN side = 'SELL' AND sl > 0 THEN (price - cost / held) * sl - price * sl * 0.001 - fees * sl / held END FROM
    (SELECT s.*, e.held, e.cost, e.fees, least(s.qty, e.held) AS sl FROM st e JOIN f s ON s.account = e.account AND s.rn = e.rn + 1)) """


@query("wacb_ledger", LEDGER + f"SELECT account, rn, {rx('held', 'held', 4)}, {rx('sold', 'sold', 4)}, {rx('pnl', 'realised_pnl', 3)}, {rx('CASE WHEN held > 1e-10 THEN cost / held END', 'avg_cost', 3)} FROM st WHERE rn > 0")
def _(s, d):
    w = P.wacb_ledger(fills(s, d).select("account", "rn", "side", "price", "qty"), ["account"], fee=0.001)
    return w.select("account", "rn", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("held", 4), ("sold", 4), ("realised_pnl", 3), ("avg_cost", 3))])


# ------------------------------------------------------------------ regimes

def regime_sql(cte: str) -> str:
    return cte + f""", g0 AS (SELECT symbol, rn, ts, close, close / lag(close) OVER ({OVER}) - 1 AS ret, CASE WHEN rn <= 50 THEN {secs('ts')} - lag({secs('ts')}) OVER ({OVER}) END AS gap, n FROM bars),
  g1 AS (SELECT symbol, any_value(n) AS n, greatest(1.0 / 31, 86400 / median(gap)) AS cpd FROM g0 GROUP BY symbol),
  g2 AS (SELECT *, least(greatest(n / cpd / 5, 10.0), 60.0) AS ld FROM g1),
  g3 AS MATERIALIZED (SELECT symbol, cpd, greatest(2, round_even(ld * cpd, 0))::BIGINT AS lw, greatest(2, round_even(greatest(2.0, ld / 3) * cpd, 0))::BIGINT AS sw FROM g2),
  g4 AS MATERIALIZED (SELECT a.symbol, a.rn, any_value(a.ts) AS ts, any_value(a.close) AS close, any_value(sw) AS sw, CASE WHEN a.rn >= any_value(lw) THEN avg(b.close) END AS lma, CASE WHEN a.rn >= any_value(sw) THEN avg(b.close) FILTER (b.rn > a.rn - sw) END AS sma,
      CASE WHEN count(b.ret) FILTER (b.rn > a.rn - sw) >= 2 THEN stddev_samp(b.ret) FILTER (b.rn > a.rn - sw) END AS rv FROM g0 a JOIN g3 USING (symbol) JOIN g0 b ON b.symbol = a.symbol AND b.rn <= a.rn AND b.rn > a.rn - lw GROUP BY a.symbol, a.rn),
  g5 AS (SELECT symbol, greatest(0.3 * median(rv), 1e-5) AS eps FROM g4 GROUP BY symbol),
  labels AS MATERIALIZED (SELECT a.symbol, a.rn, a.ts, a.close, CASE WHEN a.close > a.lma AND a.sma > a.lma AND a.sma / p.sma - 1 > eps THEN 'bull' WHEN a.close < a.lma AND a.sma < a.lma AND a.sma / p.sma - 1 < -eps THEN 'bear' ELSE 'sideways' END AS regime
      FROM g4 a JOIN g5 USING (symbol) LEFT JOIN g4 p ON p.symbol = a.symbol AND p.rn = a.rn - a.sw)"""


# 4-hour bars with a tenfold price trend, so that all three regimes occur
LAB = regime_sql("""bars_raw AS MATERIALIZED (SELECT symbol, t AS ts, avg(p) * (1 + 0.5 * sin(epoch(t) / 250000.0)) AS close FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS t, 100 + value AS p FROM events) GROUP BY symbol, t),
  bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars_raw)""")


def wave_bars(s, d):
    from ..sources.bars import floor_ts, number_bars
    from ..sources.tables import event_ticks
    e = event_ticks(s, d).select(F.col("event_type").alias("symbol"), floor_ts(F.col("ts"), "4h").alias("t"), (100 + F.col("value")).alias("p"))
    b = e.groupBy("symbol", F.col("t").alias("ts")).agg(F.avg("p").alias("close"))
    b = b.withColumn("close", F.col("close") * (1 + 0.5 * F.sin(F.unix_seconds(F.col("ts").cast("timestamp")) / 250000.0)))
    return stage(number_bars(b, total="n"))


def labels(s, d):
    return stage(R.classify_regimes(wave_bars(s, d), K))


@query("classify_regimes", f"WITH {LAB} SELECT symbol, ts, regime FROM labels")
def _(s, d):
    return R.classify_regimes(wave_bars(s, d), K).select("symbol", "ts", "regime")


@query("regime_mix", f"""WITH {LAB}, c AS (SELECT symbol, regime, count(*) AS bars FROM labels GROUP BY 1, 2)
   SELECT symbol, regime, bars, round(100.0 * bars / sum(bars) OVER (PARTITION BY symbol), 2) AS share_pct, row_number() OVER (PARTITION BY symbol ORDER BY bars DESC, regime DESC) = 1 AS dominant FROM c""")
def _(s, d):
    return R.regime_mix(labels(s, d), K)


EQW = f"""{LAB}, fr AS (SELECT a.symbol, a.rn, a.regime, b.close / a.close - 1 AS fwd FROM labels a LEFT JOIN labels b ON b.symbol = a.symbol AND b.rn = a.rn + 1)"""


def wave_equity(lab):
    return lab.select("symbol", "rn", "ts", F.col("close").alias("equity"))


@query("regime_metrics", f"""WITH {EQW}, a AS (SELECT symbol, regime, count(*) AS nc, avg(fwd) AS mu, stddev_pop(fwd) AS sd, CASE WHEN count(*) FILTER (fwd < 0) > 1 THEN stddev_pop(fwd) FILTER (fwd < 0) ELSE 1e-10 END AS ds, product(1 + fwd) AS gr FROM fr GROUP BY 1, 2)
   SELECT symbol, regime, round((gr - 1) * 100, 4) AS total_return_pct, round(CASE WHEN sd > 1e-10 THEN mu / sd * sqrt(252 * cpd) ELSE 0 END, 4) AS sharpe_ratio, round(CASE WHEN ds > 1e-10 THEN mu / ds * sqrt(252 * cpd) ELSE 0 END, 4) AS sortino_ratio,
   round(sd * sqrt(252 * cpd) * 100, 4) AS volatility_pct, nc AS num_candles, round(100.0 * nc / sum(nc) OVER (PARTITION BY symbol), 2) AS pct_of_period FROM a JOIN g3 USING (symbol)""")
def _(s, d):
    lab = labels(s, d)
    return R.regime_metrics(wave_equity(lab), lab, K)


@query("regime_drawdown", f"""WITH {EQW}, c AS (SELECT symbol, regime, rn, sum(ln(1 + fwd)) OVER (PARTITION BY symbol, regime ORDER BY rn) AS lg FROM fr WHERE fwd IS NOT NULL), m AS (SELECT *, greatest(0, max(lg) OVER (PARTITION BY symbol, regime ORDER BY rn)) AS pk FROM c)
   SELECT symbol, regime, round(least(min(exp(lg - pk) - 1), 0) * 100, 4) AS max_drawdown_pct FROM m GROUP BY 1, 2""")
def _(s, d):
    lab = labels(s, d)
    return R.regime_drawdown(wave_equity(lab), lab, K)


@query("regime_periods", f"""WITH {LAB}, x AS (SELECT *, CASE WHEN regime = lag(regime) OVER ({OVER}) THEN 0 ELSE 1 END AS nw FROM labels), y AS (SELECT *, sum(nw) OVER ({OVER}) AS p FROM x)
   SELECT symbol, CAST(p AS BIGINT) AS period, any_value(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bars FROM y GROUP BY symbol, p""")
def _(s, d):
    return R.regime_periods(labels(s, d), K)


VOLS = f"""{LAB}, x AS (SELECT symbol, rn, regime, ln(close / lag(close) OVER ({OVER})) AS lr, lag(regime) OVER ({OVER}) AS fr FROM labels), a AS (SELECT symbol, stddev_pop(lr) AS al, count(*) AS n FROM x GROUP BY symbol),
   sc AS (SELECT symbol, regime, CASE WHEN (SELECT count(*) FROM x y WHERE y.symbol = x.symbol AND y.fr = x.regime) < 2 THEN 1.0 ELSE (SELECT stddev_pop(lr) FROM x y WHERE y.symbol = x.symbol AND y.fr = x.regime) / any_value(al) END AS vs, count(*) / any_value(a.n) AS fraction FROM x JOIN a USING (symbol) GROUP BY symbol, regime)"""


@query("regime_vol_scales", f"WITH {VOLS} SELECT symbol, regime, round(vs, 4) AS vol_scale, {rx('fraction', 'fraction')} FROM sc")
def _(s, d):
    return fin(R.regime_vol_scales(labels(s, d), K))


# a trade a bar, some entered between bars: exact match first, then the first bar of the date
@query("attribute_trades", f"""WITH {LAB}, t AS (SELECT symbol, rn AS trade_no, ts + CASE WHEN rn % 2 = 0 THEN INTERVAL 17 MINUTE ELSE INTERVAL 0 MINUTE END AS entry_time FROM labels)
   SELECT t.symbol, trade_no, coalesce(e.regime, (SELECT first(regime ORDER BY ts) FROM labels l WHERE l.symbol = t.symbol AND l.ts::DATE = t.entry_time::DATE)) AS regime FROM t LEFT JOIN labels e ON e.symbol = t.symbol AND e.ts = t.entry_time""")
def _(s, d):
    lab = labels(s, d)
    t = lab.select("symbol", F.col("rn").alias("trade_no"), F.expr("ts + CASE WHEN rn % 2 = 0 THEN INTERVAL 17 MINUTES ELSE INTERVAL 0 MINUTES END").alias("entry_time"))
    return R.attribute_trades(t, lab, K).select("symbol", "trade_no", "regime")


# ------------------------------------------------------------------ out of sample

@query("holdout_split", f"WITH {bars_cte()} SELECT symbol, ts, CASE WHEN rn <= cut THEN 'in' ELSE 'out' END AS part, CASE WHEN rn <= cut THEN rn ELSE rn - cut END AS part_rn FROM (SELECT *, greatest(1, least(n - 1, floor(n * 0.7::DOUBLE)))::BIGINT AS cut FROM bars)")
def _(s, d):
    return V.holdout_split(event_bars(s, d)).select("symbol", "ts", "part", F.col("part_rn").cast("long").alias("part_rn"))


@query("tag_oos", f"WITH {bars_cte()} SELECT symbol, ts, CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 'out' ELSE 'in' END AS sample FROM bars")
def _(s, d):
    return V.tag_oos(raw_bars(s, d), F.lit("2024-01-22").cast("timestamp_ntz")).select("symbol", "ts", "sample")


FOLDS = f"""{daily_cte()}, c AS (SELECT symbol, n, CASE WHEN sh THEN floor(n * 0.60::DOUBLE)::BIGINT ELSE 252 END AS win, CASE WHEN sh THEN greatest(1, floor(n * 0.20::DOUBLE))::BIGINT ELSE 63 END AS st
     FROM (SELECT symbol, count(*) AS n, count(*) < 315 OR (count(*) - 252) // 63 < 2 AS sh FROM bars GROUP BY symbol)), k AS (SELECT unnest(range(0, 2000)) AS fold),
   folds AS (SELECT symbol, fold, fold * st AS train_start, fold * st + win AS test_start, fold * st + win + st AS test_end FROM c, k WHERE fold * st + win + st <= n)"""


@query("make_folds", f"WITH {FOLDS} SELECT * FROM folds")
def _(s, d):
    return V.make_folds(order_bars(s, d), K).select("symbol", "fold", "train_start", "test_start", "test_end")


@query("make_folds_short", f"WITH {bars_cte('day')}, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), k AS (SELECT unnest(range(0, 50)) AS fold), w AS (SELECT symbol, n, floor(n * 0.60::DOUBLE)::BIGINT AS win, greatest(1, floor(n * 0.20::DOUBLE))::BIGINT AS st FROM c) "
       "SELECT symbol, fold, fold * st AS train_start, fold * st + win AS test_start, fold * st + win + st AS test_end FROM w, k WHERE fold * st + win + st <= n")
def _(s, d):
    return V.make_folds(event_bars(s, d, "1d"), K).select("symbol", "fold", "train_start", "test_start", "test_end")


@query("assign_folds", f"WITH {FOLDS} SELECT b.symbol, b.ts, f.fold, CASE WHEN b.rn - 1 < test_start THEN 'train' ELSE 'test' END AS part, CASE WHEN b.rn - 1 < test_start THEN b.rn - train_start ELSE b.rn - test_start END AS rn FROM bars b JOIN folds f ON f.symbol = b.symbol AND b.rn - 1 >= train_start AND b.rn - 1 < test_end")
def _(s, d):
    b = order_bars(s, d)
    return V.assign_folds(b, V.make_folds(b, K), K).select("symbol", "ts", "fold", "part", F.col("rn").cast("long").alias("rn"))


def small_grid(s):
    return W.param_grid(s, fast=[3, 5], slow=[10, 20])


def walk_sql(window: int, step: int) -> str:
    """Every symbol, fold, part and parameter set as one series, then the single-strategy SQL."""
    grid = [(1, 3, 10), (2, 3, 20), (3, 5, 10), (4, 5, 20)]
    ma = lambda n: f"({roll('avg', 'close', n)})"
    dec = lambda c: f"CAST(round(CAST({c} AS DECIMAL(18, 4)), 3) AS DOUBLE)"
    return f"""WITH RECURSIVE {daily_cte('b0')}, c AS (SELECT symbol, n, CASE WHEN sh THEN floor(n * 0.60::DOUBLE)::BIGINT ELSE {window} END AS win, CASE WHEN sh THEN greatest(1, floor(n * 0.20::DOUBLE))::BIGINT ELSE {step} END AS st
       FROM (SELECT symbol, count(*) AS n, count(*) < {window + step} OR (count(*) - {window}) // {step} < 2 AS sh FROM b0 GROUP BY symbol)), k AS (SELECT unnest(range(0, 200)) AS fold),
     f AS (SELECT symbol, fold, fold * st AS a, fold * st + win AS b, fold * st + win + st AS e FROM c, k WHERE fold * st + win + st <= n),
     segs AS (SELECT b0.symbol || '|' || fold || '|' || CASE WHEN rn - 1 < b THEN 'train' ELSE 'test' END AS symbol, ts, open, high, low, close, volume, CASE WHEN rn - 1 < b THEN rn - a ELSE rn - b END AS rn FROM b0 JOIN f ON f.symbol = b0.symbol AND rn - 1 >= a AND rn - 1 < e),
     bars AS MATERIALIZED (SELECT symbol || '|' || pid AS symbol, ts, open, high, low, close, volume, rn, f, s FROM segs, (VALUES {', '.join(map(str, grid))}) g(pid, f, s)),
     sm AS MATERIALIZED (SELECT symbol, rn, ts, close, CASE f WHEN 3 THEN {ma(3)} ELSE {ma(5)} END - CASE s WHEN 10 THEN {ma(10)} ELSE {ma(20)} END AS dd FROM bars),
     flg AS MATERIALIZED (SELECT symbol, rn, ts, close, coalesce(lag(dd) OVER ({OVER}) <= 0 AND dd > 0, false) AS entry, coalesce(lag(dd) OVER ({OVER}) >= 0 AND dd < 0, false) AS "exit" FROM sm), {', '.join(latch_tail('flg')[0])}{TRADES[len(SMA_SIGNALS):]}{PERF[len(SMA_SIGNALS):]}, ts AS ({TS}),
     m AS MATERIALIZED (SELECT split_part(symbol, '|', 1) AS sym, CAST(split_part(symbol, '|', 2) AS BIGINT) AS fold, split_part(symbol, '|', 3) AS part, CAST(split_part(symbol, '|', 4) AS BIGINT) AS pid, sharpe_ratio, total_return_pct, max_drawdown_pct, coalesce(num_trades, 0) AS num_trades, coalesce(win_rate, 0.0) AS win_rate FROM perf LEFT JOIN ts USING (symbol)),
     best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym, fold ORDER BY sharpe_ratio DESC, pid) AS k FROM m WHERE part = 'train') WHERE k = 1),
     walk AS (SELECT b.sym AS symbol, b.fold, b.pid AS param_id, {dec('b.sharpe_ratio')} AS train_sharpe, {dec('t.total_return_pct')} AS return_pct, {dec('t.sharpe_ratio')} AS sharpe, {dec('t.max_drawdown_pct')} AS max_dd_pct, t.num_trades, t.win_rate FROM best b JOIN m t ON t.sym = b.sym AND t.fold = b.fold AND t.pid = b.pid AND t.part = 'test') """


@query("walk_forward", walk_sql(500, 250) + "SELECT * FROM walk")
def _(s, d):
    return V.walk_forward(order_bars(s, d), small_grid(s), K, 500, 250)


@query("wfe", walk_sql(800, 400) + f"SELECT symbol, count(*) AS folds, {rx('avg(train_sharpe)', 'mean_is')}, {rx('avg(sharpe)', 'mean_oos')}, CASE WHEN avg(train_sharpe) > 0.05 THEN round(least(greatest(avg(sharpe) / avg(train_sharpe), 0.0), 2.0), 4) END AS wfe FROM walk GROUP BY symbol")
def _(s, d):
    return fin(V.wfe(V.walk_forward(order_bars(s, d), small_grid(s), K, 800, 400), K))


@query("stitch_equity", f"""WITH {FOLDS}, seg AS (SELECT f.symbol, f.fold, b.rn - f.test_start AS rn, b.ts, b.close AS equity FROM bars b JOIN folds f ON f.symbol = b.symbol AND b.rn >= f.test_start AND b.rn <= f.test_end),
   e AS (SELECT symbol, fold, last(equity ORDER BY rn) / first(equity ORDER BY rn) AS g, first(equity ORDER BY rn) AS e0 FROM seg GROUP BY 1, 2), z AS (SELECT *, 10000 * coalesce(product(g) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) / e0 AS f FROM e)
   SELECT seg.symbol, seg.fold, seg.rn, {rx('equity * f', 'equity', 4)} FROM seg JOIN z ON z.symbol = seg.symbol AND z.fold = seg.fold WHERE seg.rn >= 1""")
def _(s, d):
    b = order_bars(s, d)
    f = V.make_folds(b, K)
    seg = V.assign_folds(b, f, K)
    test = seg.filter("part = 'test'").select("symbol", "fold", "rn", "ts", F.col("close").alias("equity"))
    # the last train bar is the start value of the test curve
    head = seg.join(f.select("symbol", "fold", "win"), ["symbol", "fold"]).filter("part = 'train' and rn = win").select("symbol", "fold", F.lit(0).cast("long").alias("rn"), "ts", F.col("close").alias("equity"))
    return fin(V.stitch_equity(head.unionByName(test), K), "symbol", "fold", "rn", "equity", digits=4)


@query("holdout_verdict", f"""WITH {bars_cte()}, h AS (SELECT symbol, rn <= greatest(1, least(n - 1, floor(n * 0.7::DOUBLE))) AS ins, close, rn FROM bars), x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, ins ORDER BY rn) - 1 AS ret FROM h),
   a AS (SELECT symbol, ins, round(avg(ret) / stddev_pop(ret), 4) AS sh, round((last(close ORDER BY rn) / first(close ORDER BY rn) - 1) * 100, 4) AS rt FROM x GROUP BY 1, 2)
   SELECT i.symbol, i.sh AS in_sharpe, i.rt AS in_return_pct, o.sh AS out_sharpe, o.rt AS out_return_pct, CASE WHEN o.rt < 0 THEN 'failed' WHEN i.sh > 0.1 AND o.sh < i.sh * 0.5 THEN 'degraded' ELSE 'stable' END AS verdict FROM a i JOIN a o ON i.symbol = o.symbol AND i.ins AND NOT o.ins""")
def _(s, d):
    h = V.holdout_split(event_bars(s, d)).withColumn("rn", F.col("part_rn").cast("long"))
    x = M.with_returns(h, ["symbol", "part"], "close", "ret")
    a = stage(x.groupBy("symbol", "part").agg(F.round(F.avg("ret") / F.stddev_pop("ret"), 4).alias("sharpe_ratio"), F.round((F.max_by("close", "rn") / F.min_by("close", "rn") - 1) * 100, 4).alias("total_return_pct")))
    return V.holdout_verdict(a.filter("part = 'in'"), a.filter("part = 'out'"), K)
