from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import metrics as M
from barweave.operators import positions as P
from barweave.operators import signals as G
from barweave.operators.indicators import compute
from barweave.operators.presets import PRESETS, preset_flags, preset_signals
from barweave.session import stage
from barweave.sources import tables as T

K = ["symbol"]


def test_all_presets_are_there():
    assert len(PRESETS) == 50


@pytest.mark.parametrize("name", ["MACROSS", "BB_RSI", "ST_MACD"])
def test_signals_alternate(walk, name):
    _, df = walk
    s = preset_signals(df, K, name, size=200).filter("signal <> 'HOLD'").orderBy("symbol", "rn").collect()
    for a, b in zip(s, s[1:]):
        if a.symbol == b.symbol:
            assert a.signal != b.signal
            if b.signal == "SELL":
                assert b.quantity == a.quantity
    assert all(r.quantity == pytest.approx(1000 / r.close) for r in s if r.signal == "BUY")


def test_rule_signals_obey_their_rule(walk):
    _, df = walk
    rsi = {"indicator": "rsi"}
    f = G.rule_flags(df, K, [{"left": rsi, "operator": "<", "right": {"value": 40}}], [{"left": rsi, "operator": ">", "right": {"value": 60}}])
    s = G.signals_from_masks(f, K).join(compute(df, K, "rsi").select("symbol", "rn", "rsi"), ["symbol", "rn"])
    assert s.filter("signal = 'BUY'").count() > 0
    assert s.filter("(signal = 'BUY' and rsi >= 40) or (signal = 'SELL' and rsi <= 60)").count() == 0


def test_unknown_rule_parts_are_refused(walk):
    _, df = walk
    ok = {"value": 1}
    for bad in ({"left": {"indicator": "nope"}, "operator": ">", "right": ok}, {"left": {"price": "typical"}, "operator": ">", "right": ok}, {"left": ok, "operator": "~", "right": ok}):
        with pytest.raises(ValueError):
            G.rule_flags(df, K, [bad], [])


def test_no_rules_never_trade(walk):
    _, df = walk
    assert G.rule_flags(df, K, [], []).filter("entry or exit").count() == 0


@pytest.mark.parametrize("size", [64, 4096])
def test_stop_and_target(walk, size):
    _, df = walk
    f = stage(preset_flags(df, K, "MACROSS"))
    got = G.signals_sl_tp(f, K, 1.0, 2.0, size=size).orderBy("symbol", "rn").collect()
    flags = {(r.symbol, r.rn): r for r in f.collect()}
    px, sym = None, None
    for r in got:
        if r.symbol != sym:
            px, sym = None, r.symbol
        fl = flags[r.symbol, r.rn]
        if px is None:
            assert r.signal == ("BUY" if fl.entry else "HOLD")
            px = r.close if fl.entry else None
        else:
            why = "stop_loss" if r.low <= px * 0.99 else "take_profit" if r.high >= px * 1.02 else "rule" if fl.exit else None
            assert r.exit_reason == why and (r.signal == "SELL") == (why is not None)
            px = None if why else px


def fills(spark, rows):
    return spark.createDataFrame([("a", i, side, float(q), float(p)) for i, (side, q, p) in enumerate(rows, 1)], "account string, rn long, side string, qty double, price double")


def test_ledger_average_cost(spark):
    r = P.wacb_ledger(fills(spark, [("BUY", 100, 100), ("BUY", 100, 120), ("SELL", 200, 130)]), ["account"]).orderBy("rn").collect()
    assert r[1].avg_cost == pytest.approx(110) and r[2].realised_pnl == pytest.approx(4000) and r[2].held == 0


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_ledger_partial_and_capped_sells(spark, size):
    r = P.wacb_ledger(fills(spark, [("SELL", 5, 99), ("BUY", 200, 100), ("SELL", 100, 110), ("SELL", 150, 120), ("BUY", 10, 50), ("SELL", 10, 60)]), ["account"], fee=0.001, size=size).orderBy("rn").collect()
    assert [x.sold for x in r] == [0, 0, 100, 100, 0, 10]
    assert r[2].realised_pnl == pytest.approx(1000 - 11 - 10) and r[3].realised_pnl == pytest.approx(2000 - 12 - 10)
    assert r[5].realised_pnl == pytest.approx(100 - 0.6 - 0.5) and r[5].held == 0


def test_ledger_moves_its_rows_once(spark, monkeypatch):
    """Short accounts: one shuffle of the fills, one staged table, no join; longer ones equal a walk row by row."""
    staged = []
    monkeypatch.setattr(P, "stage", lambda d: staged.append(stage(d)) or staged[-1])
    rng = np.random.default_rng(4)
    rows = [("BUY" if rng.random() < 0.5 else "SELL", int(rng.integers(1, 9)), float(rng.integers(90, 110))) for _ in range(400)]
    src = fills(spark, rows)
    one = P.wacb_ledger(src, ["account"], fee=0.001, size=4096)
    assert len(staged) == 1 and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    held, cost, want = 0.0, 0.0, []
    for side, q, px in rows:
        sold, pnl = (0.0, None) if side == "BUY" else (min(q, held), None)
        if side == "BUY":
            held, cost = held + q, cost + px * q
        elif sold > 0:
            pnl = (px - cost / held) * sold - px * sold * 0.001 - cost * 0.001 * sold / held
            held, cost = held - sold, cost * (1 - sold / held)
        want.append((held, sold, pnl))
    for r in (one, *[P.wacb_ledger(src, ["account"], fee=0.001, size=n) for n in (7, 100, 400)]):
        got = [(x.held, x.sold, x.realised_pnl) for x in r.orderBy("rn").collect()]
        for g, w in zip(got, want, strict=True):
            assert g[:2] == w[:2] and g[2] == (w[2] and pytest.approx(w[2]))


def test_ledger_leaves_out_unknown_accounts_and_waits_for_a_quantity(spark):
    d = spark.createDataFrame([(None, 1, "BUY", 1.0, 1.0), ("a", 1, "SELL", None, 5.0), ("a", 2, "BUY", 2.0, 10.0), ("a", 3, "SELL", None, 12.0)], "account string, rn long, side string, qty double, price double")
    for size in (1, 2, 4096):
        assert [(r.account, r.held, r.sold) for r in P.wacb_ledger(d, ["account"], size=size).orderBy("rn").collect()] == [("a", None, 0.0), ("a", 2.0, 0.0), ("a", 2.0, 2.0)]


def test_ledger_goes_on_after_an_unknown_cost(spark):
    """Amounts are unknown to the end of the 32 fills of which one has no price; then those known before them count."""
    rows = [("BUY", 1.0, 10.0)] * 32 + [("BUY", 1.0, 50.0), ("BUY", 1.0, None), ("SELL", 17.0, 20.0)] + [("BUY", 1.0, 10.0)] * 29 + [("SELL", 2.0, 12.0)]
    src = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows, 1)], "account string, rn long, side string, qty double, price double")
    for size in (32, 64, 4096):
        r = P.wacb_ledger(src, ["account"], size=size).orderBy("rn").collect()
        assert r[32].avg_cost == pytest.approx(370 / 33) and [x.avg_cost for x in r[33:64]] == [None] * 31 and r[34].realised_pnl is None
        assert r[64].realised_pnl == pytest.approx(2 * 12 - 2 * 160 / 46) and r[64].held == 44


def test_fills_of_long_accounts_are_numbered_in_order(spark, tmp_path):
    """Buckets of a long account follow the order, also within a day and for unknown times and orders."""
    at = [None, datetime(2024, 1, 1), datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 17), datetime(2024, 1, 2)]
    rows = [(o, 1, a, i, 1.0 + i, 10.0, "R" if i % 3 else "N", ts) for a in (1, None) for i, (ts, o) in enumerate((t, o) for t in at for o in (None, 5, 2_500_000))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for whole in (3, 100):
        got = T.fills(spark, str(tmp_path), whole).orderBy("account", "rn").collect()
        assert [(r.rn, r.l_linenumber) for r in got] == [(i + 1, i) for i in range(15)] * 2


def test_cost_identities(spark):
    d = spark.createDataFrame([(100_000.0, s, m) for s in ("BUY", "SELL") for m in P.EXCHANGE_RATES] + [(-5.0, "BUY", "futures")], "turnover double, side string, market_type string")
    for r in P.indian_cost(d).collect():
        c = r.cost
        if r.turnover < 0:
            assert c.total == 0
            continue
        assert c.total == pytest.approx(c.brokerage + c.stt + c.exchange_charges + c.sebi_charges + c.gst + c.stamp_duty)
        assert c.gst == pytest.approx(0.18 * (c.brokerage + c.exchange_charges + c.sebi_charges)) and c.brokerage == 20
        assert (c.stamp_duty > 0) == (r.side == "BUY")


def curve(spark, values, key="a"):
    return stage(spark.createDataFrame(pd.DataFrame({"symbol": key, "rn": np.arange(len(values)), "ts": pd.date_range("2022-01-01", periods=len(values), freq="D"), "equity": np.asarray(values, dtype=float)})))


def test_annualised_return(spark):
    m = M.performance(curve(spark, 10000 * 1.001 ** np.arange(253)), None, K).first()
    assert abs(m.annualised_return_pct - 28.6) < 2 and m.max_drawdown_pct == 0 and m.calmar_ratio == 0


def test_drawdown_and_longest_stretch(spark):
    e = curve(spark, [100, 90, 95, 100, 120, 60, 80, 119, 121])
    for size in (2, 4096):
        m = M.performance(e, None, K, size).first()
        assert m.max_drawdown_pct == -50 and m.max_dd_duration_candles == 3


def test_one_winning_trade(spark):
    t = spark.createDataFrame([("a", 1, "2022-01-01", "2022-01-03", 100.0)], "symbol string, trade_no int, entry_time string, exit_time string, pnl double")
    t = t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "exit_time")})
    r = M.trade_stats(t, K).first()
    assert (r.num_trades, r.win_rate, r.profit_factor, r.avg_trade_duration, r.trades_per_day) == (1, 100.0, float("inf"), 48.0, 0.5)


def test_score_of_nothing_is_half(spark):
    d = spark.createDataFrame([(None,) * 5], ", ".join(f"{m} double" for m in M.SCORE))
    assert M.score(d).first().score == 0.5


def test_trades_add_up_to_equity(walk):
    _, df = walk
    s = stage(preset_signals(df, K, "SMA_CROSS", size=128))
    t = P.round_trips(s, K, size=128).groupBy("symbol").agg(F.sum("pnl").alias("pnl"))
    e = P.equity_curve(s, K, 50_000.0, size=128).groupBy("symbol").agg(F.max_by("equity", "rn").alias("last"))
    for r in t.join(e, "symbol").collect():
        assert r.last == pytest.approx(50_000 + r.pnl, abs=1e-6)


def ledger(rows, slip, fee):
    """Trades of one series bar by bar: average cost, capped sales, entry fees by share."""
    held = cost = fees = 0.0
    opened, out = None, []
    for ts, close, signal, q in rows:
        if signal == "BUY" and q > 0:
            opened = ts if held == 0 else opened
            held, cost, fees = held + q, cost + q * close * (1 + slip), fees + round(q * close * (1 + slip) * fee, 4)
        elif signal == "SELL" and min(q, held) > 0:
            s = min(q, held)
            out.append((opened, cost / held, ts, s, fees * s / held, False))
            cost, fees, held = cost * (1 - s / held), fees * (1 - s / held), held - s
            held = held if held > 1e-10 else 0.0
    if held:
        out.append((opened, cost / held, rows[-1][0], held, fees, True))
    return out


@pytest.mark.parametrize("size", [4096, 7])
def test_trades_of_repeated_buys_and_partial_sales(spark, size):
    import datetime
    import random
    rng = random.Random(3)
    series = {"a": [("BUY", 1, 100), ("BUY", 1, 102), ("HOLD", 0, 103), ("SELL", 2, 104), ("HOLD", 0, 90)],
              "b": [("SELL", 5, 99), ("BUY", 2, 100), ("SELL", 1, 110), ("SELL", 9, 120), ("BUY", 10, 50)],
              "c": [(rng.choice(["BUY", "SELL", "HOLD"]), float(rng.randrange(0, 6)), 100 + rng.random()) for _ in range(90)]}
    t0 = datetime.datetime(2024, 1, 1)
    rows = {k: [(t0 + datetime.timedelta(hours=i), float(c), s, float(q)) for i, (s, q, c) in enumerate(v)] for k, v in series.items()}
    df = stage(spark.createDataFrame([(k, i + 1, *r) for k, v in rows.items() for i, r in enumerate(v)], "symbol string, rn long, ts timestamp_ntz, close double, signal string, quantity double"))
    got = {}
    for r in P.round_trips(df, ["symbol"], size=size).orderBy("symbol", "trade_no").collect():
        got.setdefault(r.symbol, []).append(r)
    for k, v in rows.items():
        want = ledger(v, 0.001, 0.001)
        assert [r.trade_no for r in got[k]] == list(range(1, len(want) + 1))
        for r, (opened, avg, ts, q, fees, end) in zip(got[k], want):
            assert (r.entry_time, r.exit_time, r.open_end) == (opened, ts, end)
            assert r.entry_price == pytest.approx(avg) and r.quantity == pytest.approx(q)
            assert r.fees == pytest.approx(fees + round(r.exit_price * q * 0.001, 4), abs=2e-4)
    e = P.equity_curve(df, ["symbol"], 1000.0, size=size).groupBy("symbol").agg(F.max_by("equity", "rn").alias("last"))
    for r in e.collect():
        assert r["last"] == pytest.approx(1000 + sum(t.pnl for t in got[r.symbol]), abs=0.01)
